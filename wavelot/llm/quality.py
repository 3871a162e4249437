"""Quality rules as a short-circuit cascade.

Each rule looks at one text and rejects it or not. Costs and rejection rates are estimated on a
bounded sample, and the cascade then tries the rules with the most rejections per second first,
each judged on the sample rows that the rules before it let through. The order changes only the
time spent, never the verdict, because a text is kept if no rule rejects it.

Defined results: a null or empty text has no words, so every count is 0 and the base check fails.
Repeated rows are judged one by one and get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelot.llm.common import giving_back, small_batches

SYMBOLS = b"#*$%&|<>"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_SPACE = b" \t\n\x0b\x0c\r"


class TextStats:
    """Figures of one text, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.text) - (len(self.data) - len(self.data.translate(None, _SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by 3-word windows that occur twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        often = Counter(windows)
        covered, end = 0, 0
        for i, x in enumerate(windows):
            if often[x] > 1:
                covered += i + 3 - max(end, i)
                end = i + 3
        return covered

    @cached_property
    def n_letter_words(self) -> int:
        """Words that hold an ASCII letter or any character beyond ASCII."""
        return sum(1 for x in self.words if _LETTER.search(x))

    @cached_property
    def n_distinct_words(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_upper(self) -> int:
        return len(self.data) - len(self.data.translate(None, _UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.data) - len(self.data.translate(None, _LOWER))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextStats], bool]


#: Whole numbers only, so that the same rules in SQL agree to the last row.
RULES = (
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("word_length", lambda s: s.word_chars < 3 * s.n_words or s.word_chars > 10 * s.n_words),
    Rule("letters", lambda s: 10 * s.n_letter_words < 8 * s.n_words),
    Rule("duplicate_lines", lambda s: 2 * s.n_dup_lines > len(s.lines)),
    Rule("capitals", lambda s: s.n_upper > s.n_lower),
    Rule("distinct_words", lambda s: 20 * s.n_distinct_words < s.n_words),
)
BASE = Rule("base", lambda s: s.base_failed)


def order_rules(outcomes: list[list[bool]], costs: list[list[float]]) -> list[int]:
    """Greedy order: always the rule with the most rejections per second among rows still alive."""
    left, rows, order = list(range(len(outcomes[0]) if outcomes else 0)), list(range(len(outcomes))), []
    while left:
        rate = {j: sum(outcomes[i][j] for i in rows) / (sum(costs[i][j] for i in rows) + 1e-9) for j in left}
        best = max(left, key=lambda j: (rate[j], -j))
        order.append(best)
        left.remove(best)
        rows = [i for i in rows if not outcomes[i][best]]
    return order


def plan_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = 400) -> tuple[Rule, ...]:
    """Order the rules by what a sample of about sample_rows rows (a fixed bound) shows of them."""
    n = docs.count()
    if not n or len(rules) < 2:
        return rules

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rejected, seconds = [], []
            for text in pdf["t"]:
                r, s = [], []
                for rule in rules:
                    stats, t = TextStats(text), time.perf_counter()
                    r.append(bool(rule.rejects(stats)))
                    s.append(time.perf_counter() - t)
                rejected.append(r)
                seconds.append(s)
            yield pd.DataFrame({"rejected": rejected, "seconds": seconds})

    small_batches(docs.sparkSession)
    sample = docs.select(F.col(text_col).cast("string").alias("t")).sample(fraction=min(1.0, sample_rows / n), seed=7)
    seen = sample.mapInPandas(measure, "rejected array<boolean>, seconds array<double>").limit(4 * sample_rows).collect()
    order = order_rules([list(x.rejected) for x in seen], [list(x.seconds) for x in seen])
    return tuple(rules[j] for j in order) if order else rules


def verdict(rules: tuple[Rule, ...]):
    """A column function text -> struct of the base figures, the rule that rejected the text, and kept."""

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, rejected_by string, kept boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                s = TextStats(text)
                by = "base" if s.base_failed else next((r.name for r in rules if r.rejects(s)), None)
                rows.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, by, by is None))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"])

    return judge


def passes(rules: tuple[Rule, ...]):
    """A column function text -> boolean that stops at the first rule which rejects."""

    @F.pandas_udf("boolean")
    @giving_back
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([not any(r.rejects(s) for r in rules) for s in map(TextStats, batch)], dtype=bool)

    return keep


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400) -> DataFrame:
    """One row per document: id, the base figures, base_failed, rejected_by and kept."""
    ordered = plan_rules(docs, rules, text_col, sample_rows)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), verdict(ordered)(F.col(text_col).cast("string")).alias("v")).select("doc_id", "v.*")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = 400) -> DataFrame:
    """The documents that neither the base check nor a rule rejects, with all their columns."""
    ordered = plan_rules(docs, (BASE, *rules), text_col, sample_rows)
    return docs.where(passes(ordered)(F.col(text_col).cast("string")))


#: The same figures and rules in DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w
), g2 AS (
  SELECT r, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM g WINDOW p AS (PARTITION BY r ORDER BY i)
), g3 AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM g2 WHERE z IS NOT NULL
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE c > 1) GROUP BY r
), s AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
         len(list_distinct(ws)) AS n_distinct_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN cov USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR 10 * n_letter_words < 8 * n_words OR 2 * n_dup_lines > n_lines OR n_upper > n_lower
            OR 20 * n_distinct_words < n_words) AS kept
FROM b
"""
