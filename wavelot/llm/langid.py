"""Language identification with language-bitmask n-gram filters.

Learning: letter 4-grams (of UTF-8 bytes, lower case) of labelled sample texts, kept for a language where they are
frequent enough there. All languages share one bit-sliced Bloom filter: each slot holds one bit per
language, and the AND of an n-gram's slots is the mask of all languages that contain it. Prediction: count each
language's bits over all n-grams of the whole text, correct every count for that language's false positives,
and take the largest.

The learning sample is bounded: about per_language texts of each language, chosen by a hash of doc_id.

Defined results: `und` with score 0 for a null text, a text without a letter, or when nothing was learned. A text whose
letters match no filter gets the commonest learned language, scored by its share. Repeated rows are judged one by one, very long
ones whole, ties go to the language first in alphabetical order, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelot.llm.common import small_batches
from wavelot.llm.pieces import slices

_LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.full(256, 32, np.uint8)  # all but letters count as a blank
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[128:] = np.arange(128, 256)
#: Odd multipliers of the filter's hash functions.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams with at most one blank, as u32, and the number of each text's grams."""
    data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter((len(d) + 3 for d in data), np.int64, len(data))
    b = _CLASS[np.frombuffer(b"   ".join([*data, b""]), np.uint8)]
    if len(b) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    x = b[:-3].astype(np.uint32)
    blank = (b[:-3] == 32).astype(np.uint8)
    for k in (1, 2, 3):
        part = b[k : len(b) - 3 + k]
        x |= part.astype(np.uint32) << np.uint32(8 * k)
        blank += part == 32
    good = blank <= 1
    ends = np.minimum(np.cumsum(sizes), len(good))
    seen = np.concatenate([[0], np.cumsum(good)])
    return x[good], np.diff(seen[np.concatenate([[0], ends])])


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray  # slots x words, one bit per language
    false_rate: np.ndarray
    fallback: int
    fallback_share: float

    def masks(self, x: np.ndarray) -> np.ndarray:
        shift = np.uint32(32 - (len(self.slots).bit_length() - 1))
        out = self.slots[(x * np.uint32(_MULTIPLIERS[0])) >> shift]
        for m in _MULTIPLIERS[1:]:
            out = out & self.slots[(x * np.uint32(m)) >> shift]
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        x, count = grams(texts)
        mask = self.masks(x)
        edges = np.concatenate([[0], np.cumsum(count)])
        share = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            word, bit = divmod(k, 8 * mask.dtype.itemsize)
            total = np.concatenate([[0], np.cumsum((mask[:, word] >> mask.dtype.type(bit)) & mask.dtype.type(1), dtype=np.int64)])
            hits = total[edges[1:]] - total[edges[:-1]]
            share[:, k] = np.clip((hits - count * self.false_rate[k]) / (1 - self.false_rate[k]), 0, None)
        best, whole = share.argmax(axis=1), share.sum(axis=1)
        out = []
        for i, t in enumerate(texts):
            if not t or not _LETTER.search(t):
                out.append(("und", 0.0))
            elif whole[i] <= 0:
                out.append((self.languages[self.fallback], self.fallback_share))
            else:
                out.append((self.languages[best[i]], float(share[i, best[i]] / whole[i])))
        return out


def build_filter(found: pd.DataFrame, rows_of: dict[str, int], bits_per_gram: int = 24) -> LanguageFilter | None:
    """found: lang, gram pairs; rows_of: labelled rows of each language."""
    languages = sorted(rows_of)
    if not languages:
        return None
    bits = max(16, int(max(1, found["gram"].nunique()) * bits_per_gram - 1).bit_length())
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    width = 8 * kind().itemsize
    slots = np.zeros((1 << bits, -(-len(languages) // width)), kind)
    for k, lang in enumerate(languages):
        x = found.loc[found["lang"] == lang, "gram"].to_numpy(np.int64).astype(np.uint32)
        for m in _MULTIPLIERS:
            slots[(x * np.uint32(m)) >> np.uint32(32 - bits), k // width] |= kind(1 << k % width)
    fill = np.array([((slots[:, k // width] >> kind(k % width)) & kind(1)).mean() for k in range(len(languages))])
    top = max(range(len(languages)), key=lambda k: rows_of[languages[k]])
    return LanguageFilter(languages, slots, np.minimum(fill ** len(_MULTIPLIERS), 0.99), top, rows_of[languages[top]] / sum(rows_of.values()))


def learn(docs: DataFrame, may_learn: Column, per_language: int = 1500, min_count: int = 3, min_share: float = 0.1) -> LanguageFilter | None:
    """Learn from docs (doc_id, text, lang) where may_learn holds and lang isn't null.

    A gram belongs to a language if it occurs min_count times there, at min_share of its rate in the language
    where its rate is highest at least.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(may_learn & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows_of = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not rows_of:
        return None
    wanted = F.create_map(*[F.lit(x) for k, n in rows_of.items() for x in (k, min(1.0, per_language / n))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) < wanted[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                text = own["text"].tolist()
                for a, b in slices(text):
                    gram, n = np.unique(grams(text[a:b])[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n})

    seen = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # distinct grams of a sample of bounded size
    grid = seen.where(F.col("n") >= min_count).toPandas()
    grid["rate"] = grid["n"] / grid.groupby("lang")["n"].transform("sum")
    keep = grid["rate"] >= min_share * grid.groupby("gram")["rate"].transform("max")
    return build_filter(grid.loc[keep, ["lang", "gram"]], rows_of)


def predict(docs: DataFrame, model: LanguageFilter | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots: bounded by the learning sample

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            text, rows = batch.tolist(), []
            for a, b in slices(text):
                rows += m.judge(text[a:b]) if m else [("und", 0.0)] * (b - a)
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), judge(F.col(text_col).cast("string")).alias("v")).select("doc_id", "v.*")
