"""Toxicity by the nearest labelled examples.

Examples are a bounded, class-balanced sample of labelled rows, as TF-IDF vectors over every term that occurs in one of them. Document
frequencies are counted over all documents. A term's idf is scaled by how surely it tells the classes apart in the sample, (chi2 + 1) / (chi2 +
certain), so that topic words don't drown the words that matter; no term is dropped. The examples sit in a block-max inverted index: posting
lists by term, cut into blocks of examples, with each block's largest weight. A query's bound for a block is the sum over its terms; the blocks with
the highest bounds are scored exactly, then all whose bounds reach the k-th best cosine found. Votes are weighted by closeness and by how
many labelled rows an example stands for, then calibrated by isotonic regression on leave-one-out votes of the examples themselves.

Defined results: a text with no term of any example (empty and null texts too) has no neighbours and gets the toxic rate of examples without
terms. Ties in cosine go to the smaller example number. Repeated rows are scored one by one; very long texts whole, memory
following their number of different words. Of several labels of one doc_id the largest counts. Where each class has a single distinct
vector, leave-one-out votes find no neighbour and every score is the toxic rate. Without labels every score is 0. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelot.llm.common import small_batches

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start .. end - 1, one range after the other."""
    size = end - start
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


class BlockMaxIndex:
    """Exact cosine search over sparse unit vectors, given as (terms, weights) of each example."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, size: int = 32):
        self.n, self.size = len(rows), size
        term = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in rows]]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *[w for _, w in rows]])
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in rows])
        order = np.argsort(term, kind="stable")  # examples stay in order within a term
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        block = self.example // size
        self.start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])[: len(term)])
        self.end = np.append(self.start[1:], len(term))[: len(self.start)]
        self.block = block[self.start]
        self.most = np.maximum.reduceat(self.weight, self.start) if len(term) else np.zeros(0)
        self.of_term = np.searchsorted(term[self.start], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a positive cosine; skip: one that doesn't count."""
        first, last = self.of_term[terms], self.of_term[terms + 1]
        piece, own = _ranges(first, last), np.repeat(weights, last - first)
        bound = np.bincount(self.block[piece], self.most[piece] * own, -(-self.n // self.size))
        cos, seen, worst = np.zeros(self.n), np.zeros(len(bound), bool), 0.0
        wave = np.argsort(-bound, kind="stable")[: max(8, -(-2 * k // self.size))]
        while len(wave):
            new = np.zeros(len(bound), bool)
            new[wave] = True
            some = new[self.block[piece]]
            a, b = self.start[piece[some]], self.end[piece[some]]
            at = _ranges(a, b)
            cos += np.bincount(self.example[at], self.weight[at] * np.repeat(own[some], b - a), self.n)
            seen |= new
            if skip >= 0:
                cos[skip] = 0.0
            worst = np.partition(cos, self.n - k)[self.n - k] if self.n > k else 0.0
            wave = np.flatnonzero(~seen & (bound > 0) & (bound >= worst - 1e-9))
        found = np.flatnonzero((cos > 0) & (cos >= worst - 1e-9))
        found = found[np.lexsort((found, -np.round(cos[found], 12)))[:k]]
        return found, cos[found]


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    toxic: np.ndarray  # share of toxic rows among those an example stands for
    weight: np.ndarray  # labelled rows an example stands for
    source: np.ndarray  # doc_id of one of them
    prior: float
    without_terms: float
    k: int = 15
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        count = Counter(map(self.vocabulary.get, words(text)))
        count.pop(None, None)
        return unit(count, self.idf)

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        found, cos = self.index.nearest(terms, weights, self.k, skip)
        if not len(found):
            return self.prior, found, cos
        w = self.weight[found] * cos**2 / (1.02 - np.minimum(cos, 1))
        return float((w @ self.toxic[found] + self.prior) / (w.sum() + 1)), found, cos

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        terms, weights = self.vector(text)
        if not len(terms):
            return self.without_terms, np.zeros(0, np.int64), np.zeros(0)
        vote, found, cos = self.vote(terms, weights)
        if self.steps is not None and len(found):
            vote = float(np.interp(vote, *self.steps))
        return min(1.0, max(0.0, vote)), found, cos


def unit(count: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(count)
    terms, times = np.fromiter(count.keys(), np.int64, n), np.fromiter(count.values(), np.float64, n)
    order = np.argsort(terms)
    terms = terms[order]
    w = (1 + np.log(times[order])) * idf[terms]
    return terms, w / np.sqrt(w @ w) if n else w


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: means of x and y of the pooled steps."""
    steps: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        steps.append([w[i] * x[i], w[i] * y[i], w[i]])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            a = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], a, strict=True)]
    s = np.array(steps)
    return s[:, 0] / s[:, 2], s[:, 1] / s[:, 2]


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 800, certain: float = 100.0, k: int = 15) -> ToxicityModel | None:
    """docs: doc_id, text; labels: doc_id, toxic. may_learn: a column on doc_id.

    per_class bounds the sample of each class, in the mean: rows are chosen by a hash of doc_id.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_of = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not n_of:
        return None
    rate = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, n_of.get(1, 0)))).otherwise(min(1.0, per_class / max(1, n_of.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1_000_000)) < rate * 1_000_000)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = [Counter(words(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "terms": [list(c) for c in counts], "counts": [list(c.values()) for c in counts]})

    # at most about 2 * per_class ids and rows
    sample = plain.join(F.broadcast(chosen), "doc_id").mapInPandas(count, "doc_id long, toxic int, terms array<string>, counts array<int>")
    seen = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["terms"]))
    if not seen:
        return None
    vocabulary: dict[str, int] = {}
    with_term: dict[int, list[int]] = {0: [], 1: []}
    bags = []
    for r in seen:
        own = [vocabulary.setdefault(t, len(vocabulary)) for t in r["terms"]]
        with_term[r["toxic"]] += own
        bags.append(Counter(dict(zip(own, r["counts"], strict=True))))
    n_terms = len(vocabulary)
    n1 = sum(r["toxic"] for r in seen)
    n0, n = len(seen) - n1, len(seen)
    a, b = (np.bincount(np.array(with_term[c], np.int64), minlength=n_terms).astype(float) for c in (1, 0))
    chi2 = n * (a * n0 - b * n1) ** 2 / (max(1, n1 * n0) * (a + b) * (n - a - b + 1e-9))
    shared = spark.sparkContext.broadcast(vocabulary)  # the terms of the bounded sample

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, rows = shared.value, 0
        found = np.zeros(len(v), np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                found[[v[w] for w in set(words(t)) if w in v]] += 1
            rows += len(pdf)
        term = np.flatnonzero(found)
        yield pd.DataFrame({"term": np.append(term, -1), "n": np.append(found[term], rows)})

    df = np.zeros(n_terms + 1, np.int64)  # the last one, -1: all documents
    for r in plain.select("text").mapInPandas(frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * (chi2 + 1) / (chi2 + certain)
    each = {1: n_of.get(1, 0) / max(1, n1), 0: n_of.get(0, 0) / max(1, n0)}  # labelled rows per sampled row
    groups: dict[tuple, list[float]] = {}
    for r, bag in zip(seen, bags, strict=True):
        g = groups.setdefault(tuple(sorted(bag.items())), [0.0, 0.0, r["doc_id"]])
        g[0] += each[r["toxic"]] * r["toxic"]
        g[1] += each[r["toxic"]]
        g[2] = min(g[2], r["doc_id"])
    empty = groups.pop((), [0.0, 0.0, 0])
    prior = n_of.get(1, 0) / sum(n_of.values())
    # examples with the same commonest word, so mostly of one language, lie together: their blocks' bounds are tight
    keys = sorted(groups, key=lambda g: (max((c, -t) for t, c in g)[1], g))
    rows = [unit(Counter(dict(g)), idf) for g in keys]
    weight = np.array([groups[x][1] for x in keys])
    toxic = np.array([groups[x][0] for x in keys]) / np.maximum(weight, 1e-9)
    model = ToxicityModel(vocabulary, idf, BlockMaxIndex(rows, n_terms), toxic, weight, np.array([groups[x][2] for x in keys], np.int64), prior, (empty[0] + prior) / (empty[1] + 1), k)
    if len(keys) > 1:
        held = spark.sparkContext.broadcast((model, rows))

        def leave_one_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, own = held.value
            for pdf in batches:
                yield pd.DataFrame({"id": pdf["id"], "vote": [m.vote(*own[i], skip=i)[0] for i in pdf["id"].tolist()]})

        votes = spark.range(0, len(keys), 1, -(-len(keys) // 200)).mapInPandas(leave_one_out, "id long, vote double").collect()
        loo = np.zeros(len(keys))
        for r in votes:
            loo[r["id"]] = r["vote"]
        model.steps = isotonic(loo, toxic, weight)
    return model


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score, predicted, and as evidence the doc_ids and cosines of its nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class

    @F.pandas_udf("score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows = []
            for text in batch:
                s, found, cos = m.score(text) if m else (0.0, [], [])
                rows.append((s, int(s >= 0.5), m.source[found].tolist() if m else [], list(map(float, cos))))
            yield pd.DataFrame(rows, columns=["score", "predicted", "evidence_ids", "evidence_cosines"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), judge(F.col(text_col).cast("string")).alias("v")).select("doc_id", "v.*")
