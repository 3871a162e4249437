"""Periodic runs of words: stretches that repeat themselves at least min_periods times, and the texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least max(min_words, min_periods * q) words
that no neighbouring word extends. For every lag the pairs of equal words that far apart are counted first: frequent words by an exact FFT
autocorrelation (their 0/1 series go through one inverse transform together), rare words by the differences of their places. A run of
period q has as many such pairs as words less q, so only lags with enough pairs get an island scan, which finds the maximal stretches.
Pairs inside a run of period d are also pairs at each multiple of d; they are taken off those lags' counts. None of them lies in a run whose
smallest period is the multiple, so nothing is lost, and a text that is one word over and over needs one scan.

Each text is read whole in the task that holds its row; nothing is shuffled. Memory is a few numbers per word of one text.

Defined results: a null or blank text has no words, no runs and an empty collapsed text. Repeated rows are judged one by one, a null doc_id
stays null, and other columns of the caller, whatever their names, aren't read. Runs may overlap; they come ordered by start, then period.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelot.llm.common import texts

FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def lag_counts(codes: np.ndarray, most: int) -> np.ndarray:
    """For each lag 0 .. most (0 is left at 0): how many pairs of equal words lie that far apart."""
    n, freq = len(codes), np.bincount(codes)
    size = 1 << (n + most).bit_length()
    bar = max(16, int(0.2 * np.sqrt(size * np.log2(size))))  # where a word's pairs cost more than its transform
    total = np.zeros(most + 1, np.int64)
    heavy = np.flatnonzero(freq > bar)
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for w in heavy.tolist():
            f = np.fft.rfft(codes == w, size)
            power += f.real**2 + f.imag**2
        total += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    at = np.argsort(codes, kind="stable")
    at = at[freq[codes[at]] <= bar]
    word, first, step, held = codes[at], np.arange(len(at)), 0, []
    while len(first):  # pairs of a place with the step-th next one of its word
        step += 1
        first = first[first + step < len(at)]
        lag = at[first + step] - at[first]
        near = (word[first + step] == word[first]) & (lag <= most)
        first = first[near]
        held.append(lag[near])
        if not len(first) or sum(map(len, held)) > 1 << 20:
            total += np.bincount(np.concatenate(held), minlength=most + 1)
            held = []
    total[0] = 0
    return total


def islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of True with at least so many."""
    edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
    start, length = edges[::2], edges[1::2] - edges[::2]
    return start[length >= least], length[length >= least]


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def find_runs(codes: np.ndarray, min_words: int = 6, min_periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a series of word numbers (0 .. some of them), by start, then period."""
    n, out = len(codes), []
    if n < min_words:
        return out
    most = n // min_periods
    lags = np.arange(most + 1)
    need = np.maximum(np.maximum(min_words - lags, (min_periods - 1) * lags), 1)
    left = lag_counts(codes, most)
    for p in np.flatnonzero(left >= need).tolist():
        if p == 0 or left[p] < need[p]:
            continue
        k = min_periods - 1
        if p >= 8 and k >= 2:  # a run covers k points of a grid p apart, each equal to the next
            same = codes[p::p] == codes[: n - p : p]
            hit = same[: len(same) - k + 1].copy()
            for i in range(1, k):
                hit &= same[i : len(same) - k + 1 + i]
            if not hit.any():
                continue
        primes = prime_factors(p)
        for s, length in zip(*(x.tolist() for x in islands(codes[:-p] == codes[p:], int(need[p]))), strict=True):
            length += p
            # two periods of a stretch that long: the shorter one divides the longer
            if not any((codes[s : s + length - p // r] == codes[s + p // r : s + length]).all() for r in primes):
                out.append((s, length, p))
                again = np.arange(2 * p, min(length - 1, most) + 1, p)
                left[again] -= length - again
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic_runs(docs: DataFrame, min_words: int = 6, min_periods: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, runs (start and length in words from 0, and period) and collapsed (UTF-8), the words outside of any run's repeats joined by a space:
    of a run only the first period stays. min_periods: 2 or more."""
    if min_periods < 2:
        raise ValueError("min_periods must be 2 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, collapsed = [], []
            for text in batch.column("text").to_pylist():
                words = text.split() if text else []  # bytes split at 0x20 and 0x09 .. 0x0D
                number = defaultdict(count().__next__)
                runs = find_runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), min_words, min_periods)
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, length, p in runs:
                        gone[s + p] += 1
                        gone[s + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                found.append([{"start": s, "length": length, "period": p} for s, length, p in runs])
                collapsed.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind), pa.array(collapsed, pa.binary())], ["doc_id", "runs", "collapsed"])

    return texts(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, FOUND)


def run_digest(found: DataFrame) -> DataFrame:
    """Per row of periodic_runs: doc_id, n_runs, the longest run (ties: smallest start, then period) and its exponent, hashes of all runs and of the text left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the text of every document whose crc32(doc_id as text) is divisible by 10 ends in repeats of some of its own words.

    With g the crc32 divided by 10 and n words, from word a = g % n on word i becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    Rows without a doc_id or without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = texts(docs).withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    rows = rows.withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
