"""Repeated-substring removal by column-wise construction of a collection's suffix order.

A 200-byte string that starts at two places is found exactly, within and across documents:

1. Anchors. In each 200-byte window the leftmost smallest k-byte gram (by hash) is the window's anchor. Equal windows have
   equal anchors at equal distances, so all copies of a window meet at one gram. Grams that start at one place only are dropped.
2. Columns. Around each other anchor a fragment of at most 2 * 200 - k bytes holds every window anchored there. The fragments of
   one gram line up at it. They are the collection: each round inserts one symbol per fragment, from the last column to the first.
   A round sorts stably by the inserted symbol, which is the Burrows-Wheeler symbol of the suffixes before it, and updates
   the common prefixes of neighbours: the minimum over the old neighbours between them, or nothing where the symbols differ.
   A window is repeated if a neighbour's common prefix reaches 200 bytes. Columns and prefixes are read and written in sequence, many
   grams at a time; Spark's external sort brings the fragments in order of their gram.
3. Hot grams, those with more than most_fragments places, never meet in one task. Their windows are dealt out by hashes: first runs of
   windows, where equal runs collapse to one before they go on, then single windows counted with map-side combining.

The classic form inserts a symbol of each whole document per round, as many rounds as the longest document has bytes, each
rewriting the whole transform; anchored fragments bound the rounds by 2 * 200 - k and keep the result.

Defined results: null texts are empty; texts under 200 bytes lose nothing; rows that repeat a text lose it wholly, if long enough.
Each row with the same text gets the same result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelot.llm.common import giving_back, scratch
from wavelot.llm.hashing import SYMBOL, mix
from wavelot.llm.sieve import sift

_BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, by joining runs whose lengths are powers of two."""
    run, size, out, done = SYMBOL[b], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = run, size
            else:
                n = len(b) - done - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + run[done : done + n]
                done += size
        size *= 2
        if size > k:
            return mix(out)
        half = size // 2
        run = run[: len(run) - half] * np.uint64(pow(_BASE, half, 1 << 64)) + run[half:]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that make up at most 2^20 bytes: number of the text, place in it, hash of the gram."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    b = np.frombuffer(b"".join(data), np.uint8)
    if len(b) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(b, k)
    place = np.uint64((1 << 20) - 1)
    low = _sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), length - k + 1)
    ends = np.cumsum(sizes)
    inside = np.repeat(ends, sizes)[: len(low)] - np.arange(len(low)) >= length
    at = np.flatnonzero(np.bincount((low[inside] & place).astype(np.int64), minlength=1))
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - sizes)[text], h[at]


def _portions(keys: list[int], data: list[bytes], length: int, most: int = 1 << 18):
    """Lists of (key, place of the portion in its text, portion) of at most `most` bytes; long texts in portions that overlap by length - 1."""
    held, size = [], 0
    for key, d in zip(keys, data, strict=True):
        if d is None or len(d) < length:
            continue
        for s in range(0, len(d) - length + 1, most - length + 1):
            part = d[s : s + most]
            if size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((key, s, part))
            size += len(part)
    if held:
        yield held


def repeated_windows(matrix: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which windows of which fragments are repeated in their group.

    matrix: columns x fragments, one symbol each, fragments in order of their group. Returns windows x fragments.
    """
    columns, n = matrix.shape
    order = np.arange(n)
    first = np.concatenate([[True], group[1:] != group[:-1]])
    # differs[i]: the first column where fragments order[i - 1] and order[i] differ; -1 across groups
    differs = np.where(first, -1, columns).astype(np.int64)
    base = (np.cumsum(first) - 1) * 512
    found = np.zeros((columns - length + 1, n), bool)
    for j in range(columns - 1, -1, -1):
        key = base + matrix[j][order]  # base follows the order: a group's fragments keep their places
        if (key[1:] >= key[:-1]).all():
            differs = np.where(np.concatenate([[False], key[1:] != key[:-1]]) & (differs >= 0), j, differs)
        else:
            to = np.argsort(key, kind="stable")
            a, b = to[:-1], to[1:]
            new = np.empty(n, np.int64)
            new[0] = -1
            new[1:] = differs[b]
            far = np.flatnonzero((b != a + 1) & (key[a] == key[b]))
            if len(far):
                edges = np.stack([a[far] + 1, b[far] + 1], axis=1).reshape(-1)
                new[1 + far] = np.minimum.reduceat(np.append(differs, -1), edges)[::2]
            same_group = base[a] == base[b]
            new[1:] = np.where(key[a] == key[b], new[1:], np.where(same_group, j, -1))
            order, differs = order[to], new
        if j < len(found):
            hit = differs - j >= length
            hit[:-1] |= hit[1:].copy() if n > 1 else False
            found[j, order] = hit
    return found


def repeated_in_fragments(pdf: pd.DataFrame, length: int, k: int, slab: int = 1024) -> pd.DataFrame:
    """pdf: gram, key, at, lead, data of fragments in order of their gram. Returns key, a, b of the repeated runs. A gram may have very many fragments,
    so besides its symbols and its windows, 2 and 1 bytes each, nothing is as large as the matrix: it is filled and read `slab` fragments at a time."""
    pdf = pdf.drop_duplicates(["gram", "key", "at"])  # a text's row may come more than once
    gram = pdf["gram"].to_numpy()
    alone = np.concatenate([[True], gram[1:] != gram[:-1]]) & np.concatenate([gram[1:] != gram[:-1], [True]])
    pdf = pdf[~alone]
    if not len(pdf):
        return pd.DataFrame({"key": [], "a": [], "b": []}, dtype=np.int64)
    data, reach = pdf["data"].tolist(), length - k
    size = np.fromiter(map(len, data), np.int64, len(data))
    width, begin = 2 * length - k, reach - pdf["lead"].to_numpy()
    matrix = np.full((width, len(data)), 256, np.uint16)
    for s in range(0, len(data), slab):
        own = size[s : s + slab]
        row = np.repeat(np.arange(len(own)), own)
        symbols = np.full((len(own), width), 256, np.uint16)
        symbols[row, np.arange(len(row)) - np.repeat(np.cumsum(own) - own - begin[s : s + slab], own)] = np.frombuffer(b"".join(data[s : s + slab]), np.uint8)
        matrix[:, s : s + slab] = symbols.T
    found = repeated_windows(matrix, pdf["gram"].to_numpy(), length)
    key, zero, window, out = pdf["key"].to_numpy(), pdf["at"].to_numpy() - reach, np.arange(len(found)), []
    for s in range(0, len(data), slab):
        first, last = (x[s : s + slab, None] for x in (begin, begin + size - length))
        hit = found[:, s : s + slab].T & (window >= first) & (window <= last)
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (r, a), b = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
        out.append(pd.DataFrame({"key": key[s + r], "a": zero[s + r] + a, "b": zero[s + r] + b - 1 + length}))
    return pd.concat(out, ignore_index=True)


def _spans(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), stop.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(rows: DataFrame, length: int = 200, k: int = 40, most_fragments: int = 100_000) -> DataFrame:
    """rows: key (long), data (binary); equal texts must have equal keys. Returns key and spans, array<struct<a, b>>, for
    each key with repeated bytes; repeats by equal keys aren't looked for."""
    spark, reach = rows.sparkSession, length - k

    @giving_back
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for held in _portions(pdf["key"].tolist(), pdf["data"].tolist(), length):
                text, at, h = anchors([x[2] for x in held], length, k)
                yield pd.DataFrame({"key": np.array([x[0] for x in held], np.int64)[text], "at": np.array([x[1] for x in held], np.int64)[text] + at, "gram": h.view(np.int64)})

    path = scratch(spark, "anchors")
    rows.mapInPandas(find, "key long, at long, gram long").write.parquet(path)
    found = spark.read.parquet(path)
    place = F.xxhash64("key", "at")  # copies of a text share their places
    often = found.groupBy("gram").agg(F.count("*").alias("n"), F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("gram", (F.col("n") > most_fragments).alias("hot"))
    path = scratch(spark, "grams")
    often.write.parquet(path)
    often = spark.read.parquet(path)
    path = scratch(spark, "places")
    again = sift(found, "gram", often.select("gram")).join(often, "gram")
    again.groupBy("key").agg(F.collect_set(F.struct("at", "gram", "hot")).alias("places")).write.parquet(path)
    wanted = spark.read.parquet(path)
    with_places = sift(rows, "key", wanted.select("key")).join(wanted, "key")

    @giving_back
    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen, out = set(), []
            for key, data, places in zip(pdf["key"].tolist(), pdf["data"], pdf["places"], strict=True):
                if key in seen:
                    continue
                seen.add(key)
                for p in places:
                    at = p["at"]
                    if not p["hot"]:
                        a = max(0, at - reach)
                        out.append((p["gram"], key, at, at - a, data[a : at + length]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["gram", "key", "at", "lead", "data"])
                    out = []
            yield pd.DataFrame(out, columns=["gram", "key", "at", "lead", "data"])

    @giving_back
    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if len(rest) < 20_000:
                continue
            gram = rest["gram"].to_numpy()
            cut_at = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
            if cut_at:
                yield repeated_in_fragments(rest.iloc[:cut_at], length, k)
                rest = rest.iloc[cut_at:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield repeated_in_fragments(rest, length, k)

    cold = with_places.mapInPandas(fragments, "gram long, key long, at long, lead int, data binary")
    spans = cold.repartition("gram").sortWithinPartitions("gram").mapInPandas(columns, "key long, a long, b long")
    if often.where("hot").limit(1).count():
        hot = wanted.select("key", F.filter("places", lambda p: p["hot"]).alias("places")).where(F.size("places") > 0)
        spans = spans.unionByName(_hot_spans(rows, hot, length, reach))
    return spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))


def _hot_spans(rows: DataFrame, hot: DataFrame, length: int, reach: int, run: int = 16) -> DataFrame:
    """Spans of windows anchored at hot grams, without bringing a gram's fragments together.

    A run of windows is known by its bytes (whole) and by the bytes that all its windows share (core). Runs with equal bytes are
    repeated as they are; where one core has several different runs, one of each is taken apart into windows, which are counted.
    """

    def digest(x: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)

    @giving_back
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["core", "whole", "key", "a", "b"]
        for pdf in batches:
            out = []
            for key, data, places in zip(pdf["key"].tolist(), pdf["data"], pdf["places"], strict=True):
                for p in places:
                    # runs start at fixed distances from the anchor, so equal windows lie in equal runs
                    for far in range(reach, -1, -run):
                        a, b = p["at"] - far, min(p["at"], p["at"] - far + run - 1) + length
                        if a >= 0 and b <= len(data):
                            out.append((digest(data[b - length : a + length]), hashlib.blake2b(data[a:b], digest_size=16).digest(), key, a, b))
                        else:  # at a text's edge: windows one by one
                            for s in range(max(a, 0), min(b, len(data)) - length + 1):
                                out.append((None, hashlib.blake2b(data[s : s + length], digest_size=16).digest(), key, s, s + length))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names).astype({"core": "Int64"})
                    out = []
            yield pd.DataFrame(out, columns=names).astype({"core": "Int64"})

    spark = rows.sparkSession
    path = scratch(spark, "runs")
    sift(rows, "key", hot.select("key")).join(hot, "key").mapInPandas(runs, "core long, whole binary, key long, a long, b long").write.parquet(path)
    found = spark.read.parquet(path).withColumn("place", F.xxhash64("key", "a", "b"))
    by_run = found.where("core is not null").groupBy("core", "whole").agg(F.min("place").alias("x"), F.max("place").alias("y"), F.min_by(F.struct("key", "a", "b"), "place").alias("one"))
    equal = found.join(by_run.where("x != y").select("core", "whole"), ["core", "whole"]).select("key", "a", "b")
    mixed = by_run.groupBy("core").agg(F.min("whole").alias("u"), F.max("whole").alias("v")).where("u != v").select("core")
    edges = found.where("core is null").select("whole", "key", "a", F.lit(True).alias("own"))
    # one of each different run stands for its equals, whose windows are all repeated already
    apart = by_run.join(mixed, "core").select("one.*", (F.col("x") == F.col("y")).alias("own"))
    # edge windows must also meet the windows inside runs
    lone = by_run.join(mixed, "core", "left_anti").select("one.*", (F.col("x") == F.col("y")).alias("own"))
    path = scratch(spark, "mixed")
    apart.unionByName(lone).distinct().write.parquet(path)
    windows = spark.read.parquet(path)

    @giving_back
    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, data, a, b, own in zip(pdf["key"].tolist(), pdf["data"], pdf["a"].tolist(), pdf["b"].tolist(), pdf["own"].tolist(), strict=True):
                out += [(hashlib.blake2b(data[s : s + length], digest_size=16).digest(), key, s, own) for s in range(a, b - length + 1)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["whole", "key", "a", "own"])
                    out = []
            yield pd.DataFrame(out, columns=["whole", "key", "a", "own"])

    texts = sift(rows, "key", windows.select("key")).select("key", "data")
    # copies of a text come along; they count as one place
    taken = texts.join(windows, "key").mapInPandas(single, "whole binary, key long, a long, own boolean").unionByName(edges)
    place = F.xxhash64("key", "a")
    twice = taken.groupBy("whole").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max(~F.col("own")).alias("copied")).where("x != y or copied").select("whole")
    return equal.unionByName(taken.where("own").join(twice, "whole").select("key", "a", (F.col("a") + length).alias("b")))


def remove_repeats(docs: DataFrame, length: int = 200, k: int = 40, id_col: str = "doc_id", text_col: str = "text", most_fragments: int = 100_000, digest_only: bool = False) -> DataFrame:
    """docs with text_col reduced to the bytes that no repeated string covers (broken characters at the cuts are dropped).

    digest_only: instead doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the exact remaining bytes.
    """
    # the caller's columns travel in one struct, whatever their names
    own = F.struct(F.col(id_col).cast("long").alias("doc_id")) if digest_only else F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(own.alias("own"), data.alias("data")).withColumn("key", F.xxhash64("data"))
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "spans")
    copies = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    repeated_spans(rows.select("key", "data"), length, k, most_fragments).join(copies, "key", "full_outer").write.parquet(path)
    found = spark.read.parquet(path)
    maybe = sift(rows, "key", found.select("key"), keep=True)
    changed = maybe.where("sifted").join(found, "key", "left").select("own", "data", "spans", (F.col("n") > 1).alias("copied"))
    same = maybe.where("not sifted").select("own", "data", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"), F.lit(False).alias("copied"))
    joined = changed.unionByName(same)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    @giving_back
    def apply(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for datas, spanss, copieds in batches:
            out = []
            for d, s, c in zip(datas, spanss, copieds, strict=True):
                if c is True and len(d) >= length:
                    runs = [(0, len(d))]
                elif s is not None and len(s):
                    runs = _spans(np.array([x["a"] for x in s]), np.array([x["b"] for x in s]))
                else:
                    runs = []
                kept = d
                if runs:
                    ends = [0, *[e for x in runs for e in x], len(d)]
                    kept = b"".join(d[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((len(d), len(d) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digest_only else None, None if digest_only else kept.decode("utf-8", "ignore")))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = joined.select("own", apply("data", "spans", "copied").alias("r"))
    if digest_only:
        return done.select("own.doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256")
    # a null text stays null
    return done.select(*[(F.when(F.col("own").getField(c).isNotNull(), F.col("r.kept")).alias(c) if c == text_col else F.col("own").getField(c).alias(c)) for c in docs.columns])
