"""Connected groups of linked items, as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelot.llm.common import cut, giving_back, scratch, thin
from wavelot.llm.sieve import sift_lists


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns node and component, its smallest node, for every node with an edge to another.

    Alternating large-star and small-star rounds: each points a node's neighbours to the smallest among them, until
    nothing changes. A round's rows never exceed the edges; links stay in Spark throughout.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, before = cut(pairs), None
    n = pairs.count()
    pairs = thin(pairs, n)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = thin(thin(large, n).distinct(), n)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b")
        pairs = cut(thin(thin(small, n).distinct(), n))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def star_pairs(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """held: id, keys (array<long>, the buckets it is in; rows may repeat). Returns each id with its bucket's smallest id (a > b, each pair once), at
    most as many pairs as rows, and bucket, id, b (its smallest id) of the crowded buckets, those with three rows or more, whose other pairs nobody has
    looked at yet."""
    shapes = held.select("id", F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.min("id").alias("b"), F.max("id").alias("a"), F.count("*").alias("n")).where("a != b")
    path = scratch(held.sparkSession, "shapes")
    shapes.write.parquet(path)
    shapes = held.sparkSession.read.parquet(path)
    full = shapes.where("n > 2").select("bucket", "b")
    # most buckets hold one id; the sieve keeps their rows out of the join
    crowded = cut(sift_lists(held, full.select("bucket")).distinct().join(full, "bucket").select("bucket", "id", "b"))
    crowded = thin(crowded, crowded.count())
    pairs = shapes.where("n = 2").select("a", "b").unionByName(crowded.where("id != b").select(F.col("id").alias("a"), "b"))
    return pairs.distinct(), crowded


def packed_star_pairs(held: DataFrame, n_keys: int, per_part: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """The same as star_pairs where nearly every bucket holds one id: buckets travel as arrays instead of as rows. n_keys: about how many keys there are; from it
    follow the ranges of buckets, about per_part keys each, that are sorted at once. Bucket and id take 16 bytes. Crowded buckets have three different ids or more."""
    parts = max(1, -(-n_keys // per_part))
    width = np.uint64((1 << 64) // parts if parts > 1 else (1 << 64) - 1)

    def once(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both in order of the key, repeats of (key, id) left out, and which keys are another row's too."""
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        twin = np.append(key[1:] == key[:-1], False)
        twin[1:] |= twin[:-1].copy()
        some = np.flatnonzero(twin)
        by = np.lexsort((ids[some], key[some]))
        ids[some] = ids[some[by]]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        return key[fresh], ids[fresh], twin[fresh]

    @giving_back
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            key, of, _ = once(np.concatenate(keys), np.concatenate(ids))
            part = (key // width).astype(np.int32)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(key)]
            data = [key[x:y].tobytes() + of[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array(data, pa.binary())], ["part", "data"])

        for batch in batches:
            lists = batch.column("keys")
            keys.append(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            ids.append(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            if sum(map(len, keys)) >= 1 << 20:
                yield packed()
                keys, ids = [], []
        if sum(map(len, keys)):
            yield packed()

    def shared(data: list[bytes]) -> pa.RecordBatch:
        halves = [(np.frombuffer(d, np.uint64, len(d) // 16), np.frombuffer(d, np.int64, offset=len(d) // 2)) for d in data]
        key, ids, twin = once(*(np.concatenate(x) for x in zip(*halves, strict=True)))
        key, ids = key[twin], ids[twin]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        n = np.diff(np.append(first, len(key)))
        least, n = np.repeat(ids[first], n), np.repeat(n, n)
        some = n > 1
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key.view(np.int64), ids, least, n)], ["bucket", "id", "b", "n"])

    @giving_back
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data = None, []
        for batch in batches:
            for part, d in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if part != now and data:
                    yield shared(data)
                    data = []
                now = part
                data.append(d)
        if data:
            yield shared(data)

    path = scratch(held.sparkSession, "shapes")
    dealt = held.select("id", "keys").mapInArrow(pack, "part int, data binary").repartition("part").sortWithinPartitions("part")
    dealt.mapInArrow(unpack, "bucket long, id long, b long, n long").write.parquet(path)
    rows = held.sparkSession.read.parquet(path)
    crowded = cut(rows.where("n > 2").select("bucket", "id", "b"))
    crowded = thin(crowded, crowded.count())
    return rows.where("id != b").select(F.col("id").alias("a"), "b").distinct(), crowded


def across_links(crowded: DataFrame, groups: DataFrame, payload: DataFrame, prepare: Callable[[pd.DataFrame], object], block: int = 4096, block_bytes: int = 8 << 20, in_bulk: bool = False) -> DataFrame:
    """Links a, b, bucket between ids that no chain of links joins yet: enough of them to join all that link.

    crowded: bucket, id, b (whose pairs with the bucket's ids are known); groups: node, component of the ids linked so far; payload: id, size (bytes) and what verifying takes. prepare(rows of a
    bucket) gives a function (row number, other row numbers) -> which of these link with it. Buckets whose ids already are one
    group drop out, so large groups of copies cost nothing here; in the others each row is compared, inside the task, with the rows of
    other groups. A bucket of more than `block` rows or `block_bytes` is dealt into blocks, each pair of blocks a task's group of its own.
    in_bulk, for many small buckets: prepare gets the rows of several buckets and gives two functions, (row numbers, row numbers) -> which pairs may link and
    how far apart each pair seems, and the same -> which of some pairs do.
    """
    grouped = crowded.join(groups, crowded["id"] == groups["node"], "left").select("bucket", "id", "b", F.coalesce("component", "id").alias("g"))
    mixed = cut(grouped.groupBy("bucket").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x != y").select("bucket"))
    grouped = grouped.join(mixed, "bucket")
    sizes = grouped.join(payload.select("id", "size"), "id").groupBy("bucket")
    sizes = sizes.agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_bytes)).cast("int").alias("blocks"))
    rows = grouped.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "b", "g").join(payload.drop("size"), "id")
    keys = ["bucket", "low", "high"]

    def whole(pdf: pd.DataFrame) -> list[tuple[int, int, int]]:
        pdf = pdf.reset_index(drop=True)
        bucket, ids, side, label = int(pdf["bucket"][0]), pdf["id"].tolist(), pdf["own"].to_numpy(), pdf["g"].to_numpy().copy()
        links_of, out, hub = prepare(pdf), [], pdf["id"].to_numpy() == pdf["b"].to_numpy()
        split = pdf["low"][0] != pdf["high"][0]
        for i in range(len(ids)):
            if split and side[i] == side.max():
                continue  # each pair of two blocks is seen from the lower block
            other = label != label[i]
            other &= (side != side[i]) if split else np.arange(len(ids)) > i
            later = np.flatnonzero(other & ~hub) if not hub[i] else np.zeros(0, np.int64)
            hits = later[links_of(i, later)] if len(later) else later
            if len(hits):
                joined, first = np.unique(label[hits], return_index=True)
                out += [(max(ids[i], ids[j]), min(ids[i], ids[j]), bucket) for j in hits[first].tolist()]
                label[np.isin(label, joined)] = label[i]
        return out

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, held = None, []
        for pdf in batches:
            held.append(pdf)
            if in_bulk and len(held) < 8:  # many pairs at a time are cheaper; Arrow batches are small
                continue
            rest, held = pd.concat([*([] if rest is None else [rest]), *held], ignore_index=True), []
            edges = np.flatnonzero((rest[keys].iloc[1:].to_numpy() != rest[keys].iloc[:-1].to_numpy()).any(axis=1)) + 1
            if len(edges):  # the last group may go on
                yield from found(rest, [0, *edges.tolist()])
                rest = rest.iloc[edges[-1] :].reset_index(drop=True)
        if held:
            rest = pd.concat([*([] if rest is None else [rest]), *held], ignore_index=True)
        if rest is not None and len(rest):
            edges = np.flatnonzero((rest[keys].iloc[1:].to_numpy() != rest[keys].iloc[:-1].to_numpy()).any(axis=1)) + 1
            yield from found(rest, [0, *edges.tolist(), len(rest)])

    def bulk(pdf: pd.DataFrame, edges: list[int]) -> list[tuple[int, int, int]]:
        n, out = edges[-1], []
        pdf = pdf.iloc[:n]
        bucket, ids, side, label = pdf["bucket"].tolist(), pdf["id"].tolist(), pdf["own"].to_numpy(), pdf["g"].to_numpy()
        split, hub = (pdf["low"] != pdf["high"]).to_numpy(), (pdf["id"] == pdf["b"]).to_numpy()
        begin = np.arange(1, n + 1)
        width = np.where(hub, 0, np.repeat(edges[1:], np.diff(edges)) - begin)
        if not width.any():
            return out
        may, sure = prepare(pdf)
        now = label.copy()  # the group of each row, kept as groups are joined
        place = np.cumsum(width) // 100_000  # about so many pairs at a time
        for chunk in np.split(np.arange(n), np.flatnonzero(np.diff(place)) + 1):
            i = np.repeat(chunk, width[chunk])
            j = np.arange(len(i)) - np.repeat(np.cumsum(width[chunk]) - width[chunk], width[chunk]) + begin[i]
            some = (now[i] != now[j]) & ~hub[j] & (~split[i] | (side[i] != side[j]))
            i, j = i[some], j[some]
            hit, gap = may(i, j)
            i, j, step = i[hit], j[hit], 512
            order = np.argsort(gap[hit], kind="stable")  # the likeliest first: what they join spares the others
            i, j = i[order], j[order]
            while len(i):
                hit = sure(i[:step], j[:step])
                for x, y in zip(*(z[:step][hit].tolist() for z in (i, j)), strict=True):
                    if now[x] != now[y]:
                        now[now == max(now[x], now[y])] = min(now[x], now[y])
                        out.append((max(ids[x], ids[y]), min(ids[x], ids[y]), bucket[x]))
                i, j, step = i[step:], j[step:], min(2 * step, 2048)
                some = now[i] != now[j]
                i, j = i[some], j[some]
        return out

    def found(pdf: pd.DataFrame, edges: list[int]) -> Iterator[pd.DataFrame]:
        out = bulk(pdf, edges) if in_bulk else [x for s, e in zip(edges, edges[1:], strict=False) if e - s > 1 for x in whole(pdf.iloc[s:e])]
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "bucket"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long, bucket long")
