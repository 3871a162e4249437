"""Nearest vectors by largest inner product, through multi-index hashing of learned binary codes.

Every vector is lifted by one coordinate to the length of the longest one, so that the largest inner product becomes the smallest distance. Rotations
learned on a bounded sample (principal axes, then alternating signs and orthogonal fits) turn it into a code of `bits` signs; a rotation has as many
bits as axes, and further rotations from other starts fill the code. A code is split into `parts` substrings, and a vector stands in the bucket of each.
If two codes differ in `radius` bits at most, one of their substrings differs in that substring's share at most (pigeonhole), so probing each substring's
buckets within its share finds every code within the radius; the whole code is then compared, each pair in the first substring that finds it, and what
is left is ranked by inner products of the original vectors in double precision.

The buckets of a substring are dealt out by its leading bits, of which there are more the more vectors there are; a query goes only where these differ in the
substring's share at most. Crowded prefixes are split into blocks of bounded size, and the queries stream past a block, so a task holds one block. A query
first meets the buckets under its own prefixes; from others only what reaches its k-th best of there goes on.

The radius is what covers `cover` of the true neighbours of `audit` drawn queries (brute force over all vectors). A query with fewer
than k found gets a wider radius until it has them; at `bits` all vectors are met. Recall is measured on as many other drawn queries; below
min_recall all queries are searched again with a wider radius. `report`, if given, receives recall, radius, rounds and the share of pairs ranked.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id. Vectors of
different lengths never meet. Equal vectors are one item that holds its smallest k + 1 ids; ties go to the smaller id. Repeated rows count as
rows of their own: a query leaves out itself once. Inner products that overflow are infinite, those that aren't numbers count as minus infinity. Other columns of the
caller aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavelot.llm.common import cut

ITEMS = "node binary, dim int, vec binary, ids array<long>, code binary"
WORD = np.uint32


def matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)


def log_norm(m: np.ndarray) -> np.ndarray:
    """Logarithms of the rows' lengths, without overflow."""
    top = np.abs(m).max(axis=1)
    return np.log(top) + np.log(np.sqrt(((m / top[:, None]) ** 2).sum(axis=1)))


def lifted(m: np.ndarray, longest: float) -> np.ndarray:
    """Rows divided by exp(longest), with the coordinate that makes their length 1."""
    unit = m / np.abs(m).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    size = np.exp(np.minimum(log_norm(m) - longest, 0.0))[:, None]
    return np.hstack([unit * size, np.sqrt(np.maximum(0.0, 1 - size * size))])


def learn_rotations(y: np.ndarray, bits: int, steps: int = 25, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (axes x bits) whose signs are the codes."""
    centre = y.mean(axis=0)
    _, axes = np.linalg.eigh((y - centre).T @ (y - centre))
    axes = axes[:, ::-1][:, :bits]
    v, rnd, made = (y - centre) @ axes, np.random.default_rng(seed), []
    while sum(x.shape[1] for x in made) < bits:
        turn = np.linalg.qr(rnd.normal(size=(axes.shape[1], axes.shape[1])))[0]
        for _ in range(steps):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
            turn = u @ w
        made.append(axes @ turn)
    return centre, np.hstack(made)[:, :bits]


def codes(y: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None, bits: int) -> np.ndarray:
    """Codes as rows of 32-bit words, the first bit leading; zeros without a model."""
    if model is None:
        return np.zeros((len(y), bits // 32), WORD)
    signs = (y - model[0]) @ model[1] >= 0
    return np.packbits(signs, axis=1).view(">u4").astype(WORD)


def word_rows(code: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(code), WORD).reshape(len(code), -1)


def shares(radius: int, parts: int) -> list[int]:
    """How far each substring may differ, so that codes within the radius meet in one at least; -1: needn't be probed."""
    a, more = divmod(radius, parts)
    return [a if j <= more else a - 1 for j in range(parts)]


def part_values(words: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Substring `part` of each code, as a row of words."""
    wide = words.shape[1] // parts
    return words[:, part * wide : (part + 1) * wide]


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of words differ; leading axes broadcast."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def best(scores: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller low, largest first."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(at) - k)[len(at) - k])
    return at[np.lexsort((low[at], -scores[at]))][:k]


def products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        scores = m @ q
    return np.where(np.isnan(scores), -np.inf, scores)


def _expanded(scores: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of items that hold several ids each."""
    each = np.repeat(scores, list(map(len, ids)))
    flat = np.concatenate(ids)
    at = best(each, flat, k)
    return each[at], flat[at]


class Block:
    """The buckets of one substring over a block of codes."""

    def __init__(self, rows: pd.DataFrame, part: int, parts: int):
        self.part, self.parts = part, parts
        self.words, self.vec = word_rows(rows["code"].tolist()), matrix(rows["vec"].tolist())
        self.ids = rows["ids"].tolist()
        self.low = np.array([x[0] for x in self.ids])
        self.value, bucket, self.size = np.unique(part_values(self.words, part, parts), axis=0, return_inverse=True, return_counts=True)
        self.rows, self.begin = np.argsort(bucket.reshape(-1), kind="stable"), np.cumsum(self.size) - self.size

    def candidates(self, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every pair within the radius that this substring is the first to find, by query."""
        share = shares(radius, self.parts)
        q, b = np.nonzero(differ(part_values(words, self.part, self.parts)[:, None], self.value[None]) <= share[self.part])
        n = self.size[b]
        q = np.repeat(q, n)
        row = self.rows[np.repeat(self.begin[b] - (np.cumsum(n) - n), n) + np.arange(len(q))]
        total = np.zeros(len(q), np.int32)
        for part in range(self.parts):
            apart = differ(part_values(words, part, self.parts)[q], part_values(self.words, part, self.parts)[row])
            total += apart
            if part < self.part:
                fresh = apart > share[part]
                q, row, total = q[fresh], row[fresh], total[fresh]
        near = total <= radius
        return q[near], row[near]


def _rows(vectors: DataFrame, id_col: str, vec_col: str, query: Column) -> DataFrame:
    """vec_id, asks (whether it is a query), node (128 bits of the vector), vec (f64 bytes) and long (logarithm of its length) of the rows that take part."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], []
            for v in pdf["vec"]:
                a = None if v is None else np.asarray(v, np.float64) + 0.0  # -0 becomes 0
                ok = a is not None and a.size and np.isfinite(a).all() and a.any()
                out.append(a.tobytes() if ok else None)
                size.append(log_norm(a[None])[0] if ok else 0.0)
            pdf = pdf.assign(vec=out, long=size)
            yield pdf[pdf["vec"].notna()]

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("asks"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where("vec_id is not null and vec is not null").mapInPandas(pack, "vec_id long, asks boolean, vec binary, long double")
    return rows.withColumn("node", F.unhex(F.md5("vec")))


def nearest(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = 128, parts: int = 4, sample: int = 8192, block: int = 8192, audit: int = 64, cover: float = 0.98, min_recall: float = 0.93, report: dict | None = None) -> DataFrame:
    """For each row where query holds, its k nearest other rows: query_id, rank (from 1), vec_id, score.

    query: a condition over the caller's columns; bits: a multiple of 32 * parts; sample: rows that rotations are learned on; block: codes a task holds;
    audit: queries that the radius is taken from, and as many others that recall is measured on."""
    spark, keep = vectors.sparkSession, k + 1
    rows = cut(_rows(vectors, id_col, vec_col, query))
    size = rows.agg(F.count("*").alias("n"), F.max("long").alias("longest")).first()
    longest = size["longest"] or 0.0
    first = rows.withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("at") <= keep)
    merged = cut(first.groupBy("node").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", (F.octet_length("vec") / 8).cast("int")))
    total = merged.count()

    draw = lambda df, salt, n, of: df.where(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, n / max(1, of)) * (1 << 30)))
    drawn: dict[int, list] = {}
    for r in draw(merged, "rotations", sample, total).select("node", "dim", "vec").collect():
        drawn.setdefault(r["dim"], []).append((bytes(r["node"]), bytes(r["vec"])))
    models = {dim: learn_rotations(lifted(matrix([v for _, v in sorted(own)]), longest), bits) for dim, own in drawn.items()}
    shared = spark.sparkContext.broadcast(models)  # bits x length numbers for each vector length in the sample

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                words = codes(lifted(matrix(own["vec"].tolist()), longest), shared.value.get(dim), bits)
                yield own.assign(code=[w.tobytes() for w in words])

    items = cut(merged.select("node", "dim", "vec", "ids").mapInPandas(encode, ITEMS))
    per_dim = rows.groupBy((F.octet_length("vec") / 8).cast("int").alias("dim")).agg(F.count("*").alias("rows"))
    queries = rows.where("asks").select("node").distinct().join(items, "node").select("node", "dim", "vec", "code")
    queries = cut(queries)
    n_queries = queries.count()
    pick = draw(queries, "audit", 2 * audit, n_queries).collect()
    pick = [(bytes(r["node"]), r["dim"], bytes(r["vec"]), bytes(r["code"])) for r in sorted(pick, key=lambda r: bytes(r["node"]))]
    truth = _brute(items, pick, keep)
    learn, check = [p[0] for p in pick[::2]], [p[0] for p in pick[1::2]]
    apart = sorted(d for q in learn for _, d in truth.get(q, []))
    radius = apart[min(len(apart) - 1, int(cover * len(apart)))] if apart else bits

    rounds, ranked = 0, 0
    while True:
        todo, near, done = queries, radius, None
        while True:  # wider for those with fewer than k found
            rounds += 1
            found, pairs = _probe(items, todo, total, n_queries, bits, parts, near, block, keep)
            ranked += pairs
            by_query = W.partitionBy("node").orderBy(F.desc("score"), "vec_id")
            top = found.withColumn("at", F.row_number().over(by_query)).where(F.col("at") <= keep)
            top = cut(top.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("best")))
            if near >= bits:
                short = None
            else:
                has = todo.join(per_dim, "dim").join(top, "node", "left").where(F.coalesce(F.size("best"), F.lit(0)) < F.least(F.lit(keep), F.col("rows")))
                short = cut(has.select("node", "dim", "vec", "code"))
                if short.isEmpty():
                    short = None
            whole = top if short is None else top.join(short, "node", "left_anti")
            done = whole if done is None else done.unionByName(whole)
            if short is None:
                break
            todo, near = short, min(bits, near + bits // 8)
        got = {bytes(r["node"]): {x["vec_id"] for x in r["best"]} for r in done.where(F.col("node").isin([bytearray(c) for c in check])).collect()} if check else {}
        share = [len({i for i, _ in truth[q]} & got.get(q, set())) / len(truth[q]) for q in check if truth.get(q)]
        recall = sum(share) / len(share) if share else None
        if recall is None or recall >= min_recall or radius >= bits:
            break
        radius = min(bits, radius + bits // 32)
    if report is not None:
        report.update(recall=recall, radius=radius, rounds=rounds, ranked=ranked / max(1, total * n_queries))
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "node").join(done, "node")
    own = F.array_position(F.transform("best", lambda x: x["vec_id"]), F.col("query_id"))
    others = asked.withColumn("own", own).select("query_id", F.posexplode(F.slice(F.filter("best", lambda x, i: i + 1 != F.col("own")), 1, k)).alias("at", "x"))
    return others.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.down")).alias("score"))


def _brute(items: DataFrame, queries: list[tuple[bytes, int, bytes, bytes]], keep: int) -> dict[bytes, list[tuple[int, int]]]:
    """For each query its true nearest rows: (vec_id, bits that differ)."""
    if not queries:
        return {}
    shared = items.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                asked = [(n, q) for n, q in enumerate(shared.value) if q[1] == dim]
                m, ids, words = matrix(own["vec"].tolist()), own["ids"].tolist(), word_rows(own["code"].tolist())
                low = np.array([x[0] for x in ids])
                for n, (_, _, vec, code) in asked:
                    scores = products(m, np.frombuffer(vec, np.float64))
                    at = best(scores, low, keep)
                    apart = differ(words[at], np.frombuffer(code, WORD)[None])
                    some = [ids[i] for i in at.tolist()]
                    yield pd.DataFrame({"q": n, "vec_id": np.concatenate(some), "score": np.repeat(scores[at], list(map(len, some))), "apart": np.repeat(apart, list(map(len, some)))})

    found = items.mapInPandas(scan, "q int, vec_id long, score double, apart int")
    at = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    out: dict[bytes, list[tuple[int, int]]] = {}
    for r in found.withColumn("at", at).where(F.col("at") <= keep).collect():  # keep rows for each drawn query
        out.setdefault(queries[r["q"]][0], []).append((r["vec_id"], r["apart"]))
    return out


def _probe(items: DataFrame, queries: DataFrame, total: int, n_queries: int, bits: int, parts: int, radius: int, block: int, keep: int) -> tuple[DataFrame, int]:
    """node (a query), vec_id, score: of each block that a query meets the best `keep` rows that reach what it has found at home; and how many pairs were ranked."""
    lead = max(0, min(16, int(np.ceil(np.log2(max(1, total) / block)))))  # leading bits that deal a substring's buckets out
    share, wide = shares(radius, parts), bits // 32 // parts
    turns = max(1, -(-n_queries // 65536))  # queries past one block in one task

    def prefixes(code: list[bytes], part: int) -> np.ndarray:
        return (word_rows(code)[:, part * wide].astype(np.int64) >> (32 - lead)).astype(np.int32)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in range(parts):
                if share[part] >= 0:
                    yield pdf.assign(part=part, prefix=prefixes(pdf["code"].tolist(), part))

    placed = items.mapInPandas(place, f"{ITEMS}, part int, prefix int")
    sizes = cut(placed.groupBy("dim", "part", "prefix").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    groups = (sizes.agg(F.sum("blocks")).first()[0] or 0) * turns
    where = ["dim", "part", "prefix"]
    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))
    held = placed.join(sizes, where).select(*where, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), turn.alias("turn"), F.lit(0).alias("kind"), "node", "vec", "code", "ids", F.lit(0.0).alias("bound"))
    keys = [*where, "block", "turn"]
    met = items.sparkSession.sparkContext.accumulator(0)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, buckets = None, [], None
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf[[*keys, "kind"]].to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            for a, b in zip(edges, edges[1:], strict=False):
                if now != tuple(key[a, :-1]):
                    now, rows, buckets = tuple(key[a, :-1]), [], None
                own = pdf.iloc[a:b]
                if key[a, -1] == 0:
                    rows.append(own[["vec", "code", "ids"]])
                elif rows or buckets is not None:
                    if buckets is None:
                        buckets, rows = Block(pd.concat(rows, ignore_index=True), int(key[a, 1]), parts), []
                    for s in range(0, len(own), step := max(1, 2_000_000 // len(buckets.value))):
                        yield from ranked(buckets, own.iloc[s : s + step])

    def ranked(buckets: Block, own: pd.DataFrame) -> Iterator[pd.DataFrame]:
        q, row = buckets.candidates(word_rows(own["code"].tolist()), radius)
        met.add(len(q))
        vec, nodes, bound, out = matrix(own["vec"].tolist()), own["node"].tolist(), own["bound"].tolist(), []
        edges = np.searchsorted(q, np.arange(len(own) + 1))
        for i in range(len(own)):
            if edges[i] < edges[i + 1]:
                at = row[edges[i] : edges[i + 1]]
                scores = products(buckets.vec[at], vec[i])
                if bound[i] > -np.inf:
                    at, scores = at[scores >= bound[i]], scores[scores >= bound[i]]
                    if not len(at):
                        continue
                top = best(scores, buckets.low[at], keep)
                score, ids = _expanded(scores[top], [buckets.ids[j] for j in at[top].tolist()], keep)
                out.append(pd.DataFrame({"node": [nodes[i]] * len(ids), "vec_id": ids, "score": score}))
        if out:
            yield pd.concat(out, ignore_index=True)

    def meet(some: DataFrame, masks: np.ndarray) -> DataFrame:
        """some: queries with bound. Probes the prefixes that differ from theirs by one of the masks."""

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part in range(parts):
                    near = masks[np.bitwise_count(masks) <= share[part]] if share[part] >= 0 else masks[:0]
                    for s in range(0, len(pdf) if len(near) else 0, step := max(1, 100_000 // max(1, len(near)))):
                        own = pdf.iloc[s : s + step]
                        yield own.loc[own.index.repeat(len(near))].assign(part=part, prefix=(prefixes(own["code"].tolist(), part)[:, None] ^ near[None]).reshape(-1))

        asked = some.select("node", "dim", "vec", "code", "bound").mapInPandas(ask, "node binary, dim int, vec binary, code binary, bound double, part int, prefix int").join(sizes, where)
        asked = asked.select(*where, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit("turn")), F.lit(turns)).cast("int").alias("turn"), F.lit(1).alias("kind"), "node", "vec", "code", F.array().cast("array<long>").alias("ids"), "bound")
        dealt = held.unionByName(asked).repartition(max(1, min(groups, 20_000)), *keys).sortWithinPartitions(*keys, "kind")
        return cut(dealt.mapInPandas(search, "node binary, vec_id long, score double"))

    masks, least = np.arange(1 << lead, dtype=np.int32), F.lit(float("-inf"))
    found = meet(queries.withColumn("bound", least), masks[:1])
    if lead:
        at = F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "vec_id"))
        reach = found.withColumn("at", at).where(F.col("at") == keep).select("node", F.col("score").alias("bound"))
        found = found.unionByName(meet(queries.join(reach, "node", "left").withColumn("bound", F.coalesce("bound", least)), masks[1:]))
    return found, met.value
