"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors become one node with a multiplicity. Leaders, picked from a bounded sample so that no two are closer than leader_cosine,
make clusters; each node goes to its `overlap` nearest ones, and clusters are dealt into blocks of bounded size. Each block builds a
flat graph: a pool of near neighbours per node, robust pruning, reverse edges, and an edge into every part that the medoid can't
reach. The adjacency lists of a node from all its shards are united. Then each node searches the blocks of its nearest
cluster: greedy from the medoid with a beam, and once it is in range, expanding every node in range (less a slack) until no neighbour is new.
Links are verified in double precision. Recall is audited against brute force: nodes are drawn, eight times as many each time, until
`audit_links` of them have links, all nodes are drawn or `most_audited` are. It is the mean over the nodes with links of the share
of their links found, so a dense group weighs no more than its nodes. Below min_recall the search is done again with twice the overlap and beam; where every
node already meets every leader, blocks are compared exactly instead. `report`, if given, receives recall (None if no drawn node has a link), drawn, linked and exact.

Links between nodes of one home cluster are counted where they are found, and only a spanning forest of them leaves the task, so
a dense group isn't expanded into rows; links between home clusters are rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component. Vectors of
different lengths never link. Repeated rows count as vectors of their own, and of those with the smallest vec_id of a component each is kept; a row whose vec_id is null
can link and is never kept. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelot.llm.common import cut, join_hot, scratch
from wavelot.llm.links import components

FOUND = "kind int, a long, b long, x long, y long"
OWN, ACROSS, FOREST = 0, 1, 2


def unit_rows(vecs: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def pick_leaders(m: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """Rows of m in order, as long as none is closer to an earlier leader than cosine."""
    leaders = m[:0]
    for row in m:
        if len(leaders) >= most:
            break
        if not len(leaders) or (leaders @ row).max() < cosine:
            leaders = np.vstack([leaders, row])
    return leaders


def build_graph(m: np.ndarray, pool: int = 48, degree: int = 24, alpha: float = 1.2) -> list[np.ndarray]:
    """Neighbour lists of a robust-pruned graph in which the medoid reaches every row."""
    n = len(m)
    if n == 1:
        return [np.zeros(0, np.int64)]
    k = min(pool, n - 1)
    near, close = np.empty((n, k), np.int64), np.empty((n, k))
    for s in range(0, n, 512):
        sim = m[s : s + 512] @ m.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -2
        part = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(sim, part, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near[s : s + 512], close[s : s + 512] = np.take_along_axis(part, order, axis=1), np.take_along_axis(own, order, axis=1)
    links: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        ids, far = near[i], 1 - close[i]
        between = 1 - m[ids] @ m[ids].T
        alive = np.ones(k, bool)
        for j in range(k):
            if alive[j]:
                links[i].add(int(ids[j]))
                links[int(ids[j])].add(i)
                if len(links[i]) >= degree:
                    break
                alive &= alpha * between[j] > far
    seen = np.zeros(n, bool)
    todo = [medoid(m)]
    seen[todo[0]] = True
    while True:
        while todo:
            for j in links[todo.pop()]:
                if not seen[j]:
                    seen[j] = True
                    todo.append(j)
        left = np.flatnonzero(~seen)
        if not len(left):
            return [np.array(sorted(x), np.int64) for x in links]
        i = int(left[0])
        reached = np.flatnonzero(seen)
        j = int(reached[(m[reached] @ m[i]).argmax()])
        links[i].add(j)
        links[j].add(i)
        seen[i] = True
        todo = [i]


def medoid(m: np.ndarray) -> int:
    return int((m @ m.mean(axis=0)).argmax())


def range_search(m: np.ndarray, links: list[np.ndarray], q: np.ndarray, start: int, cosine: float, beam: int, slack: float) -> np.ndarray:
    """Rows of m at cosine or more from q: greedy from start, then every row in range is expanded."""
    sim = np.full(len(m), -2.0)
    sim[start] = m[start] @ q
    done = np.zeros(len(m), bool)
    queue, best = [(-sim[start], start)], [sim[start]]
    while queue:
        s, i = heapq.heappop(queue)
        if len(best) >= beam and -s < best[0]:
            break
        done[i] = True
        if -s >= cosine - slack:
            break  # in range: from here all of it
        fresh = links[i][sim[links[i]] == -2.0]
        if len(fresh):
            sim[fresh] = m[fresh] @ q
            for j, t in zip(fresh.tolist(), sim[fresh].tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, t)
                elif t > best[0]:
                    heapq.heapreplace(best, t)
                else:
                    continue
                heapq.heappush(queue, (-t, j))
    done[:] = False
    while True:
        wave = np.flatnonzero((sim >= cosine - slack) & ~done)
        if not len(wave):
            return np.flatnonzero(sim >= cosine)
        done[wave] = True
        fresh = np.unique(np.concatenate([links[i] for i in wave]))
        fresh = fresh[sim[fresh] == -2.0]
        sim[fresh] = m[fresh] @ q


def _nodes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Per row: vec_id, node (64 bits of the vector's md5; null if it can't link), vec (f64 bytes), dim."""

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for v in batch:
                a = None if v is None else np.asarray(v, np.float64) + 0.0  # -0 becomes 0
                out.append(a.tobytes() if a is not None and a.size and np.isfinite(a).all() and a.any() else None)
            yield pd.Series(out, dtype=object)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), pack(F.col(vec_col).cast("array<double>")).alias("vec"))
    node = F.conv(F.substring(F.md5("vec"), 1, 16), 16, -10).cast("long")
    return rows.select("vec_id", node.alias("node"), "vec", (F.octet_length("vec") / 8).cast("int").alias("dim"))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 8192, cluster_rows: int = 1000, most_clusters: int = 2048, leader_cosine: float = 0.9, overlap: int = 3, block: int = 2000, beam: int = 48, slack: float = 0.04, audit: int = 128, min_recall: float = 0.95, audit_links: int = 64, most_audited: int = 8192, report: dict | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. sample bounds the rows that leaders are picked from, audit the first draw of audited nodes."""
    rows = cut(_nodes(vectors, id_col, vec_col))
    nodes = cut(rows.where("node is not null").groupBy("node", "dim").agg(F.count("*").alias("mult"), F.first("vec").alias("vec")))
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}  # one row per vector length
    total = sum(sizes.values())
    by_hash = F.pmod(F.xxhash64("node", F.lit("leader")), F.lit(1 << 30))
    drawn: dict[int, list[bytes]] = {}
    for r in nodes.where(by_hash < int(min(1.0, sample / max(1, total)) * (1 << 30))).select("node", "dim", "vec").collect():
        drawn.setdefault(r["dim"], []).append((r["node"], bytes(r["vec"])))
    leaders = {}
    for dim, own in drawn.items():
        m = unit_rows([v for _, v in sorted(own)])
        leaders[dim] = pick_leaders(m, max(1, min(most_clusters, sizes[dim] // cluster_rows)), leader_cosine)
    truth, drawn_nodes, most = {}, 0, min(total, most_audited)
    by_audit, below, draw = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)), 0, audit
    while below < 1 << 30 and total:
        share = min(1.0, draw / total)
        upto = 1 << 30 if share == 1.0 else int(share * (1 << 30))
        audited = [(r["node"], r["dim"], bytes(r["vec"])) for r in nodes.where((by_audit >= below) & (by_audit < upto)).select("node", "dim", "vec").collect()]
        truth |= {k: v for k, v in _brute(nodes, audited, cosine).items() if v}
        drawn_nodes, below = drawn_nodes + len(audited), upto
        if len(truth) >= audit_links or draw >= most:
            break
        draw = min(8 * draw, most)
    exact = False
    while True:
        found = _search(nodes, leaders, cosine, overlap, block, beam, slack, exact)
        counts = found.where(f"kind = {OWN}").select(F.col("a").alias("node"), F.col("x").alias("n"))
        across = found.where(f"kind = {ACROSS}").distinct()
        counts = counts.unionByName(across.select(F.col("a").alias("node"), F.col("y").alias("n"))).unionByName(across.select(F.col("b").alias("node"), F.col("x").alias("n")))
        counts = cut(counts.groupBy("node").agg(F.sum("n").alias("others")))
        got = {r["node"]: r["others"] for r in counts.where(F.col("node").isin(list(truth))).collect()} if truth else {}
        recall = sum(min(got.get(k, 0), v) / v for k, v in truth.items()) / len(truth) if truth else None
        if recall is None or recall >= min_recall or exact:
            break
        exact = overlap >= max([1, *map(len, leaders.values())])
        overlap, beam = 2 * overlap, 2 * beam
    if report is not None:
        report.update(recall=recall, drawn=drawn_nodes, linked=len(truth), exact=exact)
    groups = components(found.where(f"kind != {OWN}").select("a", "b"))
    # one row for each node and component; a vector or group that holds a third of the rows meets its row by broadcast
    known = cut(nodes.select("node", "mult").join(counts, "node", "left").join(groups, "node", "left"))
    known = known.select("node", F.coalesce("component", "node").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"))
    named = cut(join_hot(rows.where("node is not null").select("vec_id", "node"), known, "node").drop("node"))
    lowest = cut(named.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_hot(named, lowest, "component").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _brute(nodes: DataFrame, audited: list[tuple[int, int, bytes]], cosine: float) -> dict[int, int]:
    """Links of the audited nodes, counted with multiplicities against all nodes."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {d for _, d, _ in audited}:
            own = [(n, v) for n, d, v in audited if d == dim]
            by_dim[dim] = np.array([n for n, _ in own]), unit_rows([v for _, v in own])
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                if dim in by_dim:
                    ids, q = by_dim[dim]
                    m, n = unit_rows(own["vec"].tolist()).T, []
                    for s in range(0, len(ids), 256):
                        hit = (q[s : s + 256] @ m >= cosine) & (ids[s : s + 256, None] != own["node"].to_numpy()[None, :])
                        n.append(hit @ own["mult"].to_numpy())
                    n = np.concatenate(n)
                    yield pd.DataFrame({"node": ids[n > 0], "n": n[n > 0]})

    if not audited:
        return {}
    return {r["node"]: r["n"] for r in nodes.mapInPandas(scan, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}


def _search(nodes: DataFrame, leaders: dict[int, np.ndarray], cosine: float, overlap: int, block: int, beam: int, slack: float, exact: bool) -> DataFrame:
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(leaders)  # at most most_clusters vectors

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                lead = shared.value.get(dim)
                if lead is None:  # no node of this length was drawn
                    best = np.zeros((len(own), 1), np.int64)
                else:
                    k = min(overlap, len(lead))
                    best = np.argsort(-(unit_rows(own["vec"].tolist()) @ lead.T), axis=1, kind="stable")[:, :k]
                for k in range(best.shape[1]):
                    yield own.assign(cluster=best[:, k], home=k == 0)

    path = scratch(spark, "shards")
    nodes.mapInPandas(assign, "node long, dim int, mult long, vec binary, cluster int, home boolean").write.parquet(path)
    placed = spark.read.parquet(path)
    sizes = placed.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = placed.join(sizes, ["dim", "cluster"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[x] for x in build_graph(unit_rows(pdf["vec"].tolist()))]})

    lists = placed.groupBy("dim", "cluster", "block").applyInPandas(build, "node long, near array<long>")
    united = cut(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))

    # a block meets every block of its cluster, itself included, once
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.join(united, "node").select("*", other.alias("o")).withColumns({"low": F.least("block", "o"), "high": F.greatest("block", "o")})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, mult, home, at = (pdf[c].to_numpy() for c in ("node", "mult", "home", "block"))
        m = unit_rows(pdf["vec"].tolist())
        place = {int(n): i for i, n in enumerate(ids)}
        hits: list[tuple[int, np.ndarray]] = []
        sides = np.unique(at)
        for target in sides:
            rows = np.flatnonzero(at == target)
            inside = np.full(len(ids), -1)
            inside[rows] = np.arange(len(rows))
            links = []
            for i in rows:
                near = np.array([place[x] for x in pdf["near"][i].tolist() if x in place], np.int64)
                near = inside[near] if len(near) else near
                links.append(near[near >= 0])
            own = m[rows]
            start = medoid(own)
            for i in np.flatnonzero(home & ((at != target) if len(sides) > 1 else True)):
                found = rows[np.flatnonzero(own @ m[i] >= cosine) if exact else range_search(own, links, m[i], start, cosine, beam, slack)]
                hits.append((i, found[found != i]))
        a = np.concatenate([np.full(len(x), i) for i, x in hits] + [np.zeros(0, np.int64)]).astype(np.int64)
        b = np.concatenate([x for _, x in hits] + [np.zeros(0, np.int64)]).astype(np.int64)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        both = home[pair[:, 0]] & home[pair[:, 1]]
        inner, outer = pair[both], pair[~both]
        count = np.bincount(inner[:, 0], mult[inner[:, 1]], len(ids)) + np.bincount(inner[:, 1], mult[inner[:, 0]], len(ids))
        parent = np.arange(len(ids))
        forest = []
        for i, j in inner.tolist():
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            while parent[j] != j:
                parent[j] = j = parent[parent[j]]
            if i != j:
                parent[max(i, j)] = min(i, j)
                forest.append((i, j))
        forest = np.array(forest, np.int64).reshape(-1, 2)
        some = np.flatnonzero(count)
        z = lambda n: np.zeros(n, np.int64)
        return pd.DataFrame({
            "kind": np.concatenate([np.full(len(some), OWN), np.full(len(outer), ACROSS), np.full(len(forest), FOREST)]),
            "a": np.concatenate([ids[some], ids[outer[:, 0]], ids[forest[:, 0]]]),
            "b": np.concatenate([ids[some], ids[outer[:, 1]], ids[forest[:, 1]]]),
            "x": np.concatenate([count[some].astype(np.int64), mult[outer[:, 0]], z(len(forest))]),
            "y": np.concatenate([z(len(some)), mult[outer[:, 1]], z(len(forest))]),
        })

    path = scratch(spark, "links")
    met.groupBy("dim", "cluster", "low", "high").applyInPandas(search, FOUND).write.parquet(path)
    return spark.read.parquet(path)
