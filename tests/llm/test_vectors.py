import numpy as np
import pytest

from wavelot.llm import vectors


def brute(ids, vecs, cosine=0.95):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]):
                a, b = np.array(vecs[i], float), np.array(vecs[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i].append(j)
                    links[j].append(i)
    comp, out = [-1] * n, []
    for i in range(n):
        todo = [i] if comp[i] < 0 else []
        while todo:
            k = todo.pop()
            if comp[k] < 0:
                comp[k] = i
                todo += links[k]
    low = {c: min(ids[i] for i in range(n) if comp[i] == c) for c in set(comp)}
    for i in range(n):
        out.append((ids[i], len(links[i]), low[comp[i]], ids[i] == low[comp[i]]))
    return sorted(out)


@pytest.mark.parametrize("block", [2000, 15])
def test_matches_brute_force(spark, block):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(60, 16))
    rows = [*base, *(base[0] + rnd.normal(size=(50, 16)) * 0.15), *(base[1] * 3 + rnd.normal(size=(20, 16)) * 0.3), *([base[2]] * 9)]
    rows = [r.astype(np.float32).astype(float).tolist() for r in rows]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1.0, 2.0], [2.0, 4.0], [1e-30] * 16, [float("inf")] + [1.0] * 15, [2e-30] * 16]
    ids = rnd.permutation(len(rows)).tolist()
    frame = spark.createDataFrame([(i, r, "x") for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<float>, node string")
    got = sorted(tuple(r) for r in vectors.near_vectors(frame, block=block, cluster_rows=20).collect())
    want = brute(ids, rows)
    exact = sum(g[1] for g in got) / sum(w[1] for w in want)
    assert 0.97 <= exact <= 1.0
    assert [g[2:] for g in got] == [w[2:] for w in want]
    if block == 2000:
        assert got == want


def test_range_search_finds_what_is_near():
    rnd = np.random.default_rng(5)
    m = rnd.normal(size=(800, 32))
    m[:200] = m[0] + rnd.normal(size=(200, 32)) * 0.12
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    graph = vectors.build_graph(m)
    hit = want = 0
    for i in range(300):
        true = set(np.flatnonzero(m @ m[i] >= 0.95).tolist())
        found = set(vectors.range_search(m, graph, m[i], vectors.medoid(m), 0.95, 48, 0.04).tolist())
        assert found <= true
        hit, want = hit + len(found), want + len(true)
    assert hit / want >= 0.95


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_audit_reaches_linked_nodes_and_ends_exact(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(600, 128))
    rows = [r.tolist() for r in [*base, *(base[:20] + rnd.normal(size=(20, 128)) * 0.02)]]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    report = {}
    # a first draw of about four nodes; no recall is enough, so the search ends in the exact comparison
    got = sorted(tuple(r) for r in vectors.near_vectors(frame, beam=1, slack=-1.0, audit=4, min_recall=2.0, report=report).collect())
    assert got == brute(list(range(len(rows))), rows)
    assert report["recall"] == 1.0 and report["exact"] and report["linked"] >= 40


def test_null_and_repeated_ids_and_a_vector_with_most_rows(spark):
    rnd = np.random.default_rng(9)
    base = rnd.normal(size=(30, 16))
    rows = [(i, base[0].tolist()) for i in range(100, 2600)] + [(i, v.tolist()) for i, v in enumerate(base)] + [(None, base[5].tolist()), (None, base[0].tolist()), (None, None), (3, base[3].tolist()), (50, None), (None, (base[29] * -1).tolist())]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), min_recall=2.0)
    assert got.dtypes[-1] == ("kept", "boolean")
    found = sorted(map(tuple, got.collect()), key=str)
    hot = [(i, 2501, 0, False) for i in range(100, 2600)] + [(0, 2501, 0, True), (None, 2501, 0, False)]
    rest = [(i, int(i in (3, 5)), i, True) for i in range(1, 30)] + [(3, 1, 3, True), (None, 1, 5, False), (None, 0, None, False), (50, 0, 50, True), (None, 0, None, False)]
    assert found == sorted(hot + rest, key=str)
