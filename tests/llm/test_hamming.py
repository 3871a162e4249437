import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelot.llm import hamming
from wavelot.llm.queries import op12_multi_index


def brute(rows, asks, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if asks(i):
            near = sorted((-float(v @ q), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, node string")


def shape(rows):
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in rows)


def test_whole_radius_is_brute_force(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(-2, 3, size=(90, 8)).astype(float)  # many equal inner products
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *([base[3]] * 70), *(base[:10] * 7)])]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] * 8), (1080, [1.0, None] * 4), (1100, [1.0, 2.0]), (1101, [3.0, 1.0]), (None, [1.0] * 8), (20, rows[7][1]), (20, rows[20][1])]
    report = {}
    got = hamming.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, block=16, audit=0, report=report)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert shape(got.collect()) == shape(brute(rows, lambda i: i % 20 == 0))
    assert report["recall"] is None and report["radius"] == 128


def test_every_pair_within_the_radius_is_a_candidate_once():
    rnd = np.random.default_rng(2)
    words = rnd.integers(0, 1 << 32, (300, 4)).astype(hamming.WORD)
    words[150:] = words[:150] ^ (1 << rnd.integers(0, 32, (150, 4)).astype(hamming.WORD)) ^ (1 << rnd.integers(0, 32, (150, 4)).astype(hamming.WORD))
    import pandas as pd

    rows = pd.DataFrame({"code": [w.tobytes() for w in words], "vec": [np.ones(2).tobytes()] * 300, "ids": [np.array([i]) for i in range(300)]})
    far = hamming.differ(words[:, None], words[None])
    for radius in (0, 3, 8, 50, 61, 128):
        pairs = [p for part, share in enumerate(hamming.shares(radius, 4)) if share >= 0 for p in zip(*(x.tolist() for x in hamming.Block(rows, part, 4).candidates(words, radius)), strict=True)]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == set(zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True))


@pytest.mark.parametrize("kind", ["random", "groups"])
def test_recall_and_full_lists(spark, kind):
    rnd = np.random.default_rng(5)
    m = rnd.normal(size=(3000, 32))
    if kind == "groups":
        m[:2000] = m[rnd.integers(0, 8, 2000)] + rnd.normal(size=(2000, 32)) * 0.05
        m *= rnd.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    report = {}
    got = shape(hamming.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, block=500, report=report).collect())
    want = shape(brute(rows, lambda i: i % 20 == 0))
    assert len(got) == len(want)
    assert len(set((g[0], g[2], g[3]) for g in got) & set((w[0], w[2], w[3]) for w in want)) >= 0.93 * len(want)
    assert report["ranked"] < 0.6 and report["recall"] >= 0.93


def test_vector_with_a_third_of_the_rows_and_very_large_numbers(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(200)] + [(200 + i, rnd.normal(size=3).tolist()) for i in range(400)] + [(700, [1e200, -1e200, 1e200]), (701, [1e-200, 0.0, 0.0])]
    got = shape(hamming.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, block=64, audit=8).collect())
    with np.errstate(over="ignore"):
        want = brute(rows, lambda i: i % 20 == 0)
    assert len(got) == len(want) and {g[0] for g in got} == {w[0] for w in want}


def test_query_and_empty_table(spark, tmp_path):
    for name, rows in (("some", [(i, [float(i), 1.0]) for i in range(41)]), ("none", [])):
        frame(spark, rows).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert shape(op12_multi_index(spark, f"{tmp_path}/{name}").collect()) == shape(brute(rows, lambda i: i % 20 == 0))
