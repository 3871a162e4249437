import hashlib
import re
import zlib

import numpy as np
import pytest

from wavelot.llm import runs
from wavelot.llm.queries import op13_periodic_runs


def brute(words, min_words=6, min_periods=4):
    n, out = len(words), set()
    for p in range(1, n):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            length = e - s + p
            if e > s and length >= max(min_words, min_periods * p):
                shorter = any(all(words[i] == words[i + d] for i in range(s, s + length - d)) for d in range(1, p))
                if not shorter:
                    out.add((s, length, p))
            s = e + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 12])
def test_runs_match_brute_force(letters):
    rnd = np.random.default_rng(letters)
    for _ in range(120):
        parts = []
        for _ in range(rnd.integers(1, 5)):
            part = rnd.integers(0, letters, rnd.integers(1, 9))
            parts.append(np.tile(part, rnd.integers(1, 8))[: rnd.integers(1, 60)])
        codes = np.concatenate(parts)
        assert runs.find_runs(codes) == brute(codes.tolist())
        assert runs.find_runs(codes, 2, 2) == brute(codes.tolist(), 2, 2)


def test_frequent_and_rare_words_are_counted_alike():
    rnd = np.random.default_rng(7)
    codes = np.minimum(rnd.zipf(1.3, 3000), 900) - 1
    got = runs.lag_counts(codes, 750)
    assert got[1:].tolist() == [int((codes[p:] == codes[:-p]).sum()) for p in range(1, 751)]
    freq = np.bincount(codes)
    assert (freq > 200).any() and (freq == 1).any()  # both ways took part


def test_one_word_over_and_over_and_long_texts():
    assert runs.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    block = np.random.default_rng(1).permutation(20_000)
    codes = np.concatenate([np.arange(20_000, 20_050), np.tile(block, 5)[:90_000]])
    assert runs.find_runs(codes) == [(50, 90_000, 20_000)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    left = [w for i, w in enumerate(words) if not any(s + p <= i < s + length for s, length, p in found)]
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(left)))


def test_query_matches_brute_force(spark, tmp_path):
    rnd = np.random.default_rng(3)
    words = ["ab", "c", "dé", "漢字", "x y", "u v", "\x1cq"]
    texts = [None, "", " \n\t ", "a a a a a", "a a a a a a", "a b\va b\fa b\ra\tb  c", "go " * 40 + "stop " * 9, "one two three " * 30]
    for _ in range(250):
        part = rnd.choice(words, rnd.integers(1, 12))
        texts.append(" ".join([*rnd.choice(words, rnd.integers(0, 30)), *np.tile(part, rnd.integers(1, 7)), *rnd.choice(words, rnd.integers(0, 9))]))
    rows = [(i, t, "r", [1]) for i, t in enumerate(texts)] + [(None, "b b b b b b b", "r", None), (9, texts[9], "r", None), (9, texts[9], "r", None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, words array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got.collect())) == sorted(key(expected(r[0], r[1])) for r in rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert runs.run_digest(runs.periodic_runs(runs.with_planted_runs(none))).count() == 0
