import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from wavelot.llm.suffixes import remove_repeats, repeated_in_fragments


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if often[d[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(d, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    passages = ["".join(word() for _ in range(rnd.randint(length // 5, length))) for _ in range(6)]
    texts = [None, "", "short", "a" * (3 * length), "ab" * length, "b" * (length - 1), "c" * length]
    for _ in range(n):
        parts = ["".join(word() for _ in range(rnd.randint(1, 60)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            parts.append(p[a : rnd.randint(a, len(p))])
            parts.append(word())
        rnd.shuffle(parts)
        texts.append("".join(parts))
    return texts + texts[:12]


@pytest.mark.parametrize(("seed", "length", "k", "most"), [(1, 40, 8, 1000), (2, 40, 8, 2), (3, 60, 20, 3), (4, 200, 40, 30_000)])
def test_matches_brute_force(spark, seed, length, k, most):
    texts = corpus(seed, length)
    rows = [(i % 70 if i else None, t, "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = remove_repeats(docs, length, k, most_fragments=most, digest_only=True)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted((-1 if i is None else i, *b) for (i, _, _), b in zip(rows, brute(texts, length), strict=True))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want


def test_documents_keep_their_columns(spark):
    shared = "the quick brown fox jumps over it " * 8
    docs = spark.createDataFrame([(1, "é1 " + shared, "a"), (2, shared + "é2", "b"), (3, None, None)], "doc_id long, text string, key string")
    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert remove_repeats(docs).columns == docs.columns
    assert (got[1]["key"], got[3]["text"], got[3]["key"]) == ("a", None, None)
    assert got[1]["text"].strip() == "é1" and got[2]["text"].endswith("é2")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs, digest_only=True).count() == 0


def test_memory_of_a_gram_with_many_fragments():
    length, k, n = 200, 40, 20_000
    rnd = np.random.default_rng(5)
    around = rnd.integers(97, 123, (n, 2 * length - k), dtype=np.uint8)
    around[:, length - k : length] = 65  # the gram
    around[1::2] = around[::2]  # each pair of fragments is equal
    data = [x.tobytes() for x in around]
    pdf = pd.DataFrame({"gram": 7, "key": np.arange(n), "at": length - k, "lead": length - k, "data": data})
    tracemalloc.start()
    got = repeated_in_fragments(pdf, length, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got.itertuples(index=False, name=None)) == [(i, 0, 2 * length - k) for i in range(n)]
    assert peak < 5 * around.size  # index arrays of the whole matrix alone would be 8 bytes a place
