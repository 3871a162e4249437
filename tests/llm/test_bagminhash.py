import random
from collections import Counter

import numpy as np
import pytest

from wavelot.llm import bagminhash
from wavelot.llm.shingles import shingles


def multiset(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def groups_of(texts, ids, threshold=0.8):
    sets = [multiset(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= threshold:
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(ids))]


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    texts = [None, "", "  \n", "one two", "one  two", "one three", "x " * 40, "x " * 38]
    common = [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(20, 150))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            other = list(base)
            for _ in range(rnd.randint(0, 4)):
                other[rnd.randrange(len(other))] = word()
            texts.append("  ".join(other) + rnd.choice(["", "\n"]))
    texts += [" ".join(common + [word() for _ in range(60)]) for _ in range(20)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    docs = spark.createDataFrame([(i, t, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, id string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in bagminhash.near_copies(docs).collect()}
    want = groups_of(texts, ids)
    assert got == {i: (g, g == i) for i, g in zip(ids, want, strict=True)}
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, g in zip(ids, want, strict=True) if i == g)


def test_signature_estimates_weighted_jaccard():
    a, b = "p " * 30 + "q r s t u v", "p " * 9 + "q r s t u v w"
    text, s, w, _ = shingles([a.encode(), b.encode()])
    sig = bagminhash.signatures(text, s, w, 2, 20_000)
    assert abs((sig[0] == sig[1]).mean() - jaccard(multiset(a), multiset(b))) < 0.02


def test_similarity_of_multisets():
    one = (np.array([1, 2], np.uint64), np.array([3, 1]))
    two = (np.array([1, 5], np.uint64), np.array([1, 1]))
    assert bagminhash.similarity(one, two) == 1 / 5


def test_nulls_and_repeated_rows(spark):
    text = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text + " z"), (9, None), (9, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in bagminhash.near_copies(docs).collect())
    assert got == [(-1, 3), (3, 3), (7, 3), (7, 3), (9, 9), (9, 9)]
    assert bagminhash.keep_one(docs).count() == 3
    assert bagminhash.near_copies(docs.limit(0)).count() == 0
