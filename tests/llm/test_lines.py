import random
import time
from collections import Counter

import numpy as np
import pytest

from wavelot.llm import lines
from wavelot.llm.lines import LONG, alike, apart, banded_distances, drop_lines, edit_distance, edit_similarity, line_report, normal_form, pair_profile, simhashes
from wavelot.llm.links import packed_star_pairs, star_pairs


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abé") for _ in range(rnd.randint(0, 80))) for _ in range(2))
        assert edit_distance(a, b) == plain_distance(a, b)


def test_many_distances_at_once():
    rnd = random.Random(2)
    for size in (0, 1, 12, 60):
        a = [" ".join("".join(rnd.choice("abé😀") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, size // 3))) for _ in range(120)]
        b = ["".join(c if rnd.random() < 0.9 else rnd.choice(["", "b", "cc"]) for c in x) if rnd.random() < 0.8 else rnd.choice(a) for x in a]
        want = np.array([plain_distance(x, y) for x, y in zip(a, b, strict=True)])
        at = np.arange(len(a))
        assert (apart(pair_profile(a), at, pair_profile(b), at) <= 4 * want).all()
        for most in (0, 1, 4, 40):
            got = banded_distances(a, b, most)
            assert (np.where(want <= most, got, want) == want).all() and (got[want > most] > most).all()
            assert (alike(a, b, np.full(len(a), most)) == (want <= most)).all()
    long = "abcd efg " * LONG
    assert alike([long, long], [long.replace("b", "x", 3), long[::-1]], np.array([5, 5])).tolist() == [True, False]


def brute(docs):
    """docs: (doc_id, text) with distinct ids in order. Line numbers that go."""
    found = [(d, k, normal_form(x)) for d, t in docs for k, x in enumerate((t or "").split("\n")) if x.strip()]
    forms = sorted({f for _, _, f in found})
    sims = [int(s) for s in simhashes([f.encode() for f in forms])]
    parent = list(range(len(forms)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(forms)):
        for j in range(i):
            if (sims[i] ^ sims[j]).bit_count() <= 3 and edit_similarity(forms[i], forms[j]) >= 0.8:
                parent[root(i)] = root(j)
    group = {f: root(i) for i, f in enumerate(forms)}
    seen, gone = set(), {d: [] for d, _ in docs}
    for d, k, f in found:
        if group[f] in seen:
            gone[d].append(k)
        seen.add(group[f])
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    pool = [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    docs = [(0, None), (1, ""), (2, "\n \n--\n--"), (3, "Hello,  World\nhello world!")]
    for d in range(4, 90):
        own = []
        for _ in range(rnd.randint(1, 6)):
            line = rnd.choice(pool) if rnd.random() < 0.6 else " ".join(word() for _ in range(30))
            if rnd.random() < 0.6:
                parts = line.split(" ")
                parts[rnd.randrange(len(parts))] = word()
                line = " ".join(parts)
            own.append(line.upper() if rnd.random() < 0.2 else line)
        docs.append((d, "\n".join(own)))
    frame = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, line string")
    want = brute(docs)
    assert sum(map(len, want.values())) > 50
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed_lines"]) for r in line_report(frame).collect()}
    assert got == {d: (sum(1 for x in (t or "").split("\n") if x.strip()), len(want[d]), want[d]) for d, t in docs}
    left = drop_lines(frame)
    assert left.columns == frame.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts == {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]) for d, t in docs}


def test_null_ids_repeats_and_empty(spark):
    frame = spark.createDataFrame([(None, "same line here"), (1, "same line here\nother"), (1, "same line here\nother")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_report(frame).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert line_report(frame.limit(0)).count() == 0
    assert lines._blocks(10**9, 3)[1] >= 2


@pytest.mark.parametrize("seed", [3, 4])
def test_links_by_edit_similarity_alone(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 10)))
    forms, pairs = [], set()
    for k in range(300):
        parts = [word() for _ in range((1, 2, 8, 20, 60)[k % 5])]
        if k % 5 < 2:  # short lines differ by a character
            other = " ".join(parts)
            at = rnd.randrange(len(other))
            forms += [" ".join(parts), other[:at] + rnd.choice("xyz") + other[at + 1 :]]
        else:
            other = [*parts]
            other[rnd.randrange(len(parts))] = word()
            forms += [" ".join(parts), " ".join(other)]
    forms = sorted(set(forms))
    for i, x in enumerate(forms):
        for j in range(i):
            y = forms[j]
            if abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and edit_similarity(x, y) >= 0.8:
                pairs.add((j, i))
    root = list(range(len(forms)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[max(top(i), top(j))] = min(top(i), top(j))
    want = {i for i in range(len(forms)) if top(i) != i}
    rows = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    got = {r["doc_id"] for r in line_report(rows, differ=None).where("n_removed > 0").collect()}
    assert len(want) > 150 and got <= want
    short = {i for i in want if len(forms[i]) < lines.SHORT - 3}
    assert short <= got  # deletions miss none
    assert len(got) / len(want) >= 0.9
    assert len({r["doc_id"] for r in line_report(rows).where("n_removed > 0").collect()}) / len(want) < 0.8  # what 3 bits reach


def test_the_sieve_comes_to_the_driver_as_columns(spark, monkeypatch):
    from wavelot.llm import sieve

    def rows(self, *a):
        raise AssertionError("half a million rows of objects in the driver")

    keys = spark.range(0, 3_000, 3).select("id")
    monkeypatch.setattr(type(keys), "toPandas", rows)
    left = sieve.sift(spark.range(3_000), "id", keys)
    monkeypatch.undo()
    assert set(range(0, 3_000, 3)) <= {r["id"] for r in left.collect()}
    assert left.count() < 1_100


def test_distances_with_a_limit_for_each_pair():
    rnd = random.Random(11)
    a = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 150))) for _ in range(60)]
    b = ["".join(c for c in x if rnd.random() > 0.1) + "b" * rnd.randint(0, 9) for x in a[:40]] + ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 150))) for _ in range(20)]
    want = np.array([edit_distance(x, y) for x, y in zip(a, b, strict=True)])
    for more in (-1, 0, 1):
        most = np.maximum(want + more, 0)
        got = banded_distances(a, b, most)
        assert (np.where(want <= most, got == want, got > most)).all()
        assert (alike(a, b, most) == (want <= most)).all()


def shuffled(spark):
    time.sleep(0.5)  # figures are kept some tenths of a second late
    spark.range(1).count()
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_buckets_travel_packed(spark):
    rnd = random.Random(7)
    often = [rnd.randint(-(2**63), 2**63 - 1) for _ in range(40)]
    keys = {i: [rnd.choice(often) if rnd.random() < 0.01 else rnd.randint(-(2**63), 2**63 - 1) for _ in range(16)] for i in range(-3000, 3000)}
    held = spark.createDataFrame([(i, keys[i]) for i in [*keys, *range(200)]] + [(7000, None)], "id long, keys array<long>")
    pairs, crowded = star_pairs(held)
    n = Counter(b for i in keys for b in set(keys[i]))
    want = sorted(map(tuple, pairs.collect())), sorted(tuple(r) for r in crowded.select("bucket", "id", "b").collect() if n[r[0]] > 2)
    for per_part in (1 << 18, 500):
        before = shuffled(spark)
        pairs, crowded = packed_star_pairs(held, 16 * len(keys), per_part)
        assert (sorted(map(tuple, pairs.collect())), sorted(map(tuple, crowded.collect()))) == want
        assert shuffled(spark) - before < 20 * 16 * len(keys)  # rows of a bucket, two ids and a count took more


def test_lines_are_bucketed_without_a_row_for_each_bucket(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    docs = spark.createDataFrame([(i, "\n".join(" ".join(word() for _ in range(8)) for _ in range(20))) for i in range(400)], "doc_id long, text string")
    before = shuffled(spark)
    assert line_report(docs, differ=None).count() == 400
    assert shuffled(spark) - before < 17 * 16 * 8000


def test_distances_in_parts_and_of_mixed_lengths():
    rnd = random.Random(7)
    a = ["".join(rnd.choice("abcdefgh é😀") for _ in range(n)) for n in (1, 5, 63, 64, 65, 200, 340) for _ in range(20)]
    b = ["".join(c if rnd.random() < 0.85 else rnd.choice(["", "b", "ca"]) for c in x) if rnd.random() < 0.7 else rnd.choice(a) for x in a]
    want = np.array([edit_distance(x, y) for x, y in zip(a, b, strict=True)])
    for most in (np.array([max(len(x), len(y)) // 5 for x, y in zip(a, b, strict=True)]), np.array([rnd.randint(0, 90) for _ in a])):
        for held in (8 << 20, 20_000):
            got = banded_distances(a, b, most, held)
            assert (got[want <= most] == want[want <= most]).all() and (got[want > most] > most[want > most]).all()


def test_distances_beyond_the_last_end():
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    for long, short in ((460, 378), (550, 385), (550, 405), (840, 692), (920, 756)):
        a = [word(long) for _ in range(29)]  # unlike, so they are left early; their words stay beyond the end of the last pair
        b = [word(long - long // 5) for _ in a]
        a, b = [*a, word(short)], [*b, ""]
        b[-1] = a[-1][1:]
        most = np.array([len(x) // 5 for x in a])
        assert (banded_distances(a, b, most) <= most).tolist() == [False] * 29 + [True]
        assert banded_distances(a, b, most)[-1] == 1


def test_lines_with_the_same_words_in_another_order(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    first, second = [], []
    while len(first) < 40:  # the longer form is a, the one with the larger hash
        words = [word() for _ in range(68)]
        x, y = " ".join(words), " ".join(rnd.sample(words, 55))
        if lines.Lines([x], [0]).norm.view(np.int64)[0] > lines.Lines([y], [0]).norm.view(np.int64)[0]:
            first.append(x)
            second.append(y)
    for _ in range(6):
        words = [word() for _ in range(51)]
        first.append(" ".join(words))
        second.append(" ".join(["x" + words[0], *words[1:-1], words[-1] + "x"]))
    want = [edit_similarity(x, y) >= 0.8 for x, y in zip(first, second, strict=True)]
    assert want == [False] * 40 + [True] * 6
    docs = spark.createDataFrame([(2 * i + k, x[i]) for k, x in enumerate((first, second)) for i in range(len(x))], "doc_id long, text string")
    got = {r["doc_id"] for r in line_report(docs, differ=None).where("n_removed > 0").collect()}
    assert got == {2 * i + 1 for i, w in enumerate(want) if w}
