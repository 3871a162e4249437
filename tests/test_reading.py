import gzip
import io
import json
import os
import random
import subprocess
import sys
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelot.functions.audio import encode_wav, header_frames
from wavelot.operators import batching
from wavelot.options import Augment, Batching, LoaderOptions
from wavelot.plans.loader import Dataset, Loader
from wavelot.sources import tarindex


def put_tar(path, entries, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, data in entries:
            e = tarfile.TarInfo(name)
            e.size = len(data)
            tar.addfile(e, io.BytesIO(data))


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    root, rnd = tmp_path_factory.mktemp("index"), np.random.default_rng(3)
    data = {f"{s}/{'x' * 120 if k == 3 else ''}{k}.wav": encode_wav(rnd.normal(size=3000 + 100 * k) * 0.1, 8000) for s in "ab" for k in range(9)}
    put_tar(root / "a.tar", [("a/0.mp3", b"other"), *((n, d) for n, d in data.items() if n[0] == "a"), ("a/notes.txt", b"text"), ("a/bad.wav", b"no wav"), ("a/1.wav", data["a/0.wav"])])
    put_tar(root / "b.tar.gz", [(n, d) for n, d in data.items() if n[0] == "b"], "w:gz")
    data["a/1.wav"] = data["a/0.wav"]  # the last entry of a name counts
    return [f"{root}/a.tar", f"{root}/b.tar.gz", f"{root}/none.tar"], data


def test_index(spark, shards):
    paths, data = shards
    rows = tarindex.index_tars(paths, spark).collect()
    assert [r["error"] for r in rows if r["url"] == paths[2]] == ["missing"]
    good = {f"{r['key']}.{r['ext']}": r for r in tarindex.choose_formats(tarindex.index_tars(paths, spark)).collect()}
    assert set(good) == {*data, "a/bad.wav"}
    for name, d in data.items():
        r = good[name]
        assert (r["size"], r["frames"], r["rate"]) == (len(d), (len(d) - 44) // 2, 8000) and r["packed"] == (name[0] == "b")
        if not r["packed"]:
            with open(r["url"], "rb") as f:
                f.seek(r["offset"])
                assert f.read(r["size"]) == d
    assert good["a/bad.wav"]["frames"] is None and "ValueError" in good["a/bad.wav"]["error"]


def test_damaged_shards(spark, shards, tmp_path):
    data = open(shards[0][0], "rb").read()
    (tmp_path / "cut.tar").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="ReadError|unexpected end"):
        tarindex.index_tars([f"{tmp_path}/cut.tar"], spark).collect()
    rows = tarindex.index_tars([f"{tmp_path}/cut.tar"], spark, mode="DROPMALFORMED").collect()
    assert len([r for r in rows if r["key"]]) >= 3 and len([r for r in rows if not r["key"]]) == 1


@pytest.mark.parametrize("split", [1 << 12, 64 << 20])
def test_ranges_give_the_same_bytes(spark, shards, split):
    paths, data = shards
    index = tarindex.choose_formats(tarindex.index_tars(paths, spark)).where("frames > 0").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = tarindex.read_ranges(index, split_bytes=split).collect()
    assert len(rows) == 2 * len(data) and all(bytes(r["bytes"]) == data[f"{r['key']}.{r['ext']}"] for r in rows)
    some = tarindex.fetch(index.where("turn = 0").withColumn("url", F.when(F.col("key") != "a/2", F.col("url"))), {c: c for c in ("url", "offset", "size", "packed")}, "b", held=2)
    for r in some.collect():
        assert r["b"] is None if r["key"] == "a/2" else bytes(r["b"]) == data[f"{r['key']}.{r['ext']}"]


def test_only_what_is_asked_is_read(spark, tmp_path, monkeypatch):
    big = encode_wav(np.zeros(2_000_000), 16000)
    put_tar(tmp_path / "big.tar", [(f"{k}.wav", big) for k in range(5)])
    url, read = f"{tmp_path}/big.tar", []

    class Counted(io.FileIO):
        def readinto(self, b):
            read.append(super().readinto(b))
            return read[-1]

        def read(self, n=-1):
            out = super().read(n)
            read.append(len(out))
            return out

    monkeypatch.setattr(tarindex, "open_random", lambda u: Counted(u))
    rows = list(tarindex._walk(url, ("wav",)))
    assert len(rows) == 5 and {r[7] for r in rows} == {2_000_000}
    assert sum(read) <= 5 * (2 << 16)  # of 20 MB
    ranges = tarindex._Ranges()
    assert ranges.get(url, rows[1][4], 1000, False, rows[1][4] + 1000) == big[:1000]
    assert ranges.read_bytes == 1000
    # neighbours come in one read
    ranges.get(url, rows[2][4], 100, False, rows[2][4] + 500)
    ranges.get(url, rows[2][4] + 200, 300, False, rows[2][4] + 500)
    assert ranges.read_bytes == 1500


def test_header_frames():
    wav = encode_wav(np.zeros(100), 8000)
    assert header_frames(wav, len(wav), "wav") == (100, 8000)
    assert header_frames(wav[:144], 144, "wav") == (50, 8000)  # cut off
    more = wav[:12] + b"LIST" + (5001).to_bytes(4, "little") + bytes(5002) + wav[12:]
    assert header_frames(more[:4096], len(more), "wav", lambda: more[4096:]) == (100, 8000)
    stream = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + ((44100 << 44) | (1 << 41) | (15 << 36) | 123456).to_bytes(8, "big") + bytes(16)
    assert header_frames(stream, 10**6, "flac") == (123456, 44100)
    for bad in (b"", b"RIFF0000WAVE", b"x" * 100):
        with pytest.raises(ValueError, match="WAV"):
            header_frames(bad, len(bad), "wav")


# -- the loader's plan


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("loader")
    for name, n in (("one", 24), ("two", 12)):
        lines = []
        for s in range(2):
            put_tar(root / f"{name}{s}.tar", [(f"{name}{s}.{k}.wav", encode_wav(np.sin(np.arange(1600 + 100 * k) * 0.1) * 0.5, 8000)) for k in range(n)])
            (root / f"{name}{s}.jsonl").write_text("".join(json.dumps({"audio_filepath": f"{name}{s}.{k}.wav", "text": f"t{k}", "duration": 0.2}) + "\n" for k in range(n)))
            lines.append(f"{root}/{name}{s}.tar {root}/{name}{s}.jsonl {n * 0.3 / 3600} {n}")
        (root / f"{name}.lst").write_text("\n".join(lines) + "\n")
    put_tar(root / "noise.tar", [(f"n{k}.wav", encode_wav(np.random.default_rng(k).normal(size=900) * 0.3, 8000)) for k in range(3)])
    (root / "noise.lst").write_text(f"{root}/noise.tar\n")
    return root


def shape(df):
    """Exchanges above each node that reads payload, and how many nodes do so."""
    lines = df._jdf.queryExecution().executedPlan().treeString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    reads = [i for i, x in enumerate(lines) if "MapInArrow" in x and "audio_bytes" in x]
    out = []
    for i in reads:
        above, d = [], depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < d:
                above, d = [*above, lines[j]], depth[j]
        out.append(sum("Exchange" in x for x in above))
    return out


@pytest.mark.parametrize("together", [True, False])
@pytest.mark.parametrize("noise", [True, False])
def test_audio_is_read_once_and_shuffled_once(spark, corpus, together, noise):
    data = [Dataset("one", f"{corpus}/one.lst", noise_list=f"{corpus}/noise.lst"), Dataset("two", f"{corpus}/two.lst", map=lambda d: d.withColumn("tag", F.upper("text")), filter=F.col("length_s") > 0.21)]
    options = LoaderOptions(batching=Batching(max_duration=2.0, min_length=0.1, max_length=2.0, num_buckets=3, intra_batch_mux=together), augment=Augment(noise=noise, speed=True, volume=True), sample_rate=8000, feature_type=None, workers=2, fill_factor=20.0, passes=1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    try:
        loader = Loader(spark, data, options)
        done = loader.batches()
        assert shape(done) == [1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = done.collect()
    assert sorted(i for r in rows for i in r["ids"]) == sorted([f"one{s}.{k}" for s in range(2) for k in range(24)] + [f"two{s}.{k}" for s in range(2) for k in range(12) if 1600 + 100 * k > 1680])
    for r in rows:
        assert [t.upper() if i.startswith("two") else None for i, t in zip(r["ids"], r["text"], strict=True)] == r["tag"]
        assert len(r["ids"]) == 1 or max(r["audio_lens"]) / 8000 * len(r["ids"]) <= 2.0 + 1e-9
    # the lengths that batches were packed by are those of the changed audio
    lengths = {(r["url"], r["key"]): r["length_s"] for r in loader.keys().collect()}
    for r in loader.samples().collect():
        assert r["length_s"] == pytest.approx(lengths[r["url"], r["key"]], abs=1e-12)


def test_maps_that_need_audio(spark, corpus):
    loud = lambda d: d.withColumn("audio", F.slice("audio", 1, 1700)).withColumn("peak", F.array_max("audio"))
    data = [Dataset("one", f"{corpus}/one.lst", map=loud, filter=lambda r: r["key"] != "one0.3"), Dataset("two", f"{corpus}/two.lst")]
    options = LoaderOptions(batching=Batching(max_duration=3.0, min_length=0.1, max_length=2.0, num_buckets=2), sample_rate=8000, feature_type=None, workers=1, fill_factor=20.0, passes=1)
    rows = Loader(spark, data, options).batches().collect()
    ids = [i for r in rows for i in r["ids"]]
    assert "one0.3" not in ids and len(ids) == 47 + 24
    for r in rows:
        for i, n, p in zip(r["ids"], r["audio_lens"], r["peak"], strict=True):
            assert (n <= 1700 and p > 0.4) if i.startswith("one") else p is None


def test_each_dataset_has_its_own_bounds(spark, corpus):
    data = [Dataset("one", f"{corpus}/one.lst", min_length=0.2, max_length=0.5), Dataset("two", f"{corpus}/two.lst", min_length=0.2, max_length=1.2)]
    options = LoaderOptions(batching=Batching(max_duration=3.0, num_buckets=11, intra_batch_mux=False), sample_rate=8000, feature_type=None, workers=1, fill_factor=50.0, passes=1)
    packed, _ = Loader(spark, data, options).plan_batches()
    got = {(r["dataset"], round(r["length_s"], 4)): r["bucket_id"] for r in packed.collect()}
    for (d, x), b in got.items():
        assert b == int((x - 0.2) * 10 / ((0.5 if d == "one" else 1.2) - 0.2))


def test_flush_matches_a_plain_loop(spark):
    rnd = random.Random(4)
    rows = [(w, rnd.randrange(6), f"{k:03d}", rnd.choice([3, 5, 7, 9, 30])) for w in range(3) for k in range(70)]
    df = spark.createDataFrame(rows, "worker int, bucket_id int, seq string, length int")
    got = batching.flushed_batches(batching.greedy_batches(df, ["seq"], "length", 40, 6, ["worker", "bucket_id"]), ["seq"], "length", 40, 6, ["worker", "bucket_id"]).collect()
    assert len(got) == len(rows)
    for w in range(3):
        queues = {b: sorted((s, x) for v, c, s, x in rows if v == w and c == b) for b in range(6)}
        full = {(r["from_bucket"], r["seq"]) for r in got if r["worker"] == w and r["flushed"] is None}
        for b in queues:
            queues[b] = [q for q in queues[b] if (b, q[0]) not in full]
        want = []
        while any(queues.values()):
            batch, top = [], 0
            for b in sorted(queues, reverse=True):
                while queues[b] and not (batch and (top * len(batch) >= 40 or len(batch) >= 6)):
                    s, x = queues[b][0]
                    if batch and max(top, x) * (len(batch) + 1) > 40:
                        break
                    batch, top = [*batch, (b, s)], max(top, x)
                    queues[b].pop(0)
            want.append(sorted(batch))
        flushed = {}
        for r in got:
            if r["worker"] == w and r["flushed"] is not None:
                flushed.setdefault(r["flushed"], []).append((r["from_bucket"], r["seq"]))
        assert [sorted(flushed[k]) for k in sorted(flushed)] == want
    ids = {}
    for r in got:
        ids.setdefault((r["worker"], r["bucket_id"], r["batch_id"]), set()).add(r["flushed"])
    assert all(len(x) == 1 for x in ids.values())  # no number is used twice


def test_example_runs(corpus):
    done = subprocess.run([sys.executable, "examples/batches.py", f"{corpus}/one.lst", "--max-duration", "5"], cwd=os.path.dirname(os.path.dirname(__file__)), env={**os.environ, "PYTHONPATH": "."}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "samples" in done.stdout


def test_gzip_is_told_by_its_first_bytes(spark, tmp_path):
    put_tar(tmp_path / "x.tar", [("k.wav", encode_wav(np.zeros(10), 8000))])
    (tmp_path / "y.tar").write_bytes(gzip.compress((tmp_path / "x.tar").read_bytes()))
    assert [r["packed"] for r in tarindex.index_tars([f"{tmp_path}/x.tar", f"{tmp_path}/y.tar"], spark).orderBy("url").collect()] == [False, True]


@pytest.mark.parametrize("together", [True, False])
def test_an_epoch_has_its_full_number_of_batches(spark, corpus, together):
    data = [Dataset("one", f"{corpus}/one.lst"), Dataset("two", f"{corpus}/two.lst")]
    options = LoaderOptions(batching=Batching(max_duration=2.0, min_length=0.1, max_length=0.6, num_buckets=3, intra_batch_mux=together), sample_rate=8000, feature_type=None, workers=2, weights=(1.0, 9.0), fill_factor=2.0)
    with pytest.warns(UserWarning):
        loader = Loader(spark, data, options)
        packed, group = loader.plan_batches()
    want = loader.epoch_batches() // 2
    rows = packed.collect()
    per = {}
    for r in rows:
        per.setdefault(r["worker"], set()).add(tuple(r[g] for g in group))
    assert want > 3 and {w: len(b) for w, b in per.items()} == dict.fromkeys({r["worker"] for r in loader.keys().select("worker").distinct().collect()}, want)
    # where a worker has both, the dataset of a third of the samples gets about nine tenths; the files' folder decides who has what
    has = {w: {r["dataset"] for r in loader.keys().where(F.col("worker") == w).select("dataset").distinct().collect()} for w in per}
    for w in (w for w in per if len(has[w]) == 2):
        own = [r["dataset"] == "two" for r in rows if r["worker"] == w]
        assert sum(own) / len(own) > 0.6
    # the earliest batches go out
    if together:
        late = [max(r["place"] for r in rows if r["worker"] == w) for w in per]
        assert all(x < loader._order(loader.keys()).where(F.col("worker") == w).agg({"place": "max"}).first()[0] for w, x in zip(per, late, strict=True))
    # a pass ends before the next one begins
    order = [r["seq"][:6] for r in sorted((r for r in loader.keys().collect() if r["dataset"] == "two"), key=lambda r: r["seq"])]
    assert order == sorted(order) and len(set(order)) > 1


def test_every_noise_is_used_before_any_repeats(spark):
    from wavelot.operators import samples

    for step in samples.STEPS:
        assert step > 1 << 31 and all(step % p for p in range(2, 46341))
    for n in (1, 2, 7, 60):
        rows = spark.range(10 * n + n // 2).select("id", samples.noise_at(F.col("id"), F.lit(n).cast("long"), 5).alias("at")).collect()
        turns = [[r["at"] for r in sorted(rows) if r["id"] // n == t] for t in range(10)]
        assert all(sorted(t) == list(range(n)) for t in turns)
        assert n < 7 or len({tuple(t) for t in turns}) > 5
    pool = spark.createDataFrame([("a", k, 7, f"n{k}") for k in range(7)] + [("b", k, 2, f"m{k}") for k in range(2)], "dataset string, idx long, n long, entry string")
    asked = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(95)] + [(1000, None)], "key long, noise_of string")
    got = samples.pair_noise(asked, pool, 3, ["key"]).collect()
    assert len(got) == 96 and [r["noise_entry"] for r in got if r["key"] == 1000] == [None]
    for name in "nm":
        used = [r["noise_entry"] for r in got if (r["noise_entry"] or "").startswith(name)]
        count = [used.count(x) for x in set(used)]
        assert len(count) == (7 if name == "n" else 2) and max(count) - min(count) <= 1


def test_emission_follows_arrivals(spark):
    rnd = random.Random(6)
    rows = [(0, rnd.randrange(3), k, rnd.choice([2, 3, 4, 6])) for k in range(300)]
    df = spark.createDataFrame(rows, "worker int, bucket_id int, seq long, length int")
    packed = batching.greedy_batches(df, ["seq"], "length", 30, 9, ["worker", "bucket_id"])
    got = {(r["bucket_id"], r["batch_id"]): r["event"]["seq"] if r["event"] else None for r in batching.emission_events(packed, ["seq"], 30, F.col("bucket_id") + 3.0, ["worker", "bucket_id"]).collect()}
    want, held, done = {}, {b: 0 for b in range(3)}, {b: 0 for b in range(3)}
    size = {}
    for r in packed.collect():
        size[r["bucket_id"], r["batch_id"]] = size.get((r["bucket_id"], r["batch_id"]), 0) + 1
    for _, b, k, _ in rows:
        held[b] += 1
        while (b + 3.0) * held[b] > 45 and (b, done[b]) in size:
            want[b, done[b]] = k
            held[b] -= size[b, done[b]]
            done[b] += 1
    assert {k: v for k, v in got.items() if v is not None} == want and set(got) == set(size)


def test_shards_by_duration_differ_by_the_longest_sample_at_most(spark):
    from wavelot.operators import sharding

    rnd = random.Random(7)
    for n, shards in ((1, 4), (37, 8), (400, 16), (401, 3)):
        rows = [(k, rnd.choice([0.5, 3.0, 29.9]) * rnd.random()) for k in range(n)]
        planned = sharding.shards_by_duration(spark.createDataFrame(rows, "id long, duration double"), shards, 1).collect()
        loads = [sum(r["duration"] for r in planned if r["shard"] == s) for s in range(shards)]
        assert max(loads) - min(loads) <= max(x for _, x in rows) + 1.0  # equal whole seconds are shuffled
