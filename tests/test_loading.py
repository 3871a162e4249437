import gzip
import io
import json
import tarfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelot.cli import parser
from wavelot.functions.audio import encode_wav
from wavelot.operators import batching, mux, samples
from wavelot.options import Augment, Batching, BuildOptions, LoaderOptions
from wavelot.plans.build import build, list_existing
from wavelot.plans.loader import Dataset, Loader
from wavelot.sources import audiotar, lists, sinks
from wavelot.sources.scratch import run_stream
from wavelot.streaming.batcher import stream_batches


def tone(seconds, rate=16000, f=300.0):
    return encode_wav(np.sin(np.arange(int(seconds * rate)) * 2 * np.pi * f / rate) * 0.4, rate)


def put_tar(path, entries, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, data in entries:
            e = tarfile.TarInfo(name)
            e.size = len(data)
            tar.addfile(e, io.BytesIO(data))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    lines = []
    for s in range(2):
        entries = [(f"u{s}.{k}.wav", tone(0.2 + 0.1 * k, 8000 if k % 2 else 16000)) for k in range(10)]
        entries += [("broken.wav", b"xx"), ("notes.txt", b"no audio"), ("short.wav", tone(0.01))]
        tar = root / f"s{s}.tar{'.gz' if s else ''}"
        put_tar(tar, entries, "w:gz" if s else "w")
        rows = [{"audio_filepath": f"u{s}.{k}.wav", "text": f"old {k}", "duration": 0.2} for k in range(9)] + [{"audio_filepath": f"u{s}.0.wav", "text": "new", "duration": 0.2}, {"audio_filepath": f"u{s}.1.wav", "text": "  "}]
        (root / f"s{s}.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        lines.append(f"{tar} {root}/s{s}.jsonl" + (" 0.5 10" if s else ""))
    (root / "all.lst").write_text("\n".join(["", "only-one-field", *lines, lines[0]]) + "\n")
    put_tar(root / "noise.tar", [(f"n{k}.wav", tone(0.3, f=900 + k)) for k in range(3)])
    (root / "noise.lst").write_text(f"{root}/noise.tar anything else\n")
    return root


def test_shard_list(spark, corpus):
    rows = {r["audio_tar"].rsplit("/", 1)[1]: r for r in lists.read_shards(spark, f"{corpus}/all.lst", "d").collect()}
    assert set(rows) == {"s0.tar", "s1.tar.gz"}
    assert rows["s0.tar"]["hours"] is None and rows["s1.tar.gz"]["num_samples"] == 10
    assert lists.existing_shards(lists.read_shards(spark, f"{corpus}/all.lst", "d")).count() == 2


def test_strict_and_tolerant_manifests(spark):
    lines = spark.createDataFrame([('{"audio_filepath": "a.b.wav", "text": "x", "duration": "bad"}',), ("no json",), ("",)], "value string")
    assert [(r["key"], r["duration"]) for r in lists.parse_manifest(lines).collect()] == [("a.b", None)]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        lists.parse_manifest(lines, strict=True).collect()


def test_tar_source(spark, corpus):
    paths = [f"{corpus}/s0.tar", f"{corpus}/s1.tar.gz"]
    rows = audiotar.read_tars(spark, paths).collect()
    assert len(rows) == 24 and {r["ext"] for r in rows} == {"wav"} and "u0.3" in {r["key"] for r in rows}
    assert audiotar.read_tars(spark, paths, payload=False).where("bytes is null").count() == 24
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("audiotar").options(paths=json.dumps([*paths, "/none.tar"]), pushdown="true").load().where(F.col("url") == paths[0])
        assert df.count() == 12
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    shards = spark.createDataFrame([(p,) for p in paths], "audio_tar string")
    assert audiotar.pad_shards(shards, 3).count() == 3
    assert sum(audiotar.rank_shards(shards, r, 2).count() for r in range(2)) == 2


def test_test_mode_gives_each_sample_once(spark, corpus):
    loader = Loader(spark, [f"{corpus}/all.lst"], LoaderOptions(batching=Batching(max_duration=3.0, min_length=0.1, max_length=2.0, num_buckets=4), is_test=True))
    rows = loader.batches().collect()
    ids = [i for r in rows for i in r["ids"]]
    assert sorted(ids) == sorted(f"u{s}.{k}" for s in range(2) for k in range(10))
    text = {i: t for r in rows for i, t in zip(r["ids"], r["text"], strict=True)}
    assert text["u0.0"] == "new" and text["u0.1"] == "<|EMPTY|>" and text["u1.9"] == "<|EMPTY|>" and text["u1.5"] == "old 5"
    for r in rows:
        longest = max(r["audio_lens"])
        assert all(len(a) == longest for a in r["audio"]) and longest * len(r["ids"]) <= 3.0 * 16000 or len(r["ids"]) == 1
        assert all(len(f) == max(r["feature_lens"]) and len(f[0]) == 80 for f in r["feature"])
        assert [n // 160 + 1 for n in r["audio_lens"]] == r["feature_lens"]
    assert "Loader(" in repr(loader) and loader.epoch_batches() >= 1


def test_training_mode(spark, corpus):
    base = Batching(max_duration=6.0, min_length=0.1, max_length=2.0, num_buckets=2, num_copies=2)
    augment = Augment(noise=True, noise_prob=1.0, speed=True, volume=True, volume_prob=1.0)
    data = [Dataset("a", f"{corpus}/all.lst", noise_list=f"{corpus}/noise.lst", filter=F.col("length_s") < 0.9), Dataset("b", f"{corpus}/all.lst", map=lambda d: d.withColumn("text", F.upper("text")))]
    loader = Loader(spark, data, LoaderOptions(batching=base, augment=augment, feature_type=None, workers=1, fill_factor=50.0, passes=1))
    rows = loader.batches().collect()
    assert rows and all(len(r["ids"]) % 2 == 0 and r["ids"][: len(r["ids"]) // 2] == r["ids"][len(r["ids"]) // 2 :] for r in rows)
    assert rows == loader.batches().collect()
    assert {round(r["weight"], 6) for r in loader.weights().collect()} == {0.5}


def test_batches_by_dataset_keep_added_columns(spark, corpus):
    base = Batching(max_duration=1.0, min_length=0.1, max_length=2.0, num_buckets=2, intra_batch_mux=False)
    tag = lambda d: d.withColumn("tag", F.upper("key"))
    data = [Dataset("a", f"{corpus}/all.lst", map=tag), Dataset("b", f"{corpus}/all.lst", map=tag)]
    options = LoaderOptions(batching=base, augment=Augment(noise=False), feature_type=None, workers=1, fill_factor=0.25, weights=[1000.0, 1.0])
    with pytest.warns(UserWarning):
        loader = Loader(spark, data, options)
        loader.epoch_batches = lambda: 2
        rows = loader.batches().collect()
    assert len(rows) == 2 and all(r["tag"] == [i.upper() for i in r["ids"]] for r in rows)
    # the epoch ends long before the rare dataset's first batch
    assert {r["dataset"] for r in rows} == {"a"}


def test_missing_files_are_left_out(spark, corpus, tmp_path):
    lines = (corpus / "all.lst").read_text().splitlines() if hasattr(corpus, "joinpath") else open(f"{corpus}/all.lst").read().splitlines()
    (tmp_path / "more.lst").write_text("\n".join([*lines, f"{tmp_path}/none.tar {tmp_path}/none.jsonl 1.0 5"]))
    options = LoaderOptions(batching=Batching(max_duration=3.0, min_length=0.1, max_length=2.0), is_test=True, feature_type=None)
    with pytest.warns(UserWarning, match="missing"):
        rows = Loader(spark, [f"{tmp_path}/more.lst"], options).batches().collect()
    assert len([i for r in rows for i in r["ids"]]) == 20


def test_last_line_of_a_tar_counts(spark, tmp_path):
    (tmp_path / "d.lst").write_text("\n".join(f"/x.tar /m{i}.jsonl {i}.0 {i}" for i in range(50)))
    got = lists.read_shards(spark, f"{tmp_path}/d.lst", "d").collect()
    assert [(r["manifest"], r["hours"], r["num_samples"]) for r in got] == [("/m49.jsonl", 49.0, 49)]


def test_public_names():
    import wavelot

    assert all(getattr(wavelot, n) is not None for n in wavelot.__all__)


def test_noise_has_the_asked_ratio(spark):
    rnd = np.random.default_rng(1)
    clean = spark.createDataFrame([(k, rnd.normal(size=400).tolist()) for k in range(20)], "key long, audio array<float>")
    noise = spark.createDataFrame([(k, rnd.normal(size=150 + 500 * k).tolist()) for k in range(2)], "idx long, audio array<float>")
    mixed = samples.augment(clean, Augment(noise=True, noise_prob=1.0, noise_snr_db=(12.0, 12.0)), 1, ["key"], noise=noise, noise_count=2)
    before = {r["key"]: np.array(r["audio"]) for r in clean.collect()}
    for r in mixed.collect():
        left = np.array(r["audio"]) - before[r["key"]]
        assert 10 * np.log10((before[r["key"]] ** 2).sum() / (left**2).sum()) == pytest.approx(12.0, abs=1e-3)


def test_weights(spark):
    totals = spark.createDataFrame([("a", 9.0), ("b", 1.0)], "dataset string, hours double")
    with pytest.warns(UserWarning, match="5 %"):
        got = {r["dataset"]: r["weight"] for r in mux.dataset_weights(totals, weights={"a": 1, "b": 1}).collect()}
    assert got == {"a": 0.5, "b": 0.5}


@pytest.mark.parametrize("size", [{"num_tars": 3}, {"samples_per_tar": 4}, {"num_tars": 2, "balance_by": "samples"}])
def test_build_and_list(spark, tmp_path, size):
    lines = []
    for k in range(10):
        (tmp_path / f"in{k}.wav").write_bytes(tone(0.2 + 0.05 * k))
        lines.append(f"id{k}\t{tmp_path}/in{k}.wav\t你 好 {k}" + ("\t0.1\t0.1" if k == 3 else ""))
    lines += [f"id0\t{tmp_path}/in1.wav\tagain", f"bad\t{tmp_path}/in9.wav\tx\t9\t1"]
    source = tmp_path / "set.tsv.gz"
    source.write_bytes(gzip.compress("\n".join(lines).encode()))
    options = BuildOptions(input=str(source), output_dir=str(tmp_path / "out"), format="WAV", **size)
    plan = build(spark, BuildOptions(**{**options.__dict__, "plan_only": True}))
    assert sum(r["n"] for r in plan["plan"]) == 12
    first = build(spark, options)
    assert first["errors"] == 1 and first["num_samples"] in (10, 11) and first["skipped"] == 0 and first["reused"]
    again = build(spark, options)
    assert again["written"] == 0 and again["num_samples"] == first["num_samples"]
    shards = lists.read_shards(spark, first["list"], "d")
    assert shards.agg(F.sum("num_samples")).first()[0] == first["num_samples"]
    texts = lists.read_manifests(spark, sorted(r["manifest"] for r in shards.collect())).where("audio_filepath = 'id4.wav'").first()
    assert texts["text"] == "你好 4"
    sliced = lists.read_manifests(spark, sorted(r["manifest"] for r in shards.collect())).where("audio_filepath = 'id3.wav'").first()
    assert sliced["duration"] == pytest.approx(0.1)
    made = list_existing(spark, f"{tmp_path}/out/audio/*.tar", f"{tmp_path}/out/txt", f"{tmp_path}/again.lst", strict=True)
    assert made["shards"] == shards.count()
    again = lists.read_shards(spark, made["output"], "d")
    assert again.agg(F.sum("num_samples")).first()[0] == first["num_samples"]


def test_bad_source_lines(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\n")
    with pytest.raises(Exception, match="expected 3 or 5"):
        lists.read_sources(spark, f"{tmp_path}/x.tsv").collect()
    assert lists.read_sources(spark, f"{tmp_path}/x.tsv", strict=False).count() == 0
    bad = spark.createDataFrame([("/a b.tar", "/m", 1.0, 1)], "audio_tar string, manifest string, hours double, num_samples long")
    with pytest.raises(Exception, match="white space"):
        sinks.list_lines(bad).collect()


@pytest.mark.parametrize("ordered", [True, False])
def test_stream_equals_greedy_fold(spark, ordered):
    rnd = np.random.default_rng(2)
    rows = [(0, int(k) % 2, int(k), f"s{k:03d}", float(rnd.integers(1, 20))) for k in range(200)]
    schema = "worker int, bucket_id int, seq long, id string, length double"
    parts = [spark.createDataFrame(rows[p * 50 : p * 50 + 50], schema) for p in range(4)]
    ends = spark.createDataFrame([(0, b, 0, None, None) for b in range(2)], schema)
    got = run_stream(lambda live: stream_batches(live, 100.0, 8, ordered=ordered), [*parts, ends]).collect()
    assert sorted(i for r in got for i in r["ids"]) == [r[3] for r in rows]
    length = {r[3]: r[4] for r in rows}
    for r in got:
        own = [length[i] for i in r["ids"]]
        assert (r["n"], r["longest"], r["total"]) == (len(own), max(own), sum(own))
        assert len(own) == 1 or (max(own) * len(own) <= 100 and len(own) <= 8)
    if ordered:
        packed = batching.greedy_batches(spark.createDataFrame(rows, schema), ["seq"], "length", 100.0, 8, ["worker", "bucket_id"]).collect()
        want = {}
        for r in sorted(packed, key=lambda r: r["seq"]):
            want.setdefault((r["bucket_id"], r["batch_id"]), []).append(r["id"])
        assert {(r["bucket_id"], r["batch_id"]): r["ids"] for r in got} == want
        assert {(r["bucket_id"], r["batch_id"]) for r in got if r["flushed"]} == {(b, max(k for c, k in want if c == b)) for b in range(2)}


def test_idle_buckets_give_up_their_batch(spark, tmp_path):
    schema = "worker int, bucket_id int, seq long, id string, length double"
    spark.createDataFrame([(0, b, k, f"{b}{k}", 1.0) for b in range(2) for k in range(3)], schema).write.parquet(f"{tmp_path}/in/0")
    live = stream_batches(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), 100.0, None, idle_ms=200)
    stream = live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            rows = spark.read.schema(live.schema).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out/_spark_metadata").exists() else []
            if len(rows) == 2:
                break
            time.sleep(0.5)
    finally:
        stream.stop()
    assert sorted((r["bucket_id"], r["ids"], r["flushed"]) for r in rows) == [(b, [f"{b}{k}" for k in range(3)], True) for b in range(2)]


def test_options():
    with pytest.raises(ValueError, match="exactly one"):
        BuildOptions(input="x")
    with pytest.raises(ValueError, match="batch_size"):
        Batching(batch_size=1, num_copies=2)
    b = Batching(max_duration=600, num_copies=2)
    assert (b.budget, b.cap, b.buckets) == (300, 300, 30)
    assert Batching(batch_size=8).buckets == 1
    assert BuildOptions(input="a/b.tsv.gz", num_tars=2).prefix == "b"
    args = parser().parse_args(["build", "--input", "x", "--num-tars", "4", "--plan-only"])
    assert not args.no_lst and args.compression_level == 0.65
    assert args.plan_only and args.format == "FLAC"
