import glob
import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelot.functions.audio import decode_wav, encode_wav, load_segment
from wavelot.options import BuildOptions
from wavelot.plans.build import build, stored_plan
from wavelot.sources import audiotar, lists, sinks, tarsink


def source(folder, n=16, text="t"):
    lines = []
    for k in range(n):
        path = folder / f"in{k}.wav"
        if not path.exists():
            path.write_bytes(encode_wav(np.sin(np.arange(800 + 80 * k) * 0.1) * 0.5, 8000))
        lines.append(f"id{k}\t{path}\t{text} {k}")
    (folder / "set.tsv").write_text("\n".join(lines) + "\n")
    return str(folder / "set.tsv")


def listed(spark, path):
    rows = lists.read_shards(spark, path, "d").collect()
    found = {}
    for r in rows:
        with tarfile.open(r["audio_tar"]) as tar:
            names = sorted(tar.getnames())
        assert names == sorted(json.loads(x)["audio_filepath"] for x in open(r["manifest"]))
        found[os.path.basename(r["audio_tar"])] = names
    return found


def test_plans_in_one_folder_never_mix(spark, tmp_path):
    options = lambda n: BuildOptions(input=source(tmp_path), output_dir=str(tmp_path / "out"), format="WAV", num_tars=n, balance_by="samples")
    for n in (2, 4, 2):
        done = build(spark, options(n))
        names = [x for own in listed(spark, done["list"]).values() for x in own]
        assert sorted(names) == sorted(f"id{k}.wav" for k in range(16))
        assert done["written"] == n and done["listed"] == n and done["num_samples"] == 16


def test_a_changed_row_makes_another_plan_and_an_equal_table_does_not(spark, tmp_path):
    options = BuildOptions(input=source(tmp_path), output_dir=str(tmp_path / "out"), format="WAV", num_tars=2)
    first = build(spark, options)
    lines = (tmp_path / "set.tsv").read_text().splitlines()
    (tmp_path / "set.tsv").write_text("\n".join(lines[::-1]) + "\n")
    assert build(spark, options)["written"] == 0
    lines[3] = lines[3].replace("t 3", "other")
    (tmp_path / "set.tsv").write_text("\n".join(lines) + "\n")
    second = build(spark, options)
    assert second["fingerprint"] != first["fingerprint"] and second["written"] == 2 and not second["reused"]
    texts = [json.loads(x)["text"] for f in glob.glob(f"{tmp_path}/out/txt/*.jsonl") for x in open(f)]
    assert "other" in texts and "t 3" not in texts
    # repeated rows count: an order-free hash that cancelled pairs would not see them
    rows = lists.read_sources(spark, options.input)
    twice = rows.unionByName(rows)
    from wavelot.operators.sharding import content_hash

    assert len({content_hash(rows), content_hash(twice), content_hash(twice.unionByName(rows))}) == 3


def test_an_interrupted_build_goes_on(spark, tmp_path):
    options = BuildOptions(input=source(tmp_path), output_dir=str(tmp_path / "out"), format="WAV", num_tars=8, balance_by="samples", wave=3)
    part = build(spark, BuildOptions(**{**options.__dict__, "split_end": 5}))
    assert part["written"] == 5
    os.remove(glob.glob(f"{tmp_path}/out/txt/*0001.jsonl")[0])  # a shard that isn't whole is made again
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/out/audio/*.tar")}
    done = build(spark, options)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/out/audio/*.tar")}
    assert done["written"] == 4 and done["skipped"] == 4 and done["num_samples"] == 16 and done["reused"]
    assert sum(before[f] == after[f] for f in before) == 4


def packed(spark, n=12, shards=3):
    wav = encode_wav(np.zeros(160), 16000)
    rows = [(k % shards, f"k{k}.wav", wav, f"t{k}", 0.01, None) for k in range(n)]
    return spark.createDataFrame(rows, tarsink.PACKED)


def write(df, folder, tasks=2, deal="shard"):
    sinks.write_tars(df.repartition(tasks, deal).sortWithinPartitions("shard"), str(folder), "set")


def test_sink_writes_shards_whole(spark, tmp_path):
    df = packed(spark).unionByName(spark.createDataFrame([(0, "bad.wav", None, None, None, "broken"), (0, "k0.wav", b"again", "", 1.0, None)], tarsink.PACKED))
    write(df.orderBy("shard"), tmp_path / "o")
    assert sorted(os.listdir(tmp_path / "o")) == ["audio", "done", "txt"]
    notes = [json.load(open(f)) for f in sorted(glob.glob(f"{tmp_path}/o/done/*"))]
    assert [(x["shard"], x["num_samples"], x["errors"]) for x in notes] == [(0, 4, 1), (1, 4, 0), (2, 4, 0)]
    rows = audiotar.read_tars(spark, glob.glob(f"{tmp_path}/o/audio/*.tar"))
    assert rows.count() == 12 and rows.where(F.length("bytes") == 44 + 320).count() == 12


@pytest.mark.parametrize("way", ["error", "kill"])
def test_a_failing_task_leaves_nothing(spark, tmp_path, way):
    def fail(batches):
        for pdf in batches:
            yield pdf
            if (pdf["shard"] == 2).any():
                if way == "kill":
                    os._exit(1)
                raise ValueError("on purpose")

    df = packed(spark).repartition(3, "shard").sortWithinPartitions("shard").mapInPandas(fail, tarsink.PACKED)
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_tars(df, str(tmp_path / "o"), "set")
    assert not glob.glob(f"{tmp_path}/o/**/*.*", recursive=True) and not glob.glob(f"{tmp_path}/o/_temporary*")


def test_a_shard_in_two_tasks_fails(spark, tmp_path):
    with pytest.raises(Exception, match="several tasks"):
        write(packed(spark), tmp_path / "o", 2, "name")
    assert not glob.glob(f"{tmp_path}/o/audio/*") and not glob.glob(f"{tmp_path}/o/_temporary*")


def test_first_channel_and_the_sources_rate_stay(spark, tmp_path):
    import wave

    left, right = (np.sin(np.arange(1200) * f) * 0.5 for f in (0.1, 0.7))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(11025)
        w.writeframes((np.stack([left, right], axis=1) * 32767).astype("<i2").tobytes())
    (tmp_path / "s.wav").write_bytes(out.getvalue())
    (tmp_path / "set.tsv").write_text(f"a\t{tmp_path}/s.wav\tx\n")
    done = build(spark, BuildOptions(input=f"{tmp_path}/set.tsv", output_dir=f"{tmp_path}/out", format="WAV", num_tars=1, balance_by="samples", tmp_dir=f"{tmp_path}/plans"))
    row = audiotar.read_tars(spark, [r["audio_tar"] for r in lists.read_shards(spark, done["list"], "d").collect()]).first()
    audio, rate = decode_wav(bytes(row["bytes"]))
    assert rate == 11025 and audio.shape == (1, 1200) and np.abs(audio[0] - left).max() < 1e-3
    assert os.path.isdir(f"{tmp_path}/plans/context") and not os.path.exists(f"{tmp_path}/out/context")
    options = BuildOptions(input=f"{tmp_path}/set.tsv", output_dir=f"{tmp_path}/out", format="WAV", num_tars=1, balance_by="samples", tmp_dir=f"{tmp_path}/plans")
    assert stored_plan(lists.read_sources(spark, options.input), options)[1]["reused"]


@pytest.mark.parametrize("piece", ["64m", "100"])
def test_lines_are_numbered_over_pieces_of_files(spark, tmp_path, piece):
    for name, n in (("a", 90), ("b", 1), ("c", 57)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k}{'x' * (k % 13)}\n" if k % 10 else "\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    try:
        df = lists.read_lines(spark, f"{tmp_path}/*.txt")
        assert piece == "64m" or spark.read.text(f"{tmp_path}/*.txt").rdd.getNumPartitions() > 5
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 148
    for r in rows:
        name = r["file"].rsplit("/", 1)[1][0]
        assert r["value"].rstrip("x") == (f"{name}{r['line_no']}" if r["line_no"] % 10 else "")


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "set.tsv").write_text("a\t/x.wav\tt\n\nb\t/y.wav\n")
    with pytest.raises(Exception, match="bad source line 3: expected 3 or 5 fields, found 2"):
        lists.read_sources(spark, f"{tmp_path}/set.tsv").collect()


class Counted(io.BytesIO):
    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


@pytest.mark.parametrize("channels", [1, 2])
def test_a_segment_reads_its_own_bytes(channels):
    import wave

    rnd = np.random.default_rng(channels)
    frames = rnd.integers(-9000, 9000, (400_000, channels)).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(frames.tobytes())
    for start, duration in ((0.0, 0.5), (12.3, 1.0), (49.9, 5.0), (60.0, 1.0)):
        file = Counted(out.getvalue())
        got, rate = load_segment(file, "wav", start, duration)
        at = int(start * 8000)
        assert rate == 8000 and np.array_equal(got, frames[at : at + int(duration * 8000)].T.astype(np.float32) / 32768)
        assert file.total <= 4096 + 2 * channels * 8000 * duration
    with pytest.raises(ValueError, match="not a WAV"):
        load_segment(io.BytesIO(b"no"), "wav", 0, 1)
