import hashlib
import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    """Documents of which it is known what each stage does with them."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    texts = ["\n".join(line(14) for _ in range(8)) for _ in range(12)]
    shared = line(60)
    docs = {i: t for i, t in enumerate(texts)}
    docs[20] = texts[0]  # an exact copy: all its lines go, and with them the document
    docs[21] = texts[1] + "\n" + texts[2].split("\n")[3]  # the same with a line more
    docs[22] = "\n".join(line(14) for _ in range(6)) + " " + shared
    docs[23] = shared + " " + "\n".join(line(14) for _ in range(6))
    docs[30], docs[31], docs[32] = None, "", "too short to stay"
    return docs, shared


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, _ = made()
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "a", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs, shared = made()
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(f"{folder}/stage{k}")
        frame = spark.read.parquet(f"{folder}/stage{k}")
        out[name] = frame
        if k < 4:
            assert frame.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    text = lambda name: {r["doc_id"]: r["text"] for r in out[name].collect()}
    assert set(text("quality rules")) == set(docs) - {30, 31, 32}
    lines = text("line dedup")
    assert set(lines) == set(docs) - {20, 21, 30, 31, 32}
    assert all(lines[i] == docs[i] for i in lines)
    assert text("MinHash near-dedup") == lines
    kept = text("suffix-array dedup")
    assert all(kept[i] == lines[i] for i in range(12))
    assert shared[50:-50] not in kept[22] and shared[50:-50] not in kept[23] and kept[22].startswith(docs[22][:400])
    packed = out["best-fit packing"].collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted(kept)
    ends = {}
    for r in packed:
        ends[r["sequence_id"]] = ends.get(r["sequence_id"], 0) + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(ends.values()) // 4096)


def test_run_over_an_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_near_copies_that_line_dedup_leaves(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    near = [*words]
    near[150] = "changed"
    # the same words in lines of other lengths: no line repeats, the documents nearly do
    rows = [(2, "\n".join(" ".join(words[i : i + 60]) for i in range(0, 300, 60)), 5), (1, "\n".join(" ".join(near[i : i + 7]) for i in range(0, 300, 7)), 6), (3, None, 1), (3, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id long")
    left = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, frame, ""), "")
    assert left.columns == frame.columns
    assert [r["doc_id"] for r in left.collect()] == [1]
    assert hashlib.sha256(left.collect()[0]["text"].encode()).digest() == hashlib.sha256(rows[1][1].encode()).digest()
