import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelot.llm import langid, packing, pfor, quality, token_files, toxicity, viterbi
from wavelot.llm.queries import vocabulary

TEXTS = [None, "", "  \n\t", "One two three.", "One two three.", "Größe, naïve café — 漢字 🙂 end\n\nnew line  two", "a" * 5000, "word " * 9000, "#$%& <b>x</b> 12,345.67", "Added <|endoftext|> and<|startoftext|> tokens <|endoftext|>"]
SCHEMA = "doc_id long, text string, lang string, score double, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, 1.0, 2) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (3, "One two three.", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_packed_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.where(rnd.random(n) < 0.05, rnd.integers(0, 1 << 32, n), rnd.integers(100, 900, n)).astype(np.uint32)
    reader = pfor.Reader(pfor.encode(ids))
    assert (reader.read(0, n) == ids).all()
    for a in range(0, n, 701):
        assert (reader.read(a, min(333, n - a)) == ids[a : a + 333]).all()


def test_packing_keeps_every_token(docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(packing.token_pieces(docs, path, "between_blanks")).collect()
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got))) == sorted(map(key, want))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in got) // 4096)


def test_token_files_match_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = token_files.read_token_files(spark, token_files.write_token_files(docs, path)).collect()
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9]
    text_of, start = dict(enumerate(TEXTS)) | {None: "no id"}, 0
    for r in got:
        ids = [*tokenizer.encode(text_of[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_viterbi_matches_the_library(docs):
    from sentencepiece import SentencePieceProcessor

    path = vocabulary("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    encoded = viterbi.encode_texts(docs, path)
    text_of = dict(enumerate(TEXTS)) | {None: "no id"}
    for r in encoded.collect():
        assert r["ids"] == library.encode(text_of[r["doc_id"]] or "")
    for r in viterbi.decode_ids(encoded, path).collect():
        assert r["text"] == (text_of[r["doc_id"]] or "")
    assert all(r["round_trip"] for r in viterbi.check_round_trip(docs, path).collect())


def test_language_of_odd_rows(spark):
    words = {"xx": ["lorem", "ipsum", "dolor"], "yy": ["zwölf", "boxkämpfer", "jagen"]}
    rows = [(i, " ".join(words[lang] * 20), lang, None, None) for i in range(40) for lang in words]
    docs = spark.createDataFrame([*rows, (90, None, "xx", None, None), (91, "12 34", "yy", None, None), (92, "", None, None, None), (93, "Ipsum DOLOR lorem", None, None, None)], SCHEMA)
    model = langid.learn(docs, F.col("doc_id") < 30)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).where("doc_id >= 90").collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0) and got[93][0] == "xx" and 0 < got[93][1] <= 1
    assert langid.learn(docs.limit(0), F.lit(True)) is None
    assert not langid.predict(docs.limit(0), model).collect()


def test_toxicity_of_odd_rows(spark):
    rows = [(i, "calm words about rivers and trees " + ("vile slur " if i % 4 == 0 else "kind note ") * (i % 7 + 1), None, None, None) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "a vile slur", None, None, None), (902, "a kind note", None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, model).where("doc_id >= 900").collect()}
    assert 0 <= got[900][0] <= 1 and got[901][1] == 1 and got[902][1] == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}


def test_nearest_is_exact():
    rnd = np.random.default_rng(3)
    rows = np.where(rnd.random((300, 40)) < 0.15, rnd.random((300, 40)), 0)
    rows[:, 0] += 1e-3
    rows /= np.sqrt((rows**2).sum(axis=1, keepdims=True))
    index = toxicity.BlockMaxIndex([(t := np.flatnonzero(r), r[t]) for r in rows], 40)
    for i in range(50):
        terms = np.flatnonzero(rows[i])
        found, cos = index.nearest(terms, rows[i, terms], 15, skip=i)
        every = np.delete(rows @ rows[i], i)
        assert np.allclose(cos, np.sort(every)[::-1][:15])


def test_toxicity_against_plain_votes(spark):
    """Every score from its definition: cosines with all examples, votes, calibration."""
    rnd = np.random.default_rng(5)
    vocab, bad = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)], ["vile", "slur", "scum"]
    docs, labels = [], []
    for i in range(400):
        own = rnd.choice(vocab, rnd.integers(1, 60)).tolist()
        if i % 5 == 0:
            own += rnd.choice(bad, 2).tolist()
        docs.append((i, " ".join(own), None, None, None))
        if i < 300:
            labels.append((i, int(i % 5 == 0)))
    docs.append((500, "x " * 200_000 + "vile", None, None, None))  # very long
    frame = spark.createDataFrame([*docs, docs[7]], SCHEMA)
    model = toxicity.learn(frame, spark.createDataFrame([*labels, (3, 1), (3, 0)], "doc_id long, toxic int"), F.lit(True))
    matrix = np.zeros((model.index.n, len(model.vocabulary)))
    at = np.repeat(np.arange(len(model.index.start)), model.index.end - model.index.start)
    term = np.searchsorted(model.index.of_term, at, side="right") - 1
    matrix[model.index.example, term] = model.index.weight
    got = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    for d, text, *_ in docs:
        count = defaultdict(int)
        for w in text.split():
            if w in model.vocabulary:
                count[model.vocabulary[w]] += 1
        v = np.zeros(matrix.shape[1])
        for t, c in count.items():
            v[t] = (1 + np.log(c)) * model.idf[t]
        cos = matrix @ v / np.sqrt(v @ v)
        top = np.lexsort((np.arange(len(cos)), -np.round(cos, 12)))[:15]
        top = top[cos[top] > 0]
        w = model.weight[top] * cos[top] ** 2 / (1.02 - np.minimum(cos[top], 1))
        vote = float(np.interp((w @ model.toxic[top] + model.prior) / (w.sum() + 1), *model.steps))
        assert abs(got[d]["score"] - min(1, max(0, vote))) < 1e-9
        assert got[d]["evidence_ids"] == model.source[top].tolist()
    assert len({r["score"] for r in got.values()}) > 2
    held = [(got[i]["predicted"], int(i % 5 == 0)) for i in range(300, 400)]
    assert sum(a == b for a, b in held) >= 95
    assert not toxicity.score(frame.limit(0), model).collect()
    assert toxicity.learn(frame.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)) is None


def test_language_filters_against_plain_sets(spark):
    """With no false positives the shares are counts over sets of 4-grams; 70 languages take several mask words."""
    rnd = np.random.default_rng(6)
    names = [f"l{i:02d}" for i in range(70)]
    own = {n: ["".join(chr(97 + c) for c in rnd.integers(0, 26, 6)) for _ in range(8)] for n in names}
    rows = [(1000 * k + i, " ".join(rnd.choice(own[n], 30).tolist()), n, None, None) for k, n in enumerate(names) for i in range(8)]
    rows += [(10**6 + 9, " ".join(own["l69"]) * 20_000, "l00", None, None)]  # very long, and not learned from
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(docs, F.col("doc_id") % 1000 < 5)
    assert model.slots.shape[1] == 2
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    sets = defaultdict(set)
    for d, text, n, *_ in rows:
        if d % 1000 < 5 and d < 10**6:
            sets[n] |= set(langid.grams([text])[0].tolist())
    for d, text, n, *_ in rows:
        x = langid.grams([text])[0].tolist() if d < 10**6 else langid.grams([text[:5000]])[0].tolist()
        hits = [sum(g in sets[m] for g in x) for m in names]
        best = names[int(np.argmax(hits))]
        assert got[d]["lang_pred"] == best == (n if d < 10**6 else "l69") and 0 < got[d]["score"] <= 1


def test_languages_tie(spark):
    rows = [(i, "abcd efgh ijkl", lang, None, None) for i, lang in enumerate(["bb", "aa"] * 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(docs, F.lit(True))).collect()} == {"aa"}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert not packing.pack(packing.token_pieces(none, vocabulary("word_bpe_49k.json"), "between_blanks")).collect()
    assert not token_files.read_token_files(spark, token_files.write_token_files(none, vocabulary("byte_bpe_50k.json"))).collect()
    assert not viterbi.check_round_trip(none, vocabulary("piece_bpe_32k.model")).collect()


def test_quality_of_odd_rows(docs):
    got = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    assert all(got[i]["n_words"] == 0 and got[i]["base_failed"] and not got[i]["kept"] for i in (0, 1, 2))
    assert got[7]["n_words"] == got[7]["n_repeat_words"] == 9000
    assert quality.keep_good(docs).columns == docs.columns
    assert not quality.judge_quality(docs.limit(0)).collect()


def test_weights_of_a_text_with_many_terms_take_no_loop():
    from collections import Counter
    from time import process_time

    from wavelot.llm.toxicity import unit

    count, idf = Counter({i: i % 7 + 1 for i in range(200_000, 0, -1)}), np.linspace(1, 9, 200_001)
    began = process_time()
    plain = np.array([1 + np.log(count[t]) for t in sorted(count)]) * idf[1:]
    middle = process_time()
    terms, weights = unit(count, idf)
    took = process_time() - middle
    assert terms.tolist() == sorted(count)
    assert np.allclose(weights, plain / np.sqrt(plain @ plain), rtol=1e-12)
    assert took < 0.5 * (middle - began)
    assert [len(x) for x in unit(Counter(), idf)] == [0, 0]
