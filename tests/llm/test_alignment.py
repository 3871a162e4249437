import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wavelot.llm import alignment
from wavelot.llm.pieces import byte_letters
from wavelot.llm.queries import op11_token_alignment, vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    None, "", " ", "   ", "\n\n", "One two  three   four.\n\n  Next\tline\r\n", "Größe, naïve café — 漢字 🙂 end\n\nnew line  two", "<|endoftext|> <s> </s> <unk> <0x0A> x<|endoftext|>y",
    "▁", "a▁b", "　wide sep  x", "x" * 700, "word " * 300, "one, two; three: four! five? (six) 7,8.9", "tabs\t\t\there \x00 nul \x0b", "one two three one two three", "漢字かな交じり文" * 40, "é", "é", "ſ ﬁ ½", "x();\r\n  y(a);\r\n}\r\n\r\nend \r z", "\r", "\r\n\r", "a,\r  b\r", "a  b\rc",
]


def tokens(text):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not tokens.models:
        a = Tokenizer.from_file(vocabulary(A))
        a.encode_special_tokens = True
        tokens.models[:] = a, SentencePieceProcessor(model_file=vocabulary(B)), {c: b for b, c in byte_letters().items()}
    a, b, byte_of = tokens.models
    left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


tokens.models = []


def ends(side):
    return np.cumsum([len(x) for _, x in side]).tolist()


def brute(rows):
    found, count = [], Counter()
    for doc_id, text in rows:
        left, right = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            left, right = [], []
        ea, eb = ends(left), ends(right)
        links = [(left[i][0], right[j][0]) for i in range(len(left)) for j in range(len(right)) if max(ea[i] - len(left[i][1]), eb[j] - len(right[j][1])) < min(ea[i], eb[j])]
        count.update(set(links))
        groups, at = [], 0
        for e in sorted(set(ea) & set(eb)):
            groups.append("|".join(",".join(str(i) for (i, _), x in zip(s, es, strict=True) if at < x <= e) for s, es in ((left, ea), (right, eb))))
            at = e
        found.append((doc_id, len(left), len(right), links, groups))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(d, na, nb, len(g), len(x), sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "", ";".join(g)) for d, na, nb, x, g in found]


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(8)
    words = ["the", "tokenizer", "Überraschung", "naïve", "don't", "e.g.", "(x)", "12,345", "漢", "\n", "\n\n", "  ", "\t", "https://a.b/c?d=e", "ALLCAPS", "snake_case", "…", "it's", "a", "\r", ");", "▁"]
    made = ["".join(w + (" " if rnd.random() < 0.8 else "") for w in rnd.choice(words[: 21 + (i % 9 == 0)], rnd.integers(1, 60))) for i in range(60)]
    texts = ODD + made
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (5, ODD[5]), (5, ODD[5])]


def key(r):
    return tuple(-1 if x is None else x for x in r)


@pytest.mark.parametrize("span", [16384, 3])
def test_alignment_matches_brute_force(spark, rows, span, monkeypatch):
    if span == 3:  # documents of many rows, and batches that end inside of them
        events = alignment.token_events
        monkeypatch.setattr(alignment, "token_events", lambda *x: events(*x, span=3))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, uid int, side string")
    try:
        got = alignment.align(frame, vocabulary(A), vocabulary(B))
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        assert sorted(map(key, got.collect())) == sorted(key(r[:7] + r[8:]) for r in brute(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_token_alignment(spark, str(tmp_path))
    assert sorted(map(key, got.collect())) == sorted(key(r[:8]) for r in brute(rows))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]


def test_blocks_of_few_documents_add_up(spark, rows, tmp_path):
    paths = vocabulary(A), vocabulary(B)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = alignment.swept_blocks(alignment.token_events(frame, *paths), *paths, True, entries=40)
    assert blocks.count() > 20
    assert alignment.pair_counts(blocks).agg({"n": "sum"}).first()[0] == alignment.pair_counts(alignment.swept_blocks(alignment.token_events(frame, *paths), *paths, True)).agg({"n": "sum"}).first()[0]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), vocabulary(A), vocabulary(B)).count() == 0


def test_encoder_forgets_and_stays_right():
    enc = alignment.TwinEncoder(vocabulary(A), vocabulary(B), most=20)
    for text in ["some words here", "other words there", "line,\r\nnext\r", "some words here"]:
        (ids, n), (other, m) = enc.encode([text, None])
        left, right = tokens(text)
        assert ids.tolist() == [i for i, _ in left] and other.tolist() == [i for i, _ in right]
        assert n.tolist() == [len(left), 0] and m.tolist() == [len(right), 0]
