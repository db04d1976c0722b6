import random
from array import array

import pytest

from paperloom.llm import tokens as T

RANKS = T.read_ranks(open(T.vocabulary_file(), "rb").read())
ENCODER = T.Encoder(RANKS)


def ids(text):
    return array("i", ENCODER.encode(text)).tolist()


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={}).encode_ordinary


ODD = ["", " ", "\n\n  x", "it's we'LL 'tis", "<|endoftext|>", "ﬁ ﬂ 𝛼 ​﻿\x00", "a" * 5000, " " * 3000 + "x", "日本語テキスト。", "é" * 700, "1234567890" * 300, "-=" * 2000, " \x85\t\r\n", "x퟿"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ids(text) == reference()(text)


@pytest.mark.parametrize("seed", range(5))
def test_random_texts(seed):
    rng, enc = random.Random(seed), reference()
    for _ in range(150):
        letters = rng.choice(["ab", "aeinrst", "the and of ing", "äöü ß", "= -_*'st", "\n\t  a"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400)))
        assert ids(text) == enc(text)


def test_blocks_do_not_matter(monkeypatch):
    rng, enc = random.Random(3), reference()
    text = "".join(rng.choice("ab 'st\n12-é") for _ in range(4000))
    for size in (1, 2, 3, 7, 64, 1000):
        got = array("i", b"".join(ENCODER.stream(text[i : i + size] for i in range(0, len(text), size)))).tolist()
        assert got == enc(text), size


def test_stable_tokens_are_emitted_early_and_memory_is_bounded():
    m = T.MergeList(RANKS)
    t, out, most = T.Transducer(m), [], 0
    data = "".join(random.Random(1).choice("aeinrst") for _ in range(6000)).encode()
    for i in range(0, len(data), 50):
        out.extend(t.feed(data[i : i + 50]))
        most = max(most, len(t.window))
    assert out + t.finish() == reference()(data.decode()) and most < 6 * m.longest < m.lookahead() * 2


def test_decoder_is_the_inverse():
    d = T.Decoder(RANKS)
    text = "é日本 <|endoftext|> \U0001f600 end"
    got = ids(text)
    assert "".join(d.feed([i]) for i in got) + d.finish() == text


def test_table(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (1, "a b", "x"), (None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in T.encode(df).collect()), key=str)
    assert got == sorted([(1, ids("a b")), (2, []), (3, []), (1, ids("a b")), (None, ids("z"))], key=str)
    assert T.encode(df.limit(0)).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in T.count_tokens(df).collect()} == {(1, 2), (2, 0), (3, 0), (None, 1)}


def test_whole_table_against_reference(spark, data):
    enc = reference()
    df = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in T.encode(df).collect()}
    assert got == {k: enc(t) if t else [] for k, t in texts.items()}
