"""Encoding against the public tokenizer library, token by token."""

import hashlib
import random
import struct

import pytest

pytest.importorskip("wardline.llm")
from tokenizers import Tokenizer  # noqa: E402

from wardline.llm import bpe  # noqa: E402
from wardline.llm.queries import QUERIES, vocabulary  # noqa: E402

ODD = [
    "",
    "  \n",
    "it's I'LL they've 123 ½ ⅷ ² ΣΑΣ σας İstanbul é \x1c x\x1fy \x85z\xa0",
    "<|endoftext|>x<|startoftext|><|endoftext|> <|end <|endoftext|",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50,
    "日本語テキスト😀😀 ​ ﬁ Ⅻ ''''ss's!!!!!!!!!! ???...",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    e = library.encode(text or "", add_special_tokens=False)
    return struct.pack(f"<{len(e.ids)}I", *e.ids), library.decode(e.ids, skip_special_tokens=False)


def test_odd_and_random_texts(library):
    rng = random.Random(3)
    letters = "ab e'tre.!é9 ſıﬀ́ͅΣ<|>"
    texts = ODD + ["".join(rng.choices(letters, k=200)) for _ in range(300)]
    model = bpe.WordBpe(vocabulary())
    assert model.encode(texts) == [expected(library, t) for t in texts]
    for ids, shown in model.encode(texts):
        assert model.decode(ids) == shown


def test_small_word_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORD_MEMORY", 3)
    model = bpe.WordBpe(vocabulary())
    for text in ["one two three four five", "two six", "seven eight nine two"]:
        assert model.encode([text]) == [expected(library, text)]


def test_rows(spark, library):
    rows = [(1, None, "x"), (1, None, "x"), (None, "again and again", "y"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(docs, vocabulary()).collect()
    want = [(d, *expected(library, t)) for d, t, _ in rows]
    assert sorted(map(repr, ((r.doc_id, bytes(r.ids), r.decoded) for r in got))) == sorted(
        map(repr, want)
    )
    empty = spark.createDataFrame([], docs.schema)
    assert bpe.encode_documents(empty, vocabulary()).count() == 0


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids, shown = expected(library, d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
