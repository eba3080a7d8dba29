"""Token counts against the public library, text by text."""

import random

import pytest

pytest.importorskip("wardline.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from wardline.llm import tokencounts  # noqa: E402
from wardline.llm.pieces import Pieces, chunk_parts, chunks, spelled  # noqa: E402
from wardline.llm.queries import QUERIES, piece_model  # noqa: E402

ODD = [
    "",
    " ",
    "a ",
    "  a  b\n\n c\t d \r\n;\r\n",
    "\n",
    "\nx",
    "\r\r\n \r",
    "▁a ▁▁ b▁c ▁",
    "plain words\nin lines\nof a text",
    "<s>a</s><unk> <0x41>\x00b\x00",
    "　x　 y z ",
    "ﬁ½ ① é 日本語テキスト😀😀 \x1c\x1d",
    "x" * 5000 + " " * 3000 + "\n" * 300 + "tail",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def random_texts(n=400):
    rng = random.Random(5)
    letters = "ab e\n\r\t;){▁é　 \x00\x1c"
    return ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(n)]


def test_chunks_encode_as_whole_texts(library):
    pieces = Pieces(piece_model())
    for text in ODD + random_texts():
        found = chunks(text)
        assert "".join(map(spelled, found)) == (" " + text if text else "")
        assert [c for part in chunk_parts(text, 7) for c in part] == found
        ids = [i for code in (pieces.encode(found) if found else []) for i in code]
        assert ids == library.encode(text)


def test_small_memory_and_table(library):
    pieces = Pieces(piece_model())
    lengths = tokencounts.Lengths(pieces, ["a"], [1], memory=2)
    for text in [None, *ODD, *random_texts(100)]:
        assert lengths.counts([text, "a"]) == [len(library.encode(text or "")), 1]
    lengths.learn([["b"]])
    assert len(lengths.known) <= 1 + 1


def test_summary_keeps_the_frequent():
    rng = random.Random(2)
    stream = [f"w{rng.randrange(5000)}" for _ in range(20000)] + ["often"] * 3000 + ["also\n"] * 2500
    rng.shuffle(stream)
    parts = []
    for i in range(0, len(stream), 1000):
        part = tokencounts.Summary(64)
        part.add(stream[i : i + 1000])
        parts.append(part.packed())
    whole = tokencounts.Summary(64)
    for packed in parts:
        whole.merge(packed)
    words, counts = tokencounts.unpack(whole.packed())
    assert len(words) <= 64
    assert {"often", "also\n"} <= set(words)
    assert all(n <= stream.count(w) for w, n in zip(words, counts))


def test_rows(spark, library, monkeypatch):
    monkeypatch.setattr(tokencounts, "FAN_IN", 2)
    rows = [(i % 5 if i % 7 else None, t, "x", i) for i, t in enumerate([*ODD, None, *ODD[:4]])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_bytes string, part int").repartition(5)
    got = tokencounts.count_tokens(docs, piece_model()).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    empty = spark.createDataFrame([], docs.schema)
    assert tokencounts.count_tokens(empty, piece_model()).count() == 0


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_token_counts"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, n = got[d.doc_id], len(library.encode(d.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 4096)
