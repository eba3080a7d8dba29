"""Alignment of two tokenizers against a brute force over the public libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("wardline.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from wardline.llm import alignment  # noqa: E402
from wardline.llm.bpe import byte_symbols  # noqa: E402
from wardline.llm.pieces import chunks, spelled  # noqa: E402
from wardline.llm.queries import QUERIES, byte_vocabulary, piece_model  # noqa: E402

ODD = [
    "",
    None,
    " ",
    "a ",
    "  a  b\n\n c\t d \r\n;\r\n",
    "\n",
    "it's I'LL they've 123 ½ ⅷ ² é \x1c x\x1fy \x85z\xa0 end\x85",
    "▁a b",
    "plain words\nin lines\nof a text",
    "<|endoftext|> <s>a</s> <0x41>\x00b\x00",
    "　x　 y z \t\t  tab\t \t",
    "日本語テキスト😀😀 ​ ﬁ Ⅻ ''''ss's!!!!!!!!!! ???...",
    "x" * 3000 + " " * 3000 + "\n" * 300 + "tail",
    "word " * 700,
]


class Library:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.symbol = {s: i for i, s in enumerate(byte_symbols())}

    def tokens(self, text):
        raw = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        spelled_a = [bytes(self.symbol[c] for c in self.a.id_to_token(i)) for i in a]
        spelled_b = []
        for i in b:
            piece = self.b.id_to_piece(i)
            spelled_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            return None
        return [(i, len(s)) for i, s in zip(a, spelled_a)], [(i, len(s)) for i, s in zip(b, spelled_b)]


def spans(tokens):
    at = 0
    for i, n in tokens:
        yield i, at, at + n
        at += n


def brute(library, rows):
    docs, counts = [], Counter()
    for _, text, *_ in rows:
        sides = library.tokens(text) if text else None
        if sides is None:
            docs.append(None)
            continue
        a, b = (list(spans(s)) for s in sides)
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in both:
            inside = [",".join(str(i) for i, _, e in s if start < e <= end) for s in (a, b)]
            groups.append("|".join(inside))
            start = end
        links = Counter()
        j0 = 0
        for i, s, e in a:
            while b[j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(b) and b[j][1] < e:
                links[i, b[j][0]] += 1
                j += 1
        counts.update(links.keys())
        docs.append((len(a), len(b), len(both), links, ";".join(groups)))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, *_), d in zip(rows, docs):
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, text = d
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.append((doc_id, n_a, n_b, n_groups, links.total(), best, total, digest))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def library():
    return Library()


def random_texts(n=300):
    rng = random.Random(9)
    letters = "ab e\n\r\t;){'sé　 \x00\x1c1½"
    return ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(n)]


def test_side_a_as_the_library(library):
    mine = alignment.ByteBpe(byte_vocabulary())
    for text in [t for t in ODD if t] + random_texts():
        assert mine.encode(list(map(spelled, chunks(text)))).tolist() == library.a.encode(" " + text, add_special_tokens=False).ids


def test_runs_and_merges(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 7)
    rng = np.random.default_rng(3)
    want, runs = Counter(), []
    for size in (0, 1, 50, 200, 33):
        codes = np.unique(rng.integers(0, 400, size))
        counts = rng.integers(1, 10**10, len(codes))
        want.update(dict(zip(codes.tolist(), counts.tolist())))
        runs.append(alignment.to_run(alignment.in_blocks(codes, counts)))
    got = list(alignment.merged(runs))
    flat = [(c, n) for cs, ns in got for c, n in zip(cs.tolist(), ns.tolist())]
    assert flat == sorted(want.items())
    best = [x for b in alignment.with_best(iter(got), 20) for x in zip(*(c.tolist() for c in b))]
    most = defaultdict(int)
    for c, n in flat:
        most[c // 20] = max(most[c // 20], n)
    assert best == [(c, n, int(n == most[c // 20])) for c, n in flat]


@pytest.mark.parametrize("small", [False, True])
def test_rows(spark, library, monkeypatch, small):
    rows = [(i % 6 if i % 5 else None, t, "x", i) for i, t in enumerate(ODD * 2 + random_texts(60))]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_a string, run int").repartition(3)
    spec, model = byte_vocabulary(), piece_model()
    frame = alignment.align_documents(docs, spec, model)
    if small:
        monkeypatch.setattr(alignment, "FAN_IN", 2)
        frame = alignment.align_documents(docs.repartition(7), spec, model)
    assert sorted(repr(tuple(r)) for r in frame.collect()) == brute(library, rows)


def test_small_runs_and_memory(library, monkeypatch):
    """The map side with tiny limits, in this process."""
    monkeypatch.setattr(alignment, "MEMORY", 5)
    texts = [t for t in ODD if t and "▁" not in t] + random_texts(50)
    aligner = alignment.Aligner(byte_vocabulary(), piece_model())
    for text in texts:
        figures, shown, links, of = aligner.align([chunks(text), []])
        a, b = library.tokens(text)
        assert figures[:2, 0].tolist() == [len(a), len(b)]
        assert figures[3].tolist() == [len(links), 0]
        assert not of.any()


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, place int")
    assert alignment.align_documents(empty, byte_vocabulary(), piece_model()).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    found = alignment.align_documents(blank, byte_vocabulary(), piece_model()).collect()
    assert sorted(map(tuple, found)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op13_alignment"](spark, sf_dir).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(library, [(d.doc_id, d.text) for d in docs])
