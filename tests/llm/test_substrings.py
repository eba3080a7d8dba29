"""Repeated windows against a brute-force version on planted, random and awkward texts."""

import random
import re

import pytest

pytest.importorskip("wardline.llm")
from tests.compare import connect, differences  # noqa: E402
from wardline.llm import substrings  # noqa: E402
from wardline.llm.oracles import ORACLES  # noqa: E402
from wardline.llm.queries import QUERIES  # noqa: E402


def brute(rows, window):
    """For distinct ids."""
    big = substrings.LAST_ID
    docs = [(big if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or ""), i) for i, t in rows]
    seen, out = set(), []
    for _, words, i in sorted(docs, key=lambda d: d[0]):
        gone = set()
        for s in range(len(words) - window + 1):
            run = tuple(words[s : s + window])
            if run in seen:
                gone.update(range(s, s + window))
            seen.add(run)
        kept = [w for at, w in enumerate(words) if at not in gone]
        out.append((i, " ".join(kept), len(words), len(gone)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("window", [10, 13, 20])
def test_brute_force(spark, window, monkeypatch):
    rng = random.Random(window)
    # small chunks: some blocks meet in a task, some only after the shuffle
    monkeypatch.setattr(substrings, "CHUNK", {10: 40, 13: 10**6, 20: 1}[window])
    draw = lambda n, v: rng.choices(v, k=n)
    few, many = ["a", "b"], [f"w{i}" for i in range(3000)]
    passages = [draw(rng.randrange(8, 60), many) for _ in range(12)] + [draw(40, few)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 7)):
            piece = list(rng.choice(passages)) if rng.random() < 0.6 else draw(15, many)
            if rng.random() < 0.3:
                piece[rng.randrange(len(piece))] = "odd"
            words += piece[rng.randrange(3) :]
        rows.append((i * 7 % 60, "\t".join(words)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "same " * 500), (104, "same\x00 " + "same " * 30)]
    rows += [(105, "é" * 9000 + " x" * 30), (None, rows[3][1]), (106, rows[3][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "id", substrings.F.lit("clash")
    )
    got = substrings.remove_repeats(docs.repartition(3), window).collect()
    assert sorted(repr(tuple(r)[:4]) for r in got) == brute(rows, window)
    whole_passages(rows, got, window)


def whole_passages(rows, got, window):
    """Factors cover what is removed; each is long enough and stands earlier as one passage."""
    big = substrings.LAST_ID
    texts = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    joined = {}
    for r in got:
        words, gone = texts[r.doc_id], set()
        for f in r.factors:
            assert f.words >= window
            gone.update(range(f.start, f.start + f.words))
            passage = "\t" + "\t".join(words[f.start : f.start + f.words]) + "\t"
            earlier = (big if r.doc_id is None else r.doc_id, f.start)
            assert any(
                passage in joined.setdefault(i, "\t" + "\t".join(other) + "\t")
                and (
                    (big if i is None else i) < earlier[0]
                    or (i == r.doc_id and any(other[s : s + f.words] == words[f.start : f.start + f.words] for s in range(f.start)))
                )
                for i, other in texts.items()
            )
        assert len(gone) == r.n_removed


def test_factors():
    span = lambda start, n, line: {"start": start, "n": n, "line": line}
    assert substrings.factors_of([], 20) == []
    # one line, then another source, then a gap; a place met twice counts once
    spans = [span(9, 3, 7), span(0, 5, 7), span(5, 4, 7), span(12, 2, 8), span(20, 1, 8), span(5, 4, 9)]
    assert substrings.factors_of(spans, 20) == [(0, 31), (12, 21), (20, 20)]


def test_long_passages_are_one_factor(spark):
    passage = " ".join(f"p{i}" for i in range(500))
    rows = [(1, passage), (2, "own words first " + passage + " and after"), (3, passage + " x " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: [], 2: [(3, 500)], 3: [(0, 500), (501, 500)]}


def test_chunk_hands_on_blocks_marks_and_windows():
    np = substrings.np
    chunk = substrings.Chunk()
    # anchor 5: one block in two places; anchor 6: two blocks that share their first window
    columns = ([6, 5, 5, 6], [71, 1, 1, 72], [3, 2, 1, 4], [0] * 4, [9, 3, 9, 9], [2, 1, 1, 2])
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
    places = substrings.Places(*(np.array(c, k) for c, k in zip(columns, kinds)))
    chunk.add(places, np.array([801, 802, 90, 90, 801, 803], np.uint64))
    rows = [r for b in chunk.flush() for r in b.to_pylist()]
    found = sorted(
        (r["place"] & 255, r["hash"], r["id"], r["place"] >> 16, r["place"] >> 8 & 255) for r in rows
    )
    assert found == [
        (substrings.BLOCK, 1, 1, 9, 1),
        (substrings.MARK, 0, 0, 0, 0),
        (substrings.WINDOW, 801, 3, 9, 1),
        (substrings.WINDOW, 802, 3, 10, 1),
        (substrings.WINDOW, 803, 4, 10, 1),
        (substrings.AGAIN, 3, 4, 9, 1),
        (substrings.AGAIN, 1 ^ 6 << 16, 2, 3, 1),  # its source: document 1, six words further on
    ]
    assert {r["group"] for r in rows if r["place"] & 255 in (0, 1)} == {5, 6}


def test_repeated_rows_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 25)]
    empty = spark.createDataFrame([], docs.schema)
    assert substrings.remove_repeats(empty).count() == 0


def test_texts_of_one_id_are_told_apart(spark, monkeypatch):
    """Tags that clash are mixed anew; a text that stands once keeps its words."""
    tag_of, tried = substrings.tag_of, []

    def clashing(digest, salt):
        tried.append(salt)
        return tag_of(digest, salt) if salt > 1 else substrings.F.lit(salt).cast("long")

    monkeypatch.setattr(substrings, "tag_of", clashing)
    a, b = (" ".join(f"{x}{i}" for i in range(25)) for x in "ab")
    rows = [(1, a), (None, a), (None, b), (None, b), (2, "short"), (2, a + " " + b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(map(repr, got)) == sorted(
        map(repr, [(1, 25, 0), (None, 25, 25), (None, 25, 25), (None, 25, 25), (2, 1, 0), (2, 50, 25)])
    )
    assert 2 in tried


def test_many_texts_of_one_id(spark):
    texts = [" ".join(f"w{n}x{i}" for i in range(21)) for n in range(400)]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts[:200]] + [(7, texts[0] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.remove_repeats(docs).collect()
    removed = [r.n_removed for r in got if r.doc_id is None]
    assert sorted(removed) == [0] * 200 + [21] * 200
    assert sorted(r.n_removed for r in got if r.doc_id == 7) == [0] * 200 + [21]


def test_matches_sql(spark, sf_dir):
    name = "op8_substring_dedup"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []
