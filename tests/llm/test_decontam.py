"""Decontamination against a brute-force version on planted and random words."""

import random
import re

import pytest

pytest.importorskip("wardline.llm")
from tests.compare import connect, differences  # noqa: E402
from wardline.llm import decontam  # noqa: E402
from wardline.llm.oracles import ORACLES  # noqa: E402
from wardline.llm.queries import QUERIES  # noqa: E402


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item_id, item in items:
            v = words_of(item)
            n = min(window, len(v))
            wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wanted:
                    hit.update(range(s, s + n))
                    if item_id is not None:
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(map(repr, out))


def test_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "É", "the", "x1"]
    draw = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, draw(rng.choice([1, 2, 3, 5, 9]))) for i in range(12)]
    items += [(3, "The a, b!"), (None, "zz the zz"), (50, ""), (51, None), (52, "rare " * 6)]
    docs = [(i, draw(rng.randrange(0, 40))) for i in range(30)]
    docs += [(5, None), (5, ""), (None, "zz THE zz the"), (7, "rare " * 5000), (8, "x" * 9000)]
    got = decontam.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn(
            "row", decontam.F.lit("clash")
        ),
        spark.createDataFrame(items, "item_id long, text string"),
        window=5,
    )
    rows = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()]
    assert sorted(map(repr, rows)) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.find_contamination(docs, items).collect()] == [0]
    none = spark.createDataFrame([], docs.schema)
    assert decontam.find_contamination(none, items).count() == 0


def test_matches_sql(spark, sf_dir):
    name = "op5_decontamination"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []
