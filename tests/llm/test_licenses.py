"""Licence scans against a brute-force version."""

import random
import re

import pytest

pytest.importorskip("wardline.llm")
from tests.compare import connect, differences  # noqa: E402
from wardline.llm import licenses  # noqa: E402
from wardline.llm.oracles import ORACLES  # noqa: E402
from wardline.llm.queries import QUERIES  # noqa: E402


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(rows, threshold=0.8):
    out = []
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(WORD, low)
        places, base = [], set()
        for label, phrase in licenses.PHRASES.items():
            p = phrase.split()
            at = [s for s in range(len(w)) if w[s : s + len(p)] == p]
            places += at
            if at:
                base.add(label)
        best, found = 0.0, set()
        for label, notice, must in licenses.TEMPLATES:
            t, block = set(notice.split()), licenses.block_of(notice)
            for s in range(0, len(w), block // 2):
                own = set(w[s : s + block])
                if len(t & own) >= threshold * len(t) and own >= set(must.split()):
                    found.add(label)
                    best = max(best, len(t & own) / len(t))
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None),
                    sorted(base), sorted(base | found), 1.0 if places else best))
    return sorted(map(repr, out))


def test_brute_force(spark):
    rng = random.Random(5)
    filler = ["of", "the", "and", "license", "by", "rights", "É", "x"]
    rows = []
    for i in range(80):
        words = rng.choices(filler, k=rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                notice[rng.randrange(len(notice))] = "odd"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    rows += [(3, None), (3, ""), (None, "CC BY-SA, cc by cc, BY"), (5, "All Rights reserved. " * 3000)]
    rows += [(None, "CC BY-SA, cc by cc, BY"), (6, "general public license" + "y" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "row", licenses.F.lit("clash")
    ).withColumn("words", licenses.F.lit("clash"))
    got = [tuple(r) for r in licenses.scan_licenses(docs).collect()]
    assert sorted(map(repr, got)) == brute(rows)


def test_siblings_are_told_apart(spark):
    notices = {
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC-BY-NC 4.0": "cc-by,cc-by-nc",
        "licensed under the GNU General Public License, version 2.0": "gpl",
        "This work is licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0",
        "This work is licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
        "Licensed under the Apache License, Version 2.0": "apache-2.0",
        "Licensed under the Apache License": "",
        "Released under the MIT License": "mit",
        licenses.TEMPLATES[10][1]: "mit",
        "x " * 70 + licenses.TEMPLATES[1][1].replace("writing", "ink") + " y" * 200: "apache-2.0",
    }
    docs = spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string")
    got = {r.doc_id: ",".join(r.labels) for r in licenses.scan_licenses(docs).collect()}
    assert got == dict(enumerate(notices.values()))


def test_long_notices_and_empty_tables(spark):
    """A notice of hundreds of words, whole in a text at any place."""
    notice = " ".join(f"clause{i}" for i in range(300))
    rows = [(i, "w " * (97 * i) + notice + " z" * 40) for i in range(12)] + [(99, notice[: len(notice) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan_licenses(docs, templates=(("long", notice, "clause299"),))
    assert {r.doc_id: r.labels for r in found.collect()} == {i: ["long"] if i < 99 else [] for i, _ in rows}
    empty = spark.createDataFrame([], docs.schema)
    assert licenses.scan_licenses(empty).count() == 0


def test_matches_sql(spark, sf_dir):
    name = "op3_license_scan"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []
