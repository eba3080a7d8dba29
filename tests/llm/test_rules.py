"""Quality rules: figures against brute force, bounds against exact sums, cutoffs end to end."""

import math
import random
import re

import pytest

pytest.importorskip("wardline.llm")
from tests.compare import connect, differences  # noqa: E402
from wardline.llm import rules  # noqa: E402
from wardline.llm.oracles import ORACLES, _rules_sql  # noqa: E402
from wardline.llm.queries import QUERIES  # noqa: E402
from wardline.llm.tables import read_table  # noqa: E402


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    under = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(rules.SYMBOL, text)), len(lines) - len(set(lines)),
        len(under), n < 10 or 100 * len(under) > 20 * n,
    )


def test_figures(spark):
    rng = random.Random(6)
    texts = [None, "", " \n ", "a", "| # x\n| # x\n\n\n", "É Ü 😀 <a>", "same\x00word " * 40, "z" * 50000]
    for _ in range(60):
        k = rng.randrange(0, 60)
        texts.append("".join(rng.choice(["a", "b", "A&"]) + rng.choice([" ", "\n", "\t "]) for _ in range(k)))
    rows = [(i, t, "en", i) for i, t in enumerate(texts)] + [(None, "x", None, 1), (0, "y", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")
    got = rules.features(docs, "words", "lang").collect()
    key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, more, *brute(t)) for i, t, _, more in rows]
    assert sorted(map(repr, want)) == sorted(
        repr((r.doc_id, r.carried.words, *(r[k] for k in key))) for r in got
    )
    assert {r.stratum for r in got if r.doc_id is None} == {""}


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 30, 400, 5000) for k in (0, 1, 3, n // 100) for p in (0.01, 0.2)]
    F = rules.F
    for k, n, p in cases:
        row = spark.range(1).select(
            rules.binomial_tail(F.lit(float(k)), F.lit(float(n)), p).alias("x")
        ).first()
        exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n < 500 else None
        if k >= n * p:
            assert row.x == 1.0
        elif exact is not None:
            assert math.isclose(row.x, exact, rel_tol=1e-9)
        else:
            assert 0 <= row.x < 1


def test_cutoffs_keep_good_documents(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(1200):
        good = i % 4 > 0
        words = [f"w{rng.randrange(9999)}" + ("" if good else rng.choice(["|", "#", ""])) for _ in range(20)]
        rows.append((i, " ".join(words), "en" if i % 8 else "xx"))
        marks.append((i, int(good)))
    marks += [(0, None), (None, 1), (5, 1), (5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    figures = rules.features(docs)
    learnt = rules.cutoffs(figures, labels, alpha=0.2).collect()
    assert [r.stratum for r in learnt] == ["en"]  # the other one has too few good documents
    assert learnt[0].cut_symbols is not None and learnt[0].cut_dup_lines is None
    judged = rules.verdicts(figures, rules.cutoffs(figures, labels, alpha=0.2)).collect()
    by = {r.doc_id: r.kept for r in judged}
    assert len(by) == len(rows)
    assert all(by[i] for i, good in marks[:1200] if good)
    assert sum(not by[i] for i, good in marks[:1200] if not good) > 100


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    figures = rules.features(docs)
    assert rules.verdicts(figures, rules.cutoffs(figures, labels)).count() == 0
    one = rules.features(spark.createDataFrame([(1, "w " * 12, "en")], docs.schema))
    assert rules.verdicts(one, rules.cutoffs(one, labels)).count() == 1


def test_matches_sql(spark, sf_dir):
    name = "op4_quality_rules"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


def test_matches_sql_where_cutoffs_are_in_use(spark):
    sf = "/root/testdata/sf0.01"
    figures = rules.features(read_table(spark, sf, "documents"))
    learnt = rules.cutoffs(figures, read_table(spark, sf, "labels"), alpha=0.5, delta=0.9)
    got = rules.verdicts(figures, learnt).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
    assert got.where("not kept and not base_failed").count() > 0
    assert differences(got, connect(sf), _rules_sql(0.5, 0.9)) == []
