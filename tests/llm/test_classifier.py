"""The network: exact gradient, whole texts, held-out accuracy, awkward rows."""

import zlib

import numpy as np
import pytest

pytest.importorskip("wardline.llm")
from wardline.llm import classifier as c  # noqa: E402
from wardline.llm.queries import QUERIES  # noqa: E402


def network(seed=1):
    net = c.train(["a"], np.array([1.0]), seed)
    rng = np.random.RandomState(seed)
    net.weights = rng.normal(0, 0.3, c.FEATURES).astype(np.float32)
    return net


TEXTS = ["", "short one", "É" * 400, "some words, UPPER and 123 | # " * 40, "x " * 90]


def test_gradient_is_exact():
    net, labels = network(), np.array([1, 0, 1, 0, 1.0])

    def loss():
        p = c.score_texts(net, TEXTS)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name in ("first", "second", "bias", "weights", "offset"):
        part = getattr(net, name).astype(np.float64)
        setattr(net, name, part)
    grads = c._gradients(net, c.Batch(TEXTS), labels)
    rng = np.random.RandomState(2)
    for name, grad in zip(("first", "second", "bias", "weights", "offset"), grads):
        part = getattr(net, name)
        for _ in range(6):
            at = tuple(rng.randint(n) for n in part.shape)
            old = part[at]
            part[at] = old + 1e-4
            up = loss()
            part[at] = old - 1e-4
            down = loss()
            part[at] = old
            assert abs((up - down) / 2e-4 - grad[at]) < 2e-3


def test_scores_do_not_depend_on_company_or_segments(monkeypatch):
    net = network()
    long = TEXTS + ["word " * 60_000 + "| # " * 50]
    want = np.concatenate([c.score_texts(net, [t]) for t in long])
    assert np.allclose(c.score_texts(net, long), want, atol=1e-5)
    monkeypatch.setattr(c, "SEGMENT", 3)
    assert np.allclose(c.score_texts(net, long), want, atol=1e-5)
    changed = c.score_texts(net, ["word " * 60_000 + "Z! " * 50])
    assert abs(changed[0] - want[-1]) > 1e-6  # the end of a long text counts


def naive(net, text):
    """Every window, chunk and feature one by one."""
    raw = text.encode()
    short = [float(len(raw) < n) for n in c.SHORT]
    raw += bytes((len(raw) // c.PAD + 1) * c.PAD - len(raw))
    filters = np.vstack([net.first, net.second])
    answers = []
    for at in range(0, len(raw), c.STEP):
        window = raw[at : at + 2 * c.STEP].ljust(2 * c.STEP, b"\0")
        codes = np.concatenate([c.CODES[b] for b in window])
        answers.append([max(0.0, float(codes @ filters[:, f] + net.bias[f])) for f in range(c.FILTERS)])
    blocks = len(answers) // c.BLOCK
    chunks = []
    for first in range(max(1, blocks - 1)):
        windows = answers[first * c.BLOCK : (first + 2) * c.BLOCK]
        chunks.append([max(w[f] for w in windows) for f in range(c.FILTERS)])
    features = [sum(x) / len(chunks) for x in zip(*chunks)]
    features += [max(x) for x in zip(*chunks)] + [min(x) for x in zip(*chunks)] + short
    z = sum(w * (x - s) / d for w, x, s, d in zip(net.weights, features, net.shift, net.scale))
    return 1 / (1 + np.exp(-(z + net.offset[0])))


def test_scores_equal_a_naive_convolution():
    net = network(3)
    rng = np.random.RandomState(4)
    net.shift = rng.normal(0, 1, c.FEATURES).astype(np.float32)
    net.scale = rng.uniform(0.5, 2, c.FEATURES).astype(np.float32)
    texts = [*TEXTS, "x" * c.PAD, "y" * (c.PAD - 1), "one two " * 31, "0123456789 | Z" * 60]
    got = c.score_texts(net, texts)
    assert np.allclose(got, [naive(net, t) for t in texts], atol=1e-5)


def test_long_labelled_texts_are_scored_and_not_learnt_from(spark):
    rows = [(i, f"text {i} of some words") for i in range(60)] + [(i, "long " * 40_000) for i in range(60, 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(64)], "doc_id long, quality int")
    whole, some = c.fit(docs, labels), c.fit(docs.where("doc_id < 60"), labels.where("doc_id < 60"))
    assert np.array_equal(whole.first, some.first) and np.array_equal(whole.weights, some.weights)
    assert c.score_documents(docs, whole).where("score between 0 and 1").count() == 64


def test_rows(spark):
    rows = [(1, "good words here", 9.0), (1, "good words here", 8.0), (None, None, 1.0), (2, "", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame(
        [(1, 1), (1, None), (2, 0), (None, 1), (3, 7)], "doc_id long, quality int"
    )
    net = c.fit(docs, labels)
    got = c.score_documents(docs, net).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (r[0] for r in rows)))
    assert all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], docs.schema)
    empty = c.fit(none, spark.createDataFrame([], labels.schema))
    assert c.score_documents(none, empty).count() == 0
    assert c.score_documents(docs, empty).count() == 4


def test_held_out_rows_are_not_learnt_from(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    flipped = labels.withColumn(
        "quality", c.F.when(c.held_out(), 1 - c.F.col("quality")).otherwise(c.F.col("quality"))
    )
    a, b = c.fit(docs, labels), c.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.first, b.first)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op2_quality_classifier"](spark, sf)
    marked = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in marked[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    test = [r for r in marked if r.held_out]
    good = [r.predicted for r in test if r.quality == 1]
    bad = [r.predicted for r in test if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
