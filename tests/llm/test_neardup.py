"""Near duplicates against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("wardline.llm")
from wardline.llm import neardup  # noqa: E402
from wardline.llm.components import components  # noqa: E402
from wardline.llm.queries import QUERIES  # noqa: E402
from wardline.llm.words import FOLDED, Words  # noqa: E402


def bag(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def alike(a, b):
    both = sum((a & b).values())
    return both and both / sum((a | b).values())


def classes_of(rows, pairs):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        first = min(ids, default=None)
        out += [(rows[i][0], first, len(members), rows[i][0] == first) for i in members]
    return sorted(map(repr, out))


def brute(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    holders = {}
    for i, b in enumerate(bags):
        for x in b:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for v in holders.values() for i in v for j in v if i < j}
    linked = [(i, j) for i, j in pairs if alike(bags[i], bags[j]) >= threshold]
    same = {}
    for i, (_, t) in enumerate(rows):
        linked.append((same.setdefault(t or "", i), i))
    return classes_of(rows, linked)


def got(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_signatures_agree_like_the_similarity():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    other = words[:300] + [f"v{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(other), " ".join(words), " ".join(rng.choices(words, k=9)), ""]
    text, unit = neardup.weighted_units(Words(texts, FOLDED, True), 5)
    signed = neardup.throw_darts(text, unit, len(texts), 4000)
    want = alike(bag(texts[0]), bag(texts[1]))
    assert abs((signed[0] == signed[1]).mean() - want) < 0.03
    assert (signed[0] == signed[2]).all()
    assert not signed[4].any() and signed[3].all()


def test_families_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = []
    for family in range(12):
        text = rng.choices(vocabulary, k=rng.choice([4, 12, 60, 300]))
        for _ in range(rng.choice([1, 3, 12])):
            rows.append((rng.randrange(1000) * 20 + family, " ".join(text)))
            for _ in range(rng.choice([0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rows += [(5, None), (5, ""), (6, "!!"), (7, "!! ?"), (None, rows[0][1]), (None, "null one two")]
    rows += [(9, "one two"), (8, "One, two!"), (3, "same " * 4000), (4, "same " * 4100), (3, "x" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("node", neardup.F.lit(1)).withColumn("content", neardup.F.lit("c"))
    assert got(neardup.near_duplicates(docs)) == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == 0


@pytest.mark.parametrize("weight", [1, 90, 10**6])
def test_outsiders_meet_everyone_of_another_class(spark, weight):
    rng = random.Random(weight)
    base = rng.choices([f"w{i}" for i in range(300)], k=40)
    texts = []
    for _ in range(30):
        text = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            text[rng.randrange(40)] = f"new{rng.randrange(9999)}"
        texts.append(" ".join(text))
    texts.append("")
    labels = [i if i % 3 else 0 for i in range(len(texts))]
    left = [(7, i, x) for i, x in enumerate(labels)] + [(8, i, labels[i]) for i in range(5)]
    left = spark.createDataFrame(left, "band long, node long, label long")
    nodes = spark.createDataFrame([(i, 36) for i in range(len(texts))], "node long, weight long")
    whole = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    dealt = neardup.blocks(left, nodes, weight)
    found = [(r.a, r.b) for r in neardup.link_outsiders(dealt, whole, 0.8, 5).collect()]
    bags = [bag(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if alike(bags[i], bags[j]) >= 0.8]
    assert {tuple(sorted(p, reverse=True)) for p in found} <= set(near)
    same = [(i, j) for i in range(len(texts)) for j in range(i) if labels[i] == labels[j]]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert classes_of(rows, found + same) == classes_of(rows, near + same)


@pytest.mark.parametrize("most", [10**6, 40])
def test_components(spark, monkeypatch, most):
    """Also with so few links a task that every star is salted."""
    monkeypatch.setattr("wardline.llm.components.LINKS_A_TASK", most)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert set(found) == set(near)
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert found[a] == min(seen)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(QUERIES["op10_near_dedup"](spark, sf_dir)) == brute(rows)


def test_recall_of_planted_copies(spark, sf_dir):
    """Copies by rate of changed words: all whose similarity is at least 0.8 are found; README states the table."""
    rng = random.Random(8)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    long = [t for t in dict.fromkeys(texts) if t and 150 <= len(t.split()) <= 1200][:60]
    rows, pairs, rates = [], [], (0.002, 0.005, 0.01, 0.02, 0.03, 0.05)
    for n, text in enumerate(long):
        # every original has words of its own, so that only planted pairs are near
        words = [f"{w}x{n}" for w in text.split()]
        for rate in rates:
            base = [f"{w}r{rate}" for w in words]
            copy = [f"new{rng.randrange(10**6)}" if rng.random() < rate else w for w in base]
            pairs.append((rate, len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    table = {}
    for rate in rates:
        own = [(alike(bag(rows[i][1]), bag(rows[j][1])), of[i] == of[j]) for r, i, j in pairs if r == rate]
        near = [found for s, found in own if s >= 0.8]
        table[rate] = len(own), len(near), sum(near), sum(found for _, found in own)
        assert all(near) and sum(found for _, found in own) == sum(near)
    print(table)
    assert table[0.01][1] > 50 and table[0.05][1] < 30
