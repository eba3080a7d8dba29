"""Hard negatives: products against numpy, heaps and whole results against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("wardline.llm")
from pyspark.sql import functions as F  # noqa: E402

from wardline.llm import negatives  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor string, id int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (65, 33, 70), (130, 64, 257), (0, 4, 3)])
def test_strassen(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for most in (5, 10**5, 10**8):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        for leaf in (2, 32):
            assert np.array_equal(negatives.strassen(a, b, leaf), a @ b)


def test_products_beyond_64_bits_are_refused():
    a = np.array([[2**40, 1]])
    assert negatives.scores(a, np.array([[2**20, 5, 3]])).tolist() == [[2**60 + 5]]
    big, small = np.array([[2**62, 0]]), np.array([[0, 2**40]])
    assert negatives.scores(big, small).tolist() == [[0]]
    with pytest.raises(OverflowError):
        negatives.scores(a, np.array([[2**40, 5]]))


def test_heaps_merge():
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(6), rng.random() < 0.1, rng.randrange(50)) for _ in range(400)]
    heaps = negatives.Heaps(4, 5)
    for at in range(0, 400, 37):
        heaps.add(*(np.array(c) for c in zip(*rows[at : at + 37])))
    want = []
    for slot in range(3):
        own = sorted((-s, m, i) for t, s, m, i in rows if t == slot)[:5]
        want += [(slot, -s, m, i) for s, m, i in own]
    assert list(zip(heaps.slot, heaps.score, heaps.missing, heaps.id)) == want


def brute(rows):
    used = []
    for n, (vec_id, vector, label, *_) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and math.fmod(vec_id, 7) == 0:
            label = (label + 1) % 10
        used.append((n, vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for n, anchor, vector, label in used:
        if anchor is None or anchor % 50:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(vector, v)), i is None, i or 0, own == label)
            for m, i, v, own in used
            if m != n
        )
        for ps, none, positive, _ in [s for s in scored if s[3]][:5]:
            fits = [s for s in scored if not s[3] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            for rank, (ns, missing, negative, _) in enumerate(fits, 1):
                out.append((anchor, None if none else positive, rank, None if missing else negative, -ps, -ns))
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine_negatives(frame, F.col("vec_id") % 50 == 0, label=moved, **options)
    return sorted(map(tuple, found.collect()), key=repr)


def awkward():
    rng = random.Random(7)
    rows = []
    for i in range(600):
        vector = [rng.choice([-0.5, 0.0, 0.1, 0.25, 0.4, 0.9]) for _ in range(rng.choice([6, 6, 6, 4]))]
        rows.append((i - 100, vector, rng.randrange(4), "x", "y", 1))
    same = [0.3, 0.3, 0.3, 0.3, 0.3, 0.3]
    rows += [(1000 + i, same, i % 3, None, None, None) for i in range(150)]
    rows += [(200, [0.9] * 6, 1, "", "", 0)] * 3 + [(None, [0.9] * 6, k, "", "", 0) for k in (1, 1, 2, 2)]
    rows += [
        (50 * 99, None, 1, "", "", 0),
        (50 * 98, [0.1, None], 1, "", "", 0),
        (50 * 97, [float("nan"), 1.0], 1, "", "", 0),
        (50 * 96, [float("-inf")], 1, "", "", 0),
        (50 * 95, [0.5] * 6, None, "", "", 0),
        (50 * 94, [], 1, "", "", 0),
        (50 * 93, [300.0] * 6, 2, "", "", 0),
    ]
    return rows


@pytest.mark.parametrize("options", [{}, {"round_bytes": 500}])
def test_brute_force(spark, monkeypatch, options):
    rows = awkward()
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark, rows, **options) == want


def test_small_tiles():
    """Many tiles and blocks of anchors through the same heaps."""
    rows = [r for r in awkward() if r[0] is not None and r[1] and r[2] is not None]
    rows = [r for r in rows if all(x is not None and math.isfinite(x) for x in r[1])]
    table = lambda part: pa.table(
        {
            "id": pa.array([r[0] for r in part], pa.int64()),
            "label": pa.array([r[2] for r in part], pa.int64()),
            "vector": pa.array([[256 * float(np.float32(x)) for x in r[1]] for r in part], pa.list_(pa.float64())),
            "anchor": [r[0] % 50 == 0 for r in part],
        }
    )
    for size in (7, 100):
        tiles = [negatives.Tile(negatives.packed(table(rows[i : i + size]), i)) for i in range(0, len(rows), size)]
        assert sum(len(range(*s.indices(t.rows.size))) for t in tiles for s in t.runs().values()) == len(rows)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [0.5], 1, "", "", 0)]) == []
    assert mined(spark, [(51, [0.5], 1, "", "", 0), (52, [0.5], 2, "", "", 0)]) == []
