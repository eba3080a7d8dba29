"""Bounded-load shards: balance, slots, order of the queue and limited movement."""

import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest

pytest.importorskip("wardline.llm")
from tests.compare import connect, differences  # noqa: E402
from wardline.llm import sharding  # noqa: E402
from wardline.llm.oracles import ORACLES  # noqa: E402
from wardline.llm.queries import QUERIES  # noqa: E402


def cell(text):
    return int(md5(text.encode()).hexdigest()[:4], 16)


def brute(rows, shards, nodes, load):
    """One key after the other: ring order to the owner, the rest clockwise to free places."""
    points, nodes_of = {}, defaultdict(set)
    for s in range(shards):
        for v in range(nodes):
            name = f"shard {s} node {v}"
            mark = md5(name.encode()).hexdigest(), s
            points[cell(name)] = min(points.get(cell(name), mark), mark)
            nodes_of[cell(name)].add(s)
    points = {c: s for c, (_, s) in points.items()}
    ring = sorted(points)
    place = lambda i: cell("" if i is None else str(i))
    owner = lambda c: points[next((p for p in ring if p >= c), ring[0])]
    keys = sorted(
        (place(i), zlib.crc32((t or "").encode()) % sharding.BLOCKS, i is not None, i or 0)
        for i, t in rows
    )
    total = max(len(rows), int(len(rows) * load))
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    load_of, moving = Counter(), []
    for k in keys:
        s = owner(k[0])
        if load_of[s] < capacity[s]:
            load_of[s] += 1
        else:
            moving.append(k)
    free = {}
    for s in range(shards):
        own = [c for c in ring if s in nodes_of[c]]
        left = capacity[s] - load_of[s]
        for i, c in enumerate(own):
            free[c, s] = left // len(own) + (i < left % len(own))
    # first in, first out around the ring, from a point where nobody waits
    by_cell = defaultdict(list)
    for k in moving:
        by_cell[k[0]].append(k)
    balance, least, start = 0, None, 0
    for c in range(sharding.CELLS):
        balance += len(by_cell[c]) - sum(free.get((c, s), 0) for s in nodes_of.get(c, ()))
        if least is None or balance < least:
            least, start = balance, c + 1
    waiting = []
    for turn in range(sharding.CELLS):
        c = (start + turn) % sharding.CELLS
        waiting += by_cell[c]
        for s in sorted(nodes_of.get(c, ())):
            taken = min(len(waiting), free[c, s])
            load_of[s] += taken
            waiting = waiting[taken:]
    assert not waiting
    return load_of, capacity


@pytest.mark.parametrize("load", [1.0, 1.3])
def test_balance_and_slots(spark, load):
    rows = [(i, "x" * (i % 7)) for i in range(400)]
    rows += [(7, "same")] * 150 + [(None, None), (None, ""), (-1, "é" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("cell", sharding.F.lit("clash")).repartition(3)
    got = sharding.assign_shards(docs, shards=6, nodes=8, load=load).collect()
    load_of, capacity = brute(rows, 6, 8, load)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert {s: len(v) for s, v in slots.items()} == {s: n for s, n in load_of.items() if n}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) <= capacity[s] for s, v in slots.items())
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got)
    if load == 1.0:
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize("shards, nodes", [(500, 1), (3000, 40)])
def test_many_shards_keep_every_row(spark, shards, nodes):
    """More nodes than cells: shards that own no cell still get their share."""
    docs = spark.range(6100).selectExpr("id as doc_id", "'t' as text")
    got = sharding.assign_shards(docs, shards=shards, nodes=nodes).collect()
    assert sorted(r.doc_id for r in got) == list(range(6100))
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 1


def test_null_ids_of_many_texts(spark):
    docs = spark.range(20000).selectExpr(
        "if(id % 3 = 0, id, null) as doc_id", "concat('text ', id) as text", "id as within"
    )
    got = sharding.assign_shards(docs, shards=7, nodes=64)
    slots = defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 20000
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_few_rows_leave_their_owner(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'t' as text")
    got = sharding.assign_shards(docs, shards=10, nodes=256)
    away = got.where("shard <> owner").count()
    assert 0 < away < 0.12 * 20000


def test_empty_and_refused(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign_shards(docs, shards=3).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, load=0.9)


def test_matches_sql(spark, sf_dir):
    name = "op1_sharding"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []
