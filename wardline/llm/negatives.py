"""Hard negatives by exact integer scores: Strassen products of tiles, then bounded heaps.

Rows are packed into tiles of whole numbers. Anchors go round by round (a round has a fixed size in bytes and
is broadcast); in a round every task multiplies its tiles with the round's anchors, all in
64-bit integers, and keeps two kinds of heaps: the first positives of every anchor, and, once those
are merged, the first negatives of every (anchor, positive) inside the window of scores that the positive
sets. Heaps of a slot merge by taking the first of both, so a task hands on a fixed number of rows
a slot and no pair is ever a row.

Each pass compares what it needs once: positives only runs of one label, negatives whole tiles.

Recovery: tiles, anchors and each round's result are stored in the shared folder; tasks hold nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.tables import stored
from wardline.session import scratch_path

#: Rows of a tile, and anchors multiplied with it at a time.
TILE_ROWS = 2048
ANCHOR_ROWS = 512
#: Bytes of anchors in a round.
ROUND_BYTES = 32_000_000
#: Side from which a product is cut into quarters.
LEAF = 32
#: Hits a row of a product may have on average before its best are looked for first.
MANY = 8

_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_TILE = "n int, dim int, kind string, vectors binary, ids binary, missing binary, labels binary, first_row long, anchors binary"
_HEAP = "anchor long, slot int, score long, id long, missing boolean"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of 64-bit integers; in doubles where no sum can leave what they hold exactly."""
    if not (a.size and b.size):
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _padded(a: np.ndarray) -> np.ndarray:
    rows, columns = a.shape
    if rows % 2 or columns % 2:
        a = np.pad(a, ((0, rows % 2), (0, columns % 2)))
    return a


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` by seven products of quarters; odd sides get a row or column of zeros.

    Sums are integers modulo 2^64, so the result is exact whenever it fits, whatever sums stand between.
    """
    if min(a.shape[0], a.shape[1], b.shape[1]) <= leaf:
        return product(a, b)
    rows, columns = a.shape[0], b.shape[1]
    a, b = _padded(a), _padded(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), np.int64)
    c11, c12, c21, c22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:] = p
    c22[:] = p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :columns]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two tiles; the shorter vectors count as filled up with zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    if a.size and b.size:
        # abs() of the lowest integer is negative, so it is taken in doubles
        most = np.abs(a.astype(np.float64)).max() * np.abs(b.astype(np.float64)).max() * width
        if most >= 2.0**62:
            about = np.abs(a.astype(np.float64) @ b.astype(np.float64).T)
            if about.max() >= 2.0**62:
                raise OverflowError("an inner product does not fit into 64 bits")
            return a @ b.T
    return strassen(a, b.T)


class Heaps:
    """The first ``size`` entries of each slot: higher score, then smaller id, a missing id last."""

    def __init__(self, slots: int, size: int) -> None:
        self.size = size
        self.slot = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.missing = np.empty(0, bool)
        self.id = np.empty(0, np.int64)
        #: what an entry has to reach to enter a slot: a score and, at that score, an id
        self.cut = np.full(slots, _LOWEST)
        self.cut_id = np.full(slots, _HIGHEST)

    def add(self, slot: np.ndarray, score: np.ndarray, missing: np.ndarray, id: np.ndarray) -> None:
        ranked = np.where(missing, _HIGHEST, id)
        better = (score > self.cut[slot]) | ((score == self.cut[slot]) & (ranked <= self.cut_id[slot]))
        if not better.any():
            return
        slot, score, missing, id = (
            np.concatenate((old, new[better]))
            for old, new in (
                (self.slot, slot),
                (self.score, score),
                (self.missing, missing),
                (self.id, id),
            )
        )
        # ~x reverses the order of integers and cannot overflow
        order = np.lexsort((id, missing, ~score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        stay = rank < self.size
        order, self.slot, rank = order[stay], slot[stay], rank[stay]
        self.score, self.missing, self.id = score[order], missing[order], id[order]
        last = rank == self.size - 1
        full = self.slot[last]
        self.cut[full] = self.score[last]
        self.cut_id[full] = np.where(self.missing[last], _HIGHEST, self.id[last])


class Tile:
    """Rows of whole numbers, sorted by label."""

    def __init__(self, row: dict) -> None:
        shape = row["n"], row["dim"]
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(shape).astype(np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.missing = np.frombuffer(row["missing"], bool)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.anchors = np.frombuffer(row["anchors"], bool)
        self.rows = row["first_row"] + np.arange(row["n"])

    def runs(self) -> dict[int, slice]:
        """By label, where its rows stand."""
        edges = np.flatnonzero(np.diff(self.labels, prepend=self.labels[:1] - 1)).tolist()
        return {int(self.labels[a]): slice(a, b) for a, b in zip(edges, [*edges[1:], len(self.labels)])}


def packed(batch: pa.Table, first_row: int) -> dict:
    """A tile of the rows of ``batch`` (id, label, vector, anchor), in the least kind of integer."""
    column = batch.column("vector").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    dim = int(sizes.max(initial=0))
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 2.0**63:
        raise OverflowError("a component does not fit into 64 bits")
    vectors = np.zeros((len(sizes), dim), np.int64)
    vectors[np.arange(dim) < sizes[:, None]] = flat.astype(np.int64)
    labels = batch.column("label").to_numpy().astype(np.int64)
    order = np.argsort(labels, kind="stable")
    vectors = vectors[order]
    kind = "<i2" if not vectors.size or (vectors.min() >= -(2**15) and vectors.max() < 2**15) else "<i8"
    ids = batch.column("id")
    return {
        "n": len(sizes),
        "dim": dim,
        "kind": kind,
        "vectors": vectors.astype(kind).tobytes(),
        "ids": ids.fill_null(0).to_numpy().astype(np.int64)[order].tobytes(),
        "missing": ids.is_null().to_numpy()[order].tobytes(),
        "labels": labels[order].tobytes(),
        "first_row": first_row,
        "anchors": batch.column("anchor").to_numpy()[order].tobytes(),
    }


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("n", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), ("vectors", pa.binary())]
        + [(c, pa.binary()) for c in ("ids", "missing", "labels")]
        + [("first_row", pa.int64()), ("anchors", pa.binary())]
    )
    row = TaskContext.get().partitionId() << 33
    waiting: list[pa.RecordBatch] = []
    size = 0

    def tile() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([packed(pa.Table.from_batches(waiting), row)], schema)

    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, TILE_ROWS - size)
            waiting.append(some)
            size += some.num_rows
            batch = batch.slice(some.num_rows)
            if size == TILE_ROWS:
                yield tile()
                row, waiting, size = row + size, [], 0
    if size:
        yield tile()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for line in batch.to_pylist():
            t = Tile(line)
            at = np.flatnonzero(t.anchors)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t.rows[at]),
                    pa.array(t.ids[at], mask=t.missing[at]),
                    pa.array(t.labels[at]),
                    pa.array([t.vectors[i].tobytes() for i in at], pa.binary()),
                ],
                names=["anchor", "id", "label", "vector"],
            )


class Anchors:
    """The anchors of a round, sorted by label; slots number their windows of scores."""

    def __init__(self, found: list) -> None:
        found = sorted(found, key=lambda r: (r.label, r.anchor))
        vectors = [np.frombuffer(r.vector, np.int64) for r in found]
        width = max(map(len, vectors), default=0)
        self.vectors = np.zeros((len(found), width), np.int64)
        for i, v in enumerate(vectors):
            self.vectors[i, : len(v)] = v
        self.rows = np.array([r.anchor for r in found], np.int64)
        self.labels = np.array([r.label for r in found], np.int64)
        self.place = {r.anchor: i for i, r in enumerate(found)}

    def windows(self, found: list, size: int, low: int, high: int) -> None:
        """Bounds by (slot, anchor) of the windows; an empty one where an anchor lacks a positive."""
        self.low = np.full((size, len(self.rows)), _HIGHEST)
        self.high = np.full((size, len(self.rows)), _LOWEST)
        for r in found:
            at = r.rank - 1, self.place[r.anchor]
            # low * positive <= 100 * negative <= high * positive, in whole numbers of any size
            self.low[at] = -((-low * r.score) // 100)
            self.high[at] = high * r.score // 100


def _hits(found: np.ndarray, low: np.ndarray, high: np.ndarray, fits: Callable, size: int) -> tuple:
    """Rows and columns of the scores within the bounds of their row; the best ones if they are many."""
    mask = found >= low[:, None]
    mask &= found <= high[:, None]
    if np.count_nonzero(mask) > MANY * len(found):
        mask &= fits()
        best = np.where(mask, found, _LOWEST)
        at = max(0, best.shape[1] - size)
        mask &= found >= np.partition(best, at, axis=1)[:, at][:, None]
        return np.nonzero(mask)
    rows, columns = np.nonzero(mask)
    if len(rows):
        stay = fits()[rows, columns]
        rows, columns = rows[stay], columns[stay]
    return rows, columns


def positives_of(anchors: Anchors, tiles: Iterator[Tile], size: int) -> Heaps:
    """The first rows of each anchor's label but itself."""
    heaps = Heaps(len(anchors.rows), size)
    starts = {}
    for label in np.unique(anchors.labels).tolist():
        starts[label] = np.searchsorted(anchors.labels, [label, label + 1]).tolist()
    for tile in tiles:
        for label, run in tile.runs().items():
            first, end = starts.get(label, (0, 0))
            for a in range(first, end, ANCHOR_ROWS):
                b = min(end, a + ANCHOR_ROWS)
                found = scores(anchors.vectors[a:b], tile.vectors[run])
                fits = lambda: anchors.rows[a:b, None] != tile.rows[None, run]  # noqa: B023, E731
                high = np.full(b - a, _HIGHEST)
                i, j = _hits(found, heaps.cut[a:b], high, fits, size)
                heaps.add(i + a, found[i, j], tile.missing[run][j], tile.ids[run][j])
    return heaps


def negatives_of(anchors: Anchors, tiles: Iterator[Tile], size: int) -> Heaps:
    """The first rows of other labels in each window; slot = window * anchors + anchor."""
    windows, n = anchors.low.shape
    heaps = Heaps(windows * n, size)
    for tile in tiles:
        for a in range(0, n, ANCHOR_ROWS):
            b = min(n, a + ANCHOR_ROWS)
            found = scores(anchors.vectors[a:b], tile.vectors)
            fits = lambda: anchors.labels[a:b, None] != tile.labels[None, :]  # noqa: B023, E731
            for w in range(windows):
                first = w * n + a
                low = np.maximum(anchors.low[w, a:b], heaps.cut[first : first + b - a])
                i, j = _hits(found, low, anchors.high[w, a:b], fits, size)
                heaps.add(i + first, found[i, j], tile.missing[j], tile.ids[j])
    return heaps


def _heaped(tiles: DataFrame, shared: Broadcast, work: Callable, size: int) -> DataFrame:
    """Every task's heaps as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        found = (Tile(line) for b in batches for line in b.to_pylist())
        heaps = work(known, found, size)
        n = max(1, len(known.rows))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(known.rows[heaps.slot % n]),
                pa.array((heaps.slot // n).astype(np.int32)),
                pa.array(heaps.score),
                pa.array(heaps.id, mask=heaps.missing),
                pa.array(heaps.missing),
            ],
            names=["anchor", "slot", "score", "id", "missing"],
        )

    return tiles.mapInArrow(run, _HEAP)


def _merged(heaps: DataFrame, size: int) -> DataFrame:
    """The first rows of each slot over all tasks, numbered from 1 as ``rank``."""
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "missing", "id")
    return heaps.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)


def mine_negatives(
    rows: DataFrame,
    anchors: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: float = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    Components become ``floor(scale * x)``; a score is the integer inner product with an anchor, a row for
    which ``anchors`` holds. Positives are the first ``positives`` other rows of the anchor's label, by
    score, then by smaller id. Negatives are, for each positive, the first ``negatives`` rows of another label
    with ``low * positive <= 100 * negative <= high * positive``.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A null id
    comes last among equal scores. Rows with one id are rows of their own, so repeated rows of an
    anchor are each other's positives and each has its own result. A shorter vector counts as
    filled up with zeros, an empty one scores 0. Where no row fits, or the table is empty, there are no
    rows. A score beyond 64 bits raises ``OverflowError``. Other columns are ignored.
    """
    spark = rows.sparkSession
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    label = F.col(label) if isinstance(label, str) else label
    used = rows.where(finite & label.isNotNull()).select(
        F.col(id).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale))).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    tiles = stored(used.mapInArrow(_tiles, _TILE), "tiles")
    searched = stored(
        tiles.mapInArrow(_anchors, "anchor long, id long, label long, vector binary"), "anchors"
    )
    size = searched.agg(F.sum(F.length("vector") + 32)).first()[0] or 0
    rounds = max(1, math.ceil(size / round_bytes))
    path = scratch_path(spark, "negatives")
    for r in range(rounds):
        turn = searched.where(F.pmod(F.xxhash64("anchor"), F.lit(rounds)) == r)
        known = Anchors(turn.collect())
        shared = spark.sparkContext.broadcast(known)
        first = stored(_merged(_heaped(tiles, shared, positives_of, positives), positives), "positives")
        shared.unpersist()
        known.windows(first.collect(), positives, low, high)
        shared = spark.sparkContext.broadcast(known)
        heaps = _merged(_heaped(tiles, shared, negatives_of, negatives), negatives)
        chosen = first.select(
            "anchor",
            (F.col("rank") - 1).alias("slot"),
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        )
        (
            heaps.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
            .join(chosen, ["anchor", "slot"])
            .join(turn.select("anchor", F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
            .write.mode("append")
            .parquet(path)
        )
        # stored; executors need not keep the anchors of past rounds
        shared.unpersist()
    return spark.read.schema(
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    ).parquet(path)
