"""Near duplicates by DartMinHash signatures, banded joins and exact verification.

Element and weight: a shingle of five words and how often the text holds it. Each unit of weight is a
region that darts hit at random ranks (a Poisson process drawn from the unit's hash, so equal regions
of two texts get equal darts). A text throws the darts whose rank lies under a threshold that shrinks
with its total weight, so that about ``k (ln k + 2)`` are thrown however long it is; each dart lands on
one of ``k`` coordinates, and a coordinate keeps the earliest. Two signatures agree in a coordinate
with the probability of the weighted Jaccard similarity of the texts.

Equal texts are one node. Bands of equal coordinates form buckets. No bucket emits all its pairs: first its
members are compared with one centre, and links are verified on the whole texts. What the links connect
needs no more tests for its class. Buckets that still fall into several classes are joined to clusters,
and in each cluster the outsiders (all nodes but its largest class) are compared with every node of
another class, exactly and block by block: a task holds two blocks of bounded weight and returns only
the links that join classes. So a bucket of any size loses no link between its classes. Text moves only
for nodes that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.components import components
from wardline.llm.tables import slices, stored, texts
from wardline.llm.words import FOLDED, Words, mix, seeded

SHINGLE = 5
#: Agreement of signatures under which a pair is not verified, as a share of the similarity asked
#: for: six standard deviations below it at 96 coordinates.
AGREEMENT = 0.68
#: Units of weight in a block of the comparison of outsiders.
BLOCK_WEIGHT = 200_000
SALTS = 16


def weighted_units(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, unit) of every unit of weight: a shingle's copies are numbered and hashed apart.

    A text of fewer than ``n`` words is one shingle; one without words has no unit.
    """
    of = [words.text_of()[: max(0, len(words) - n + 1)][words.whole(n)]]
    hashes = [words.runs(n)[words.whole(n)]]
    for few in range(1, n):
        short = np.flatnonzero(words.counts == few)
        if len(short):
            of.append(short)
            hashes.append(words.runs(few)[words.first[short]])
    text, shingle = np.concatenate(of), np.concatenate(hashes)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    starts = np.flatnonzero(new)
    copy = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
    return text, mix(shingle + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def throw_darts(text: np.ndarray, unit: np.ndarray, count: int, k: int) -> np.ndarray:
    """Signatures of ``count`` texts: per coordinate the id of its earliest dart."""
    out = np.zeros((count, k), np.int32)
    weight = np.bincount(text, minlength=count)
    limit = k * (np.log(k) + 2) / np.maximum(weight, 1)
    left = weight > 0
    while left.any():
        live = np.flatnonzero(left[text])
        rank = np.zeros(len(live))
        slots, ranks, ids = [], [], []
        number = 0
        while len(live):
            # the next dart of every region comes after an exponential gap
            drawn = seeded(unit[live], 2 * number + 1)
            rank -= np.log(((drawn >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53)
            keep = rank < limit[text[live]]
            live, rank = live[keep], rank[keep]
            dart = seeded(unit[live], 2 * number + 2)
            slots.append(text[live] * k + (dart % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            ids.append((dart >> np.uint64(32)).astype(np.uint32).view(np.int32))
            number += 1
        slot, rank, dart = map(np.concatenate, (slots, ranks, ids))
        order = np.argsort(-rank, kind="stable")
        found = np.zeros((count, k), bool)
        flat = out.reshape(-1)
        flat[slot[order]] = dart[order]  # the last written is the earliest dart
        found.reshape(-1)[slot] = True
        left &= ~found.all(axis=1)
        limit = np.where(left, 2 * limit, limit)  # an empty coordinate: look at later ranks
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of units."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def signatures(docs: DataFrame, k: int, shingle: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, content, weight, signature) and ``carry`` of rows of (doc_id, content, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text").to_pylist(), FOLDED, True)
            text, unit = weighted_units(words, shingle)
            found = throw_darts(text, unit, part.num_rows, k)
            weight = np.bincount(text, minlength=part.num_rows)
            offsets = np.arange(part.num_rows + 1, dtype=np.int32) * k
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("content"),
                    pa.array(weight, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1), pa.int32())),
                    *(part.column(c) for c in carry),
                ],
                names=["doc_id", "content", "weight", "signature", *carry],
            )

    kinds = dict(docs.dtypes)
    schema = "doc_id long, content binary, weight long, signature array<int>"
    return docs.mapInArrow(sign, schema + "".join(f", `{c}` {kinds[c]}" for c in carry))


def salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def to_all_salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def buckets(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, node): the buckets that at least two nodes share."""
    keys = [
        F.xxhash64(F.lit(b), *(F.col("signature")[b * rows + r] for r in range(rows)))
        for b in range(bands)
    ]
    members = nodes.where(F.col("weight") > 0).select(
        "node", F.explode(F.array(*keys)).alias("band")
    )
    shared = members.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    return salted(members, "node").join(to_all_salts(shared), ["band", "salt"]).select("band", "node")


def to_centres(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's least node and its other members."""
    centre = members.groupBy("band").agg(F.min("node").alias("a"))
    met = salted(members.withColumnRenamed("node", "b"), "b").join(
        to_all_salts(centre), ["band", "salt"]
    )
    return met.where("a <> b").select("a", "b").distinct()


def unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, label): buckets whose members lie in several classes."""
    own = members.join(labels, "node", "left").select(
        "band", "node", F.coalesce("root", "node").alias("label")
    )
    own = stored(own, "labelled")
    mixed = own.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    mixed = to_all_salts(mixed.where(F.col("x") != F.col("y")).select("band"))
    return salted(own, "node").join(mixed, ["band", "salt"]).select("band", "node", "label")


def blocks(left: DataFrame, nodes: DataFrame, weight: int) -> DataFrame:
    """Outsiders and the others of each cluster of ``left``, dealt to pairs of blocks.

    (cluster, kind, i, j, node, label, outside): kind 0 holds block i of the outsiders and block j
    of the largest class, kind 1 two blocks of outsiders. A block has about ``weight`` units.
    """
    centre = left.groupBy("band").agg(F.min("node").alias("u"))
    shares = salted(left.withColumnRenamed("node", "v"), "v").join(
        to_all_salts(centre), ["band", "salt"]
    )
    cluster = components(shares.select("u", "v")).withColumnRenamed("root", "cluster")
    own = stored(
        left.select("node", "label").distinct().join(cluster, "node").join(
            nodes.select("node", "weight"), "node"
        ),
        "clusters",
    )
    sizes = own.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    totals = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "label", "w")).alias("main"), F.sum("w").alias("all")
    )
    count = lambda w: F.greatest(F.ceil(w / weight), F.lit(1)).cast("int")
    totals = totals.select(
        "cluster",
        F.col("main.label").alias("main"),
        count(F.col("all") - F.col("main.w")).alias("outer"),
        count(F.col("main.w")).alias("inner"),
    )
    dealt = salted(own, "node").join(to_all_salts(totals), ["cluster", "salt"])
    dealt = dealt.withColumn("outside", F.col("label") != F.col("main")).withColumn(
        "own",
        F.pmod(
            F.xxhash64("node"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner"))
        ).cast("int"),
    )
    to = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    mine = F.col("own")
    with_inner = F.transform(to(F.col("inner")), lambda j: pair(0, mine, j))
    with_outer = F.transform(
        F.filter(to(F.col("outer")), lambda o: o != mine),
        lambda o: pair(1, F.least(o, mine), F.greatest(o, mine)),
    )
    of_main = F.transform(to(F.col("outer")), lambda i: pair(0, i, mine))
    pairs = F.when(F.col("outside"), F.concat(with_inner, with_outer)).otherwise(of_main)
    return dealt.select("cluster", "node", "label", "outside", "own", F.inline(pairs))


def link_outsiders(
    dealt: DataFrame, whole: DataFrame, threshold: float, shingle: int
) -> DataFrame:
    """(a, b): links that join classes, from every pair of blocks."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        text, unit = weighted_units(Words(rows["text"].tolist(), FOLDED, True), shingle)
        _, unit = np.unique(unit, return_inverse=True)
        borders = np.searchsorted(text, np.arange(len(rows) + 1))
        weight = np.diff(borders)
        filled = np.flatnonzero(weight)
        nodes, labels = rows["node"].to_numpy(), rows["label"].to_numpy()
        outside, own = rows["outside"].to_numpy(), rows["own"].to_numpy()
        kind, i, j = (int(rows[c].iloc[0]) for c in ("kind", "i", "j"))
        # two blocks of outsiders: across only; else outsiders with the others, once among themselves
        first = outside & (own == i) if kind else outside
        second = own == j if kind else (~outside | (j == 0))
        marks = np.zeros(len(unit) + 1, bool)
        groups = labels.copy()
        found = []
        for x in np.flatnonzero(first):
            mine = unit[borders[x] : borders[x + 1]]
            marks[mine] = True
            both = np.zeros(len(rows), np.int64)
            if len(filled):
                both[filled] = np.add.reduceat(marks[unit], borders[filled], dtype=np.int64)
            marks[mine] = False
            near = second & (both >= threshold * (weight[x] + weight - both)) & (both > 0)
            for y in np.flatnonzero(near & (groups != groups[x])):
                if groups[x] != groups[y]:
                    found.append((nodes[x], nodes[y]))
                    groups[groups == groups[y]] = groups[x]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return (
        dealt.join(whole, "node")
        .groupBy("cluster", "kind", "i", "j")
        .applyInPandas(compare, "a long, b long")
    )


def links(
    pairs: DataFrame, nodes: DataFrame, whole: DataFrame, threshold: float, shingle: int
) -> DataFrame:
    """The pairs whose texts really have the similarity, verified on whole texts.

    A pair whose signatures agree far less, or whose weights alone rule it out, is not compared.
    """

    def side(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    near = pairs
    for name in "ab":
        near = near.join(side(nodes, name, "weight", "signature"), name)
    agree = F.aggregate(
        F.zip_with("signature_a", "signature_b", lambda x, y: (x == y).cast("int")),
        F.lit(0),
        lambda s, x: s + x,
    )
    near = near.where(
        (F.least("weight_a", "weight_b") >= F.lit(threshold) * F.greatest("weight_a", "weight_b"))
        & (agree >= F.lit(AGREEMENT * threshold) * F.size("signature_a"))
    ).select("a", "b")
    for name in "ab":
        near = near.join(side(whole, name, "text"), name)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_b"):
            pairs = part.num_rows
            both = part.column("text_a").to_pylist() + part.column("text_b").to_pylist()
            text, unit = weighted_units(Words(both, FOLDED, True), shingle)
            borders = np.searchsorted(text, np.arange(2 * pairs + 1))
            own = [unit[borders[i] : borders[i + 1]] for i in range(2 * pairs)]
            good = [similarity(own[i], own[pairs + i]) >= threshold for i in range(pairs)]
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return near.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def near_classes(
    docs: DataFrame,
    threshold: float = 0.8,
    bands: int = 24,
    rows: int = 4,
    shingle: int = SHINGLE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, root) of every row of ``docs``, stored, with the columns named in ``carry``.

    ``root`` numbers the class, the connected component of all links: pairs of texts with a weighted
    Jaccard similarity of at least ``threshold`` on shingles of lower-cased words, a text of fewer
    words being one shingle. A null or empty text, or one without words, is like no other and equal
    only to the same text. A text of any length is signed whole; repeated rows are one node; an empty table
    gives no rows. At 24 bands of 4 rows a pair at the threshold shares no bucket with
    probability 3e-6.
    """
    k = bands * rows
    content = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("content")
    rows_in = texts(docs, *carry).select("doc_id", "text", content, *carry)
    signed = stored(signatures(rows_in, k, shingle, carry), "signed")
    # equal texts are one node, named by a number that the stored table fixes
    nodes = (
        signed.withColumn("n", F.monotonically_increasing_id())
        .groupBy("content")
        .agg(
            F.min("n").alias("node"),
            F.min_by("doc_id", "n").alias("holder"),
            F.min_by("weight", "n").alias("weight"),
            F.min_by("signature", "n").alias("signature"),
        )
    )
    nodes = stored(nodes, "nodes")
    members = stored(buckets(nodes, bands, rows), "members")
    # the text of one holder per node; joined on its id too, so equal texts spread over the tasks
    needed = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        "content", F.coalesce("holder", F.lit(-1)).alias("holder"), "node"
    )
    held = rows_in.select("content", F.coalesce("doc_id", F.lit(-1)).alias("holder"), "text")
    whole = stored(
        held.join(needed, ["content", "holder"]).dropDuplicates(["node"]).select("node", "text"),
        "texts",
    )
    pairs = stored(to_centres(members), "pairs")
    found = stored(links(pairs, nodes, whole, threshold, shingle), "verified")
    as_links = lambda df: df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components(as_links(found))
    left = stored(unresolved(members, labels), "unresolved")
    if not left.isEmpty():
        dealt = blocks(left, nodes, BLOCK_WEIGHT)
        more = stored(link_outsiders(dealt, whole, threshold, shingle), "outsiders")
        labels = components(as_links(found.unionByName(more)))
    named = nodes.join(labels, "node", "left").select(
        "content", F.coalesce("root", "node").alias("root")
    )
    rows_out = signed.select("doc_id", "content", *carry).join(named, "content")
    return stored(rows_out.select("doc_id", "root", *carry), "classes")


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    bands: int = 24,
    rows: int = 4,
    shingle: int = SHINGLE,
) -> DataFrame:
    """(doc_id, class_id, n_class, kept) of every row of ``docs``, by the classes of ``near_classes``.

    ``class_id`` is the least doc_id of the class and ``n_class`` its rows; ``kept`` holds for the
    rows of that doc_id. A null doc_id is in a class like any other row, but names none and is never
    kept unless the class has no other id (class_id is then null).
    """
    rows_out = near_classes(docs, threshold, bands, rows, shingle)
    classes = rows_out.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("n_class")
    )
    return (
        salted(rows_out.withColumn("r", F.monotonically_increasing_id()), "r")
        .join(to_all_salts(classes), ["root", "salt"])
        .select(
            "doc_id", "class_id", "n_class", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
        )
    )
