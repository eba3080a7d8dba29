"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Every shard has virtual nodes on it; a key belongs to the first
node at or after its cell. Of nodes that share a cell the one with the least hash owns the keys; the others
own none there and offer their places all the same, so a shard is never lost, however many there are. A shard keeps its keys in ring order up to its capacity. Keys beyond it go on
clockwise to the nodes of shards that have room: their free places are dealt over their nodes, and
the keys queue through them in ring order, each taking the first free place at or after its cell.
The end of the queue has a closed form (running maxima over cells), so nothing is assigned one by one.
With many nodes a shard overflows by a few rows in a hundred, and only those leave their ring owner.

Only column expressions, joins and window functions. Texts are read once; from then on rows are three
numbers, equal rows counted together. Tables of cells have a fixed size; windows over rows are per block
inside a cell of the ring, never per shard, so null or repeated ids of many texts fill no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.blocked import running_sum
from wardline.llm.tables import stored, texts

CELLS = 1 << 16
#: Equal rows are counted in so many groups, so that one row in millions is no single group.
SALTS = 64
#: Rows of a cell, first of one id, are numbered in so many blocks, by their text's checksum.
BLOCKS = 4096


def cell(text) -> F.Column:
    """Place on the ring: the first 16 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int")


def rows_on_ring(docs: DataFrame) -> DataFrame:
    """(cell, doc_id, size, text_crc32, salt, n): equal rows counted together."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = texts(docs).select(
        cell(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("cell"),
        "doc_id",
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"),
    )
    return rows.groupBy("cell", "doc_id", "size", "text_crc32", "salt").agg(F.count("*").alias("n"))


def virtual_nodes(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """(cell, shard, hash): the nodes on the ring; a shard's nodes in one cell are one node."""
    every = spark.range(shards * nodes).select(
        F.floor(F.col("id") / nodes).cast("int").alias("shard"), (F.col("id") % nodes).alias("node")
    )
    name = F.concat_ws(" ", F.lit("shard"), F.col("shard"), F.lit("node"), F.col("node"))
    return every.groupBy(cell(name).alias("cell"), "shard").agg(F.min(F.md5(name.cast("binary"))).alias("hash"))


def ring(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(cell, owner): who owns each cell, the first node clockwise, of several the one of least hash."""
    first = nodes.groupBy("cell").agg(F.min_by("shard", F.struct("hash", "shard")).alias("shard"))
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    # backwards, so that the frame only grows
    onward = Window.orderBy(F.col("cell").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(F.lit(1))
    next_node = F.last("shard", ignorenulls=True).over(onward)
    first_node = F.min_by("shard", F.when(F.col("shard").isNotNull(), F.col("cell"))).over(whole)
    return cells.join(first, "cell", "left").select(
        "cell", F.coalesce(next_node, first_node).alias("owner")
    )


def before(value: str, window):
    """Running sum of the rows before this one."""
    return F.coalesce(
        F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).cast("long")


def capacities(spark: SparkSession, cells: DataFrame, shards: int, load: float) -> DataFrame:
    """(owner, own, capacity): rows by ring and rows allowed, for every shard."""
    own = cells.groupBy("owner").agg(F.sum("n").alias("own"))
    total = F.sum("own").over(Window.partitionBy(F.lit(1)))
    every = spark.range(shards).select(F.col("id").cast("int").alias("owner"))
    room = F.greatest(total, F.floor(total * F.lit(load)))
    return (
        every.join(own, "owner", "left")
        .withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
        .withColumn("room", room)
        .select(
            "owner",
            "own",
            (
                F.floor(F.col("room") / shards)
                + (F.col("owner") < F.col("room") % shards).cast("long")
            ).cast("long").alias("capacity"),
        )
    )


def assign_shards(
    docs: DataFrame, shards: int = 40, nodes: int = 256, load: float = 1.0
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, owner) of every row of ``docs``.

    A shard gets at most ``load`` times its share of the rows; at 1 the counts of any two shards
    differ by at most one. ``owner`` is the shard by the ring alone, ``slot`` numbers a shard's rows
    from 0 without gaps: its own in ring order, then those that came on. ``size``: bytes of the text
    plus 16. A null text has no bytes, a null doc_id the cell of an empty text. Equal rows may be
    dealt over cells that overflow like any others; which of them goes where is immaterial. A text of any
    length is read once, for its size and checksum; an empty table gives no rows; other columns are ignored.
    Every row gets a place, however many shards and however few nodes there are.
    """
    if load < 1:
        raise ValueError("the load has to leave a place for every row")
    spark = docs.sparkSession
    rows = stored(rows_on_ring(docs), "ring-rows")
    points = stored(virtual_nodes(spark, shards, nodes), "ring-nodes")
    cells = ring(spark, points).join(
        rows.groupBy("cell").agg(F.sum("n").alias("n")), "cell", "left"
    ).withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    limits = stored(capacities(spark, cells, shards, load), "ring-limits")
    # by cell: rows of its owner before it, how many of its own stay, how many go on
    behind = cells.join(limits, "owner").withColumn(
        "offset", before("n", Window.partitionBy("owner").orderBy("cell"))
    )
    stay = F.least(F.greatest(F.col("capacity") - F.col("offset"), F.lit(0)), F.col("n"))
    behind = behind.withColumn("stay", stay).withColumn("go", F.col("n") - F.col("stay"))
    # free places, dealt over the nodes of their shard
    free = F.col("capacity") - F.least("capacity", "own")
    dealt = points.join(limits.withColumnRenamed("owner", "shard"), "shard").withColumn("free", free)
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("cell")) - 1
    count = F.count("*").over(Window.partitionBy("shard"))
    dealt = dealt.withColumn("rank", rank).withColumn("nodes", count).select(
        "cell",
        "shard",
        (F.floor(F.col("free") / F.col("nodes")) + (F.col("rank") < F.col("free") % F.col("nodes")).cast("long"))
        .cast("long").alias("places"),
        F.least("own", "capacity").alias("kept"),
    )
    inside = Window.partitionBy("cell").orderBy("shard")
    dealt = stored(dealt.withColumn("behind", before("places", inside)), "ring-places")
    places = dealt.groupBy("cell").agg(F.sum("places").alias("places"))
    queue = stored(_queue(behind, places), "ring-queue")
    waiting, room = queue.agg(F.sum("go"), F.sum("places")).first()
    if room < waiting:
        raise RuntimeError(f"{waiting} rows wait for {room} places")
    # rows of a cell in a fixed order
    block = F.col("text_crc32") % BLOCKS
    order = ["doc_id", "text_crc32", "size", "salt"]
    groups = running_sum(rows, ["cell"], order, block, "n", "within").join(
        queue.select("cell", "owner", "offset", "stay", "queued", "late"), "cell"
    )
    each = groups.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("at", F.col("within") + F.col("copy"))
    settled = each.where(F.col("at") < F.col("stay")).select(
        "doc_id", "size", "text_crc32",
        F.col("owner").alias("shard"), (F.col("offset") + F.col("at")).alias("slot"), "owner",
    )
    moving = each.where(F.col("at") >= F.col("stay")).withColumn(
        "place", F.col("queued") + F.col("at") - F.col("stay") + F.col("late")
    )
    opened = F.col("opened") + F.col("behind")
    open_places = dealt.where(F.col("places") > 0).join(queue.select("cell", "opened"), "cell").select(
        "shard", F.col("cell").alias("node"), "kept",
        F.posexplode(F.sequence(opened, opened + F.col("places") - 1)).alias("i", "place"),
    )
    arrived = moving.select("doc_id", "size", "text_crc32", "owner", "place").join(open_places, "place")
    used = arrived.groupBy("shard", "node").agg(F.count("*").alias("used"))
    ahead = used.withColumn("ahead", before("used", Window.partitionBy("shard").orderBy("node")))
    arrived = arrived.join(ahead.select("shard", "node", "ahead"), ["shard", "node"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("kept") + F.col("ahead") + F.col("i")).alias("slot"), "owner",
    )
    return settled.unionByName(arrived)


def _queue(behind: DataFrame, places: DataFrame) -> DataFrame:
    """By cell, from the point where nobody waits: keys queued, places opened, and the delay.

    Key ``q`` of the queue takes place ``q + late``, the greatest lead of places over keys at any
    cell with keys up to its own: places that opened before a key came are of no use to it.
    """
    cells = behind.join(places, "cell", "left").withColumn(
        "places", F.coalesce("places", F.lit(0).cast("long"))
    )
    along = Window.partitionBy(F.lit(1)).orderBy("cell")
    waiting = F.sum(F.col("go") - F.col("places")).over(
        along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cells = cells.withColumn("waiting", waiting)
    # nobody waits after the cell where the balance is least
    start = F.min(F.struct("waiting", "cell")).over(Window.partitionBy(F.lit(1)))["cell"] + 1
    cells = cells.withColumn("turn", F.pmod(F.col("cell") - start, F.lit(CELLS)))
    turning = Window.partitionBy(F.lit(1)).orderBy("turn")
    cells = cells.withColumn("queued", before("go", turning)).withColumn(
        "opened", before("places", turning)
    )
    lead = F.when(F.col("go") > 0, F.col("opened") - F.col("queued"))
    late = F.max(lead).over(turning.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cells.withColumn("late", late)
