"""Removal of lines that an earlier document already holds, by levelled sorted runs of line hashes.

Documents are taken in batches of ascending id. What earlier batches have seen lies in runs: bucketed
tables of (key, owner), sorted by key inside each bucket. A batch merge-joins its own distinct keys
against every run without moving the runs; the keys that none of them holds (the anti side) become a
new run at level 0. ``fan_in`` runs of a level are compacted into one run of the next.

A key is 16 bytes of a line's hash. Every step before the last moves keys only; counts per key are
pre-aggregated, so a line in a third of all documents is one row per task. What a row has to give up
is gathered by its number, so null or repeated ids make no group larger. Stored: the numbered rows, keys,
runs, and the owners of shared keys, all in folders under ``spark.checkpoint.dir``; a lost executor costs
a read of them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.tables import slices, stored, texts
from wardline.session import scratch_path

# Fixed value: the white space stripped from a line's ends.
BLANK = " \t\n\x0b\x0c\r"
#: The occurrences of one key are dealt to so many tasks when owners are looked up.
SALTS = 16


def line_key(line: str, min_chars: int) -> bytes | None:
    """Hash of the stripped line with A-Z lower-cased; None if it is too short to count."""
    line = line.strip(BLANK)
    if len(line) < min_chars:
        return None
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(row, id, key): the distinct keys of every row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, ids, found = [], [], []
            for row, i, text in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                own = {line_key(x, min_chars) for x in (text or "").split("\n")} - {None}
                rows.extend([row] * len(own))
                ids.extend([i] * len(own))
                found.extend(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(found, pa.binary())],
                names=["row", "id", "key"],
            )

    return docs.select("row", "doc_id", "text").mapInArrow(keys, "row long, id long, key binary")


class Runs:
    """Levels of runs; a run is a bucketed table of (key, owner, row) sorted by key.

    The owner is an id; a key that only rows without id hold has the first of those rows instead.
    """

    def __init__(self, spark: SparkSession, fan_in: int) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def owners(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``owner`` and ``row`` of who holds the key in a run, else nulls (the anti side)."""
        held = {"owner": [], "row": []}
        for i, table in enumerate(self.tables()):
            run = self.spark.table(table)
            for c, names in held.items():
                names.append(f"_{c}{i}")
                run = run.withColumnRenamed(c, names[-1])
            keys = keys.join(run.hint("merge"), "key", "left")
        none = F.lit(None).cast("long")
        found = {c: F.coalesce(*names) if names else none for c, names in held.items()}
        return keys.withColumns(found).drop(*held["owner"], *held["row"])

    def _write(self, run: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        # one file per bucket, so that a bucket is one sorted run
        (
            run.repartition(self.buckets, "key")
            .write.format("parquet")
            .bucketBy(self.buckets, "key")
            .sortBy("key")
            .option("path", scratch_path(self.spark, "line-run"))
            .saveAsTable(table)
        )
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(table)

    def add(self, new: DataFrame) -> None:
        """A new run of keys that no run holds; compacts every level that is full."""
        self._write(new, 0)
        for level in range(len(self.levels)):
            full = self.levels[level]
            if len(full) < self.fan_in:
                break
            merged = self.spark.table(full[0])
            for table in full[1:]:
                merged = merged.unionByName(self.spark.table(table))
            self._write(merged, level + 1)
            self.levels[level] = []
            self._drop(full)

    def _drop(self, tables: list[str]) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def close(self) -> None:
        self._drop(self.tables())
        self.levels = [[]]


def shared_keys(keys: DataFrame, batches: int, fan_in: int) -> DataFrame:
    """(key, owner, row) of every key that two documents hold: the smallest id, or without one a row.

    ``keys``: (row, id, key), stored. Batches are cut at quantiles of the id, rows without one last; where
    the cuts lie does not change the result.
    """
    steps = [i / batches for i in range(1, batches)]
    cuts = keys.select(F.percentile_approx("id", F.array(*map(F.lit, steps)))).first()[0]
    cuts = sorted(set(cuts or []))
    runs = Runs(keys.sparkSession, fan_in)
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = keys
        if low is not None:
            batch = batch.where((F.col("id") > low) | F.col("id").isNull())
        if high is not None:
            batch = batch.where(F.col("id") <= high)
        nameless = F.when(F.col("id").isNull(), F.col("row"))
        own = batch.groupBy("key").agg(
            F.min("id").alias("first"),
            F.max("id").alias("last"),
            F.min(nameless).alias("first_row"),
            F.max(nameless).alias("last_row"),
        )
        met = stored(runs.owners(own), "line-batch")
        known = F.col("owner").isNotNull() | F.col("row").isNotNull()
        # without an id the key belongs to its first row
        first_row = F.when(F.col("first").isNull(), F.col("first_row"))
        if high is not None:
            runs.add(met.where(~known).select("key", F.col("first").alias("owner"), first_row.alias("row")))
        several = (
            F.coalesce(F.col("first") < F.col("last"), F.lit(False))
            | F.coalesce(F.col("first_row") < F.col("last_row"), F.lit(False))
            | (F.col("first").isNotNull() & F.col("first_row").isNotNull())
        )
        parts.append(
            met.where(known | several).select(
                "key",
                F.when(known, F.col("owner")).otherwise(F.col("first")).alias("owner"),
                F.when(known, F.col("row")).otherwise(first_row).alias("owner_row"),
            )
        )
    runs.close()
    # a key may be shared in several batches, always with the same owner
    shared = parts[0]
    for part in parts[1:]:
        shared = shared.unionByName(part)
    return shared.dropDuplicates(["key"])


def dropped_keys(keys: DataFrame, shared: DataFrame) -> DataFrame:
    """(row, drop): the keys that each row has to give up."""
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    owners = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    owners = owners.withColumn("salt", F.col("salt").cast("long"))
    owns = F.col("id").eqNullSafe(F.col("owner")) & (F.col("id").isNotNull() | (F.col("row") == F.col("owner_row")))
    return (
        salted.join(owners, ["key", "salt"])
        .where(~owns)
        .groupBy("row")
        .agg(F.collect_set("key").alias("drop"))
    )


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 10,
    batches: int = 4,
    fan_in: int = 2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of ``docs`` without the lines that a document of smaller id holds.

    Returns doc_id, text (what stays, joined by newlines), n_lines, n_dropped and the columns named
    in ``carry``. A line counts from ``min_chars`` code points on. A null or empty text is one empty
    line. Rows of one doc_id are one document: none of them drops a line for another. Rows without
    doc_id are documents of their own that come after all others, so of equal ones a single row keeps
    its lines. Rows are never dropped, even if no line stays (text is then empty). A text of any length is
    split whole by one task; an empty table gives no rows; other columns are ignored.
    """
    number = F.monotonically_increasing_id().alias("row")
    rows = stored(texts(docs, *carry).select("*", number), "line-rows")
    keys = stored(line_keys(rows, min_chars), "line-keys")
    drops = dropped_keys(keys, shared_keys(keys, batches, fan_in))
    joined = rows.join(drops, "row", "left").select("doc_id", "text", *carry, "drop")
    out = f"doc_id long, text string, n_lines long, n_dropped long{_ddl(rows, carry)}"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept, counts, gone = [], [], []
            for text, drop in zip(part.column("text").to_pylist(), part.column("drop").to_pylist()):
                lines, drop = (text or "").split("\n"), set(drop or ())
                stay = [x for x in lines if not drop or line_key(x, min_chars) not in drop]
                kept.append("\n".join(stay))
                counts.append(len(lines))
                gone.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(kept, pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    *(part.column(c) for c in carry),
                ],
                names=["doc_id", "text", "n_lines", "n_dropped", *carry],
            )

    return joined.mapInArrow(apply, out)


def _ddl(df: DataFrame, columns: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f", `{c}` {kinds[c]}" for c in columns)
