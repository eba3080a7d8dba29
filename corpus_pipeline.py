"""From raw documents to token ids in five stages, each over all that the one before kept.

A stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. Ids may be null or repeated: stages 3
and 4 number the rows of their input, store it, and judge each row by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, decontam, linededup, neardup, rules
from wardline.llm.queries import vocabulary
from wardline.llm.tables import read_table, stored
from wardline.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number per row that the stored table fixes."""
    number = F.monotonically_increasing_id().alias("number")
    return stored(docs.select(*COLUMNS, number), name)


def _by_number(rows: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) one of ``numbers``."""
    return rows.join(numbers.select("number"), "number", how).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; the cutoffs come from the labelled ones among ``docs``.

    A verdict depends on text and language alone, so the rejected ones are known by id, language and the text's
    digest; the texts are measured once and not stored.
    """
    configure(spark)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    rows = docs.select(*COLUMNS, digest)
    figures = stored(rules.features(rows, "digest"), "figures")
    learnt = stored(rules.cutoffs(figures, read_table(spark, sf_dir, "labels")), "cutoffs")
    judged = rules.verdicts(figures, learnt).where(~F.col("kept"))
    gone = judged.select(F.col("doc_id").alias("id"), "stratum", F.col("carried.digest").alias("text_digest"))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("id"))
        & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("stratum"))
        & (F.col("digest") == F.col("text_digest"))
    )
    return rows.join(gone.distinct(), same, "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that one of smaller id holds; a text may end up empty."""
    configure(spark)
    kept = linededup.dedup_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least id, of equal ids the first."""
    configure(spark)
    rows = _numbered(docs, "near-input")
    found = neardup.near_classes(rows, carry=("number",))
    # false comes first: a null id is the last
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")
    kept = found.groupBy("root").agg(F.min(order)["number"].alias("number"))
    return _by_number(rows, kept, "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    configure(spark)
    rows = _numbered(docs, "decontamination-input")
    benchmark = read_table(spark, sf_dir, "benchmark")
    found = decontam.find_contamination(rows, benchmark, carry=("number",))
    return _by_number(rows, found.where("n_hit > 0"), "left_anti")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document that is left, as digests."""
    configure(spark)
    return bpe.encode_documents(docs, vocabulary()).select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

# Near duplicates and token ids are beyond SQL; tests hold the pipeline against a brute-force one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next."""
    docs = read_table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
