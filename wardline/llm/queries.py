"""One query per operator, over its whole table, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    alignment,
    bpe,
    classifier,
    decontam,
    licenses,
    linededup,
    neardup,
    negatives,
    pii,
    rules,
    sharding,
    substrings,
    tokencounts,
)
from wardline.llm.tables import read_table, stored
from wardline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def vocabulary() -> str:
    """The public vocabulary that the query encodes with."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def byte_vocabulary() -> str:
    """The public byte-level vocabulary that the alignment query sets against the pieces."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def piece_model() -> bytes:
    """The public piece vocabulary that the queries count and align with."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query
def op1_sharding(spark, sf):
    return sharding.assign_shards(read_table(spark, sf, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_quality_classifier(spark, sf):
    docs = read_table(spark, sf, "documents")
    net = classifier.fit(docs, read_table(spark, sf, "labels"))
    return classifier.score_documents(docs, net).select(
        "doc_id",
        classifier.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op3_license_scan(spark, sf):
    found = licenses.scan_licenses(read_table(spark, sf, "documents"))
    return found.withColumns(
        {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    )


@query
def op4_quality_rules(spark, sf):
    figures = stored(rules.features(read_table(spark, sf, "documents")), "figures")
    learnt = stored(rules.cutoffs(figures, read_table(spark, sf, "labels")), "cutoffs")
    return rules.verdicts(figures, learnt).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op5_decontamination(spark, sf):
    found = decontam.find_contamination(
        read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op6_pii(spark, sf):
    found = pii.find_personal_data(read_table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE_KINDS)),
        F.sha2(pii.as_text("base"), 256).alias("base_sha256"),
        pii.as_text("spans").alias("spans"),
    )


@query
def op7_line_dedup(spark, sf):
    return linededup.dedup_lines(read_table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op8_substring_dedup(spark, sf):
    return substrings.remove_repeats(read_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op9_bpe(spark, sf):
    coded = bpe.encode_documents(read_table(spark, sf, "documents"), vocabulary())
    return coded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_near_dedup(spark, sf):
    return neardup.near_duplicates(read_table(spark, sf, "documents"))


@query
def op11_token_counts(spark, sf):
    counted = tokencounts.count_tokens(read_table(spark, sf, "documents"), piece_model())
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op12_hard_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(
        read_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, label=moved
    )


@query
def op13_alignment(spark, sf):
    return alignment.align_documents(
        read_table(spark, sf, "documents"), byte_vocabulary(), piece_model()
    )
