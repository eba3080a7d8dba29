"""Connected components of a table of links, by alternating large and small stars.

A large star links every larger neighbour of a node to the smallest node around it, a small star
links the smaller neighbours. Both keep components as they are, and alternating them ends in one
star per component after a logarithmic number of rounds. Each half is one pre-aggregated minimum
per node and one join. From a million links on, a centre may have more than a task should read; the join is
then salted, the more the more links there are. Every round is one job, stored in the shared folder.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wardline.llm.tables import stored


#: Links of one node that a task may read, and groups that a node's links are dealt over at most.
LINKS_A_TASK = 1_000_000
MOST_SALTS = 64


def _around_least(links: DataFrame, larger_only: bool, salts: int = 1) -> DataFrame:
    """For links (u, v): every v, and for a small star every u too, linked to the least around u."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    others = links.where(F.col("v") > F.col("u")) if larger_only else links
    if salts > 1:
        dealt = others.withColumn("salt", F.pmod(F.hash("v"), F.lit(salts)))
        copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = dealt.join(copies, ["u", "salt"])
    else:
        met = others.join(least, "u")
    around = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger_only:
        around = around.unionByName(least.select("u", F.col("m").alias("v")))
    return around.where(F.col("u") != F.col("v"))


def _stored_state(links: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The stored distinct links, and figures that change whenever they do."""
    seen = Observation()
    watched = links.distinct().observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.pmod(F.hash("u", "v"), F.lit(97))).alias("s"),
    )
    table = stored(watched, name)
    return table, tuple(seen.get[k] for k in ("n", "x", "s"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link (u, v) of two longs; root: its component's least node.

    Links may repeat, run in either direction, or join a node to itself (such a node alone is not
    returned). A node without links is not returned either.
    """
    links = links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    links, before = _stored_state(links, "links")
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # no node has more links than there are
        salts = min(MOST_SALTS, ceil(2 * before[0] / LINKS_A_TASK))
        small = _around_least(_around_least(both, True, salts), False, salts)
        links, now = _stored_state(small, "stars")
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
