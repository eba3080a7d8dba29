"""Spend per model call, day totals and the daily budget gate.

Amounts are whole nano-USD (a price per million tokens is a whole number of nano-USD per
token), so sums are exact in any order; USD doubles appear only in the reported columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.blocked import running_sum
from wardline.settings import BASE_TIER, DEFAULTS, NANO, Settings


def cost_nano(tier: Column, tokens_in: Column, tokens_out: Column, settings: Settings) -> Column:
    """Cost of one call; 0 for an unknown tier. The price list is a literal of a few rows."""
    cost = F.lit(0).cast("bigint")
    for name, (price_in, price_out) in settings.prices.items():
        cost = F.when(tier == name, tokens_in * price_in + tokens_out * price_out).otherwise(cost)
    return cost


def usd(nano: Column) -> Column:
    return nano / float(NANO)


def call_cost(usage: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    return usage.withColumn(
        "cost_nano",
        cost_nano(F.col("tier"), F.col("input_tokens"), F.col("output_tokens"), settings),
    ).withColumn("date", F.to_date("call_ts"))


def _recorded(usage: DataFrame, settings: Settings) -> DataFrame:
    """Calls that enter the books: those with a known tier."""
    known = F.col("tier").isin(*settings.prices)
    return call_cost(usage.filter(known), settings=settings)


def daily_spend(usage: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """The books per UTC day."""
    tier_sums = [
        F.sum(F.when(F.col("tier") == tier, F.col(f"{side}_tokens")).otherwise(0)).alias(
            f"{tier}_{side}_tokens"
        )
        for tier in settings.prices
        for side in ("input", "output")
    ]
    return (
        _recorded(usage, settings)
        .groupBy("date")
        .agg(
            *tier_sums,
            F.sum("cost_nano").alias("total_nano"),
            F.count("*").alias("analysis_call_count"),
            F.count_if(F.col("tier") != BASE_TIER).alias("escalation_count"),
        )
        .withColumns(
            {
                "estimated_total_usd": usd(F.col("total_nano")),
                "budget_warning_fired": F.col("total_nano") >= settings.warning_nano_usd,
                "budget_cap_reached": F.col("total_nano") >= settings.cap_nano_usd,
            }
        )
    )


def _with_spent_before(
    calls: DataFrame, order: list[str], block: Column | None, settings: Settings
) -> DataFrame:
    if block is None:
        block = F.floor(F.col("call_seq") / settings.block_rows)
    return running_sum(calls, ["date"], order, block, "cost_nano", "spent_before")


def budget_flags(
    usage: DataFrame,
    *,
    order: list[str] | None = None,
    block: Column | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Per day the call that reached the warning and the one that reached the cap.

    Calls count in the order of ``call_seq`` (a unique integer); another order needs a
    ``block`` expression that never decreases along it.
    """
    order = order or ["call_seq"]
    calls = _with_spent_before(_recorded(usage, settings), order, block, settings)
    after = F.col("spent_before") + F.col("cost_nano")
    at = F.struct(*order, "call_ts")

    def first_reaching(limit: int) -> Column:
        return F.min_by(
            F.struct("call_seq", "call_ts"), F.when(after >= limit, at)
        )

    return (
        calls.groupBy("date")
        .agg(
            first_reaching(settings.warning_nano_usd).alias("w"),
            first_reaching(settings.cap_nano_usd).alias("c"),
        )
        .select(
            "date",
            F.col("w.call_seq").alias("warning_call"),
            F.col("w.call_ts").alias("warning_fired_at"),
            F.col("c.call_seq").alias("cap_call"),
            F.col("c.call_ts").alias("cap_reached_at"),
        )
    )


def budget_gate(
    usage: DataFrame,
    *,
    order: list[str] | None = None,
    block: Column | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add ``spent_before`` and ``admitted``: the day's earlier spend is below the cap.

    Once the sum of earlier calls reaches the cap it stays there, so summing all earlier
    calls gives the same answer as summing the admitted ones.
    """
    calls = call_cost(usage, settings=settings)
    return _with_spent_before(calls, order or ["call_seq"], block, settings).withColumn(
        "admitted", F.col("spent_before") < settings.cap_nano_usd
    )


def cost_summary(
    days: DataFrame, usage: DataFrame, *, settings: Settings = DEFAULTS
) -> DataFrame:
    """The day record for each ``date`` in ``days``, zeros where nothing was spent."""
    spent = daily_spend(usage, settings=settings).select(
        "date",
        "total_nano",
        "analysis_call_count",
        "escalation_count",
        "budget_warning_fired",
        "budget_cap_reached",
    )
    total = F.coalesce("total_nano", F.lit(0))
    return days.join(spent, "date", "left").select(
        "date",
        usd(total).alias("estimated_total_usd"),
        F.coalesce("analysis_call_count", F.lit(0)).alias("analysis_call_count"),
        F.coalesce("escalation_count", F.lit(0)).alias("escalation_count"),
        F.coalesce("budget_warning_fired", F.lit(False)).alias("budget_warning_fired"),
        F.coalesce("budget_cap_reached", F.lit(False)).alias("budget_cap_reached"),
        usd(F.greatest(F.lit(0), settings.cap_nano_usd - total)).alias("budget_remaining_usd"),
    )
