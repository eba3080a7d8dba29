"""Explicit points in time: jobs take ``as_of`` instead of reading the clock."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_seconds(moment: datetime) -> float:
    """Epoch seconds; a naive moment is UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return moment.timestamp()


def utc_literal(moment: datetime) -> Column:
    return F.timestamp_micros(F.lit(round(utc_seconds(moment) * 1_000_000)))
