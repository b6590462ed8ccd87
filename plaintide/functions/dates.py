"""Dates and times; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """ISO timestamp, null if it is none; without a zone it is in the session's (UTC)."""
    return F.try_to_timestamp(text)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def missed_days(last_run: Column, now: Column, cap: int = 30) -> Column:
    """Days to make up: from the day after the last run to today, ``cap`` at most; today if there was no run, none if it was today."""
    today, last = F.to_date(now), F.to_date(last_run)
    start = F.greatest(F.date_add(last, 1), F.date_sub(today, cap - 1))
    return F.when(last.isNull(), F.array(today)).when(last >= today, F.array().cast("array<date>")).otherwise(F.sequence(start, today))
