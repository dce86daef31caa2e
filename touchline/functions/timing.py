"""Match clock and minute buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.config import MINUTE_EDGES, MINUTE_LABELS, MINUTES_CLOSED_RIGHT, MINUTES_CLOSED_RIGHT_LAST, UNKNOWN
from touchline.functions.numeric import bin_left_closed


def clock_seconds(minute: Column, second: Column) -> Column:
    """Seconds on the match clock; missing parts count as zero. The period is ignored on purpose."""
    return F.coalesce(minute, F.lit(0)) * 60 + F.coalesce(second, F.lit(0))


def timestamp_seconds(text: Column) -> Column:
    """Seconds of an "HH:MM:SS.mmm" string. The fraction is an integer number of milliseconds: ".5" is 5 ms."""
    parts = F.split(text, ":")
    seconds = F.split(parts[2], r"\.")
    millis = F.coalesce(F.try_element_at(seconds, F.lit(2)).cast("int"), F.lit(0))
    whole = parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + seconds[0].cast("int")
    return whole + millis / F.lit(1000.0)


def timestamp_of_day(text: Column) -> Column:
    """The same string as a timestamp on 1900-01-01."""
    micros = F.round(timestamp_seconds(text) * F.lit(1000.0)).cast("long") * 1000
    return F.expr("timestamp_ntz'1900-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1000000)).cast("decimal(18,6)")
    )


def possession_duration(start: Column, end: Column) -> Column:
    return timestamp_seconds(end) - timestamp_seconds(start)


def minute_bucket_closed_right(minute: Column) -> Column:
    """Feature-table buckets: a minute equal to the upper bound belongs to the bucket."""
    chain: Column | None = None
    for upper, label in MINUTES_CLOSED_RIGHT:
        hit = minute <= upper
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.when(minute.isNotNull(), F.lit(MINUTES_CLOSED_RIGHT_LAST))


def minute_bucket_closed_left(minute: Column, fallback: Column | None = None) -> Column:
    """Report buckets: [0,15) ... [90,121); otherwise the fallback label, then "Unknown"."""
    label = bin_left_closed(minute, MINUTE_EDGES, MINUTE_LABELS)
    if fallback is not None:
        label = F.when(minute.isNull(), F.lit(UNKNOWN)).otherwise(F.coalesce(label, fallback))
    return F.coalesce(label, F.lit(UNKNOWN))
