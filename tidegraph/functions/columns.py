"""Small column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: int, high: int | None = None) -> Column:
    """Limit a numeric column to `low..high`; no upper limit if `high` is None."""
    raised = F.greatest(value, F.lit(low))
    return raised if high is None else F.least(raised, F.lit(high))


def clamp_scalar(value: int, low: int, high: int | None = None) -> int:
    return max(low, value) if high is None else min(max(low, value), high)


def type_matches(type_: Column, type_filter: list[str] | None) -> Column:
    """Type filter: None lets every type through, an empty list none.  Case-sensitive."""
    if type_filter is None:
        return F.lit(True)
    return type_.isin(type_filter) if type_filter else F.lit(False)


def between_acks(seq: Column, from_ack: Column, to_ack: Column) -> Column:
    """The half-open range `(from_ack, to_ack]`."""
    return (seq > from_ack) & (seq <= to_ack)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with milliseconds, for sessions whose zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
