"""Column expressions over timestamps, with and without a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(column: str) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of a timestamp column, as its own clock shows it."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")


def epoch_seconds(column: str) -> Column:
    return F.floor(epoch_micros(column) / 1_000_000)
