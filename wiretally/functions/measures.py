"""Derived numbers and text of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(n: Column, seconds: Column) -> Column:
    """Packets per second; 0.0 when no time has passed."""
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))


def megabytes(n_bytes: Column) -> Column:
    """Decimal megabytes."""
    return n_bytes / F.lit(1e6)


def size_text(sizes: Column) -> Column:
    """Sizes as text, ascending by number: ``29,100,1349``."""
    return F.array_join(F.transform(F.sort_array(sizes), lambda s: s.cast("string")), ",")
