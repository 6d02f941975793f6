"""Joining rows with one fact per capture, whatever share one capture holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table of up to so many captures, two numbers each, goes to every task.
BROADCAST_CAPTURES = 1_000_000
SALTS = 64


def join_per_capture(
    rows: DataFrame, facts: DataFrame, how: str = "left", captures: int | None = None
) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has a row per capture.

    With at most ``BROADCAST_CAPTURES`` facts, as counted by the caller, they
    are broadcast and rows stay where they are. Otherwise rows shuffle by
    capture and a salt of ``seq``, and each fact goes to every salt.
    """
    if captures is not None and captures <= BROADCAST_CAPTURES:
        return rows.join(F.broadcast(facts), "capture_id", how)
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    spread = facts.withColumn("_salt", F.explode(salts))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["capture_id", "_salt"], how).drop("_salt")
