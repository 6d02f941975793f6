"""Arrival-order operators that never put a whole capture into one task.

``lag`` or a running sum over ``partitionBy("capture_id")`` sends one capture
to one task, however large it is. The helpers here cut the order column into
chunks of ``2**chunk_bits`` consecutive values, work inside the chunks, and
carry one row per chunk across the boundaries. A chunk holds at most
``2**chunk_bits`` rows since order values are unique within a capture, and the
carried table is smaller than the input by about that factor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.session import shuffle_width

CHUNK_BITS = 20
BLOCK_BITS = 12


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    order: str = "seq",
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add ``name``: the ``value`` of the row before, per ``keys`` in ``order``.

    Equals ``lag(value) over (partition by keys order by order)`` for a
    ``value`` without NULLs. The rows shuffle once; the last value of each
    chunk comes from a second, pruned scan with a map-side ``max_by``, and its
    join meets the rows where they already are.
    """
    chunk_keys = [*keys, "_chunk"]
    chunked = df.withColumn("_chunk", F.shiftright(order, chunk_bits))
    carry = (
        chunked.groupBy(*chunk_keys)
        .agg(F.max_by(value, order).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")))
        .where(F.col("_carry").isNotNull())
        .select(*chunk_keys, "_carry")
    )
    inside = Window.partitionBy(*chunk_keys).orderBy(order)
    return (
        chunked.withColumn(name, F.lag(value).over(inside))
        .join(carry, chunk_keys, "left")
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop("_chunk", "_carry")
    )


def _block_of(index: str, block_bits: int) -> Column:
    """Block of an index, stated as never NULL.

    Joins on a nullable block would filter one of two equal subplans, and
    Spark could not reuse the shuffle they share.
    """
    return F.coalesce(F.shiftright(index, block_bits), F.lit(0))


def block_starts(
    deltas: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Sums of ``values`` over all blocks before each block, per ``keys``."""
    before = (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = deltas.groupBy(*keys, "_block").agg(*[F.sum(v).alias(v) for v in values])
    return sums.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
    )


def running_sums(
    deltas: DataFrame,
    keys: Sequence[str],
    index: str,
    values: Sequence[str],
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add ``<v>_total``, the sum of ``v`` up to each row's ``index``."""
    blocked = deltas.withColumn("_block", _block_of(index, block_bits))
    upto = (
        Window.partitionBy(*keys, "_block")
        .orderBy(index)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = block_starts(blocked, keys, values)
    return (
        blocked.select("*", *[F.sum(v).over(upto).alias(f"_upto_{v}") for v in values])
        .join(starts, [*keys, "_block"])
        .select(
            *deltas.columns,
            *[(F.col(f"_before_{v}") + F.col(f"_upto_{v}")).alias(f"{v}_total") for v in values],
        )
    )


def dense_running_sums(
    spans: DataFrame,
    deltas: DataFrame,
    keys: Sequence[str],
    index: str,
    values: Sequence[str],
    carried: dict | None = None,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """One row per ``keys`` and index from ``lo`` to ``hi`` of ``spans``.

    Each row has every value at its index (0 where ``deltas`` has no row) and
    the running ``<v>_total``. ``carried`` maps further output columns to
    expressions over the span row and the index.

    An index range is opened in two steps, blocks first, so that no row ever
    holds a long array and the blocks of one key spread over the cluster. The
    empty rows and the deltas then meet in one union, not in a join: they
    shuffle once by (keys, block) and a RANGE frame gives all rows of an index
    the same sums.
    """
    carried = carried or {}
    block_keys = [*keys, "_block"]
    blocks = spans.withColumn(
        "_block",
        F.explode(
            F.sequence(F.shiftright("lo", block_bits), F.shiftright("hi", block_bits))
        ),
    ).repartition(shuffle_width(spans.sparkSession), *block_keys)
    first = F.greatest("lo", F.shiftleft("_block", block_bits))
    last = F.least("hi", F.shiftleft(F.col("_block") + 1, block_bits) - 1)
    zeros = [F.lit(0).cast("bigint").alias(v) for v in values]
    grid = blocks.withColumn(index, F.explode(F.sequence(first, last))).select(
        *block_keys,
        index,
        *zeros,
        *[expr.alias(name) for name, expr in carried.items()],
        F.lit(True).alias("_grid"),
    )
    blocked = deltas.select(
        *keys,
        _block_of(index, block_bits).alias("_block"),
        index,
        *[F.col(v).cast("bigint").alias(v) for v in values],
        F.lit(False).alias("_grid"),
    )
    order = Window.partitionBy(*block_keys).orderBy(index)
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = order.rangeBetween(Window.currentRow, Window.currentRow)
    starts = block_starts(
        blocked.select(*block_keys, *values).unionByName(blocks.select(*block_keys, *zeros)),
        keys,
        values,
    )
    return (
        grid.unionByName(blocked, allowMissingColumns=True)
        .select(
            *block_keys,
            index,
            *carried,
            "_grid",
            *[F.sum(v).over(here).alias(v) for v in values],
            *[F.sum(v).over(upto).alias(f"_upto_{v}") for v in values],
        )
        .where("_grid")
        .join(starts, block_keys)
        .select(
            *keys,
            index,
            *carried,
            *values,
            *[(F.col(f"_before_{v}") + F.col(f"_upto_{v}")).alias(f"{v}_total") for v in values],
        )
    )
