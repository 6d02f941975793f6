"""Column names and row keys that never meet a caller's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str, *more: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` or of ``more`` has."""
    taken = {c.lower() for c in (*df.columns, *more)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(df: DataFrame, name: str) -> Column:
    """The column of exactly that name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, in order, whatever their names contain."""
    return [named(df, c) for c in df.columns]


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """``(id, text_hash)``: tells apart rows that share an id; structs compare null as equal to null."""
    text_hash = F.xxhash64(F.coalesce(named(docs, text_col), F.lit("")))
    return F.struct(named(docs, id_col).alias("id"), text_hash.alias("text_hash"))
