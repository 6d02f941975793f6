"""Exact duplicates by progressive refinement.

Texts are told apart by length first, then by a hash of their beginning, and
only what shares both with some other text is hashed in full. Which lengths and
which (length, beginning) pairs occur more than once goes to all tasks as a
bitmap of fixed size: a clear bit proves that a text has no equal, a set bit
that it may, and equality is then settled by SHA-256 of the whole text. No text
is shuffled. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.columns import columns_of, fresh, named
from wiretally.llm.storage import durable

PREFIX_CHARS = 64
#: Bits of each of the two bitmaps: 8 MB, a multiple of Spark's 32,768 bits a row.
FILTER_BITS = 1 << 26
#: A group with more than one of so many rows is joined by broadcast; fewer groups than this exist.
HOT_SHARE = 1000

_ROW_BITS = 1 << 15


def _content(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(named(docs, text_col), F.lit(""))


def _facts(text: Column) -> dict[str, Column]:
    """Length in bytes, and a hash of length and beginning."""
    size = F.octet_length(text)
    return {"size": size, "start": F.xxhash64(size, F.substring(text, 1, PREFIX_CHARS))}


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def _bitmap(counts: DataFrame, bits: int) -> DataFrame:
    """``(part, bitmap)``: a set bit for the ``key`` of every row; at most bits / 32,768 rows of 4 KB."""
    place = _bit(F.col("key"), bits) + 1
    return counts.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )


def _marked(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with boolean ``name``: whether the bit of ``key`` is set."""
    part, held = fresh(rows, "_part", name), fresh(rows, "_bitmap", name)
    # At most ``bits`` bits, whatever the data.
    known = F.broadcast(bitmap.select(F.col("part").alias(part), F.col("bitmap").alias(held)))
    columns = columns_of(rows)
    place = _bit(key, bits)
    rows = rows.select("*", (F.floor(place / _ROW_BITS) + 1).alias(part)).join(known, part, "left")
    spot = F.pmod(place, F.lit(_ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    weight = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), spot % 8 + 1)
    return rows.select(*columns, F.coalesce(byte.bitwiseAND(weight) > 0, F.lit(False)).alias(name))


def repeated_facts(docs: DataFrame, text_col: str = "text", bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Bitmaps of the lengths, and of the (length, beginning) pairs, that occur more than once."""
    facts = durable(docs.select(*[c.alias(n) for n, c in _facts(_content(docs, text_col)).items()]), "facts")
    sizes = facts.groupBy(F.col("size").alias("key")).count().where("count > 1")
    by_size = durable(_bitmap(sizes, bits), "sizes")
    left = _marked(facts, F.col("size"), by_size, bits, "same").where("same")
    starts = left.groupBy(F.col("start").alias("key")).count().where("count > 1")
    return by_size, durable(_bitmap(starts, bits), "starts")


def _surviving(docs: DataFrame, text_col: str, bitmaps: tuple[DataFrame, DataFrame], bits: int, name: str) -> DataFrame:
    """``docs`` with boolean ``name``: whether length and beginning may occur in another row."""
    facts = _facts(_content(docs, text_col))
    by_size, by_start = fresh(docs, "_same_size", name), fresh(docs, "_same_start", name)
    columns = columns_of(docs)
    rows = _marked(docs, facts["size"], bitmaps[0], bits, by_size)
    rows = _marked(rows, facts["start"], bitmaps[1], bits, by_start)
    return rows.select(*columns, (F.col(by_size) & F.col(by_start)).alias(name))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carried: dict[str, Column] | None = None,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """``(id, row, full, keep_id, group_size, kept)`` and ``carried``, one row per row of ``docs``.

    Rows with the same text are a group; null counts as the empty text. The row
    with the largest id stays, a null id only where no other is there; of equal
    ids one row stays, which ``row`` (numbers of no meaning, different for each
    row) decides. ``full`` is the text's SHA-256, null where the text has no
    equal by length and beginning. Texts are compared whole, however long.
    Empty input gives no rows. Other columns may have any name; ``carried``
    adds columns, by expressions over ``docs``.

    A group's facts come from one aggregation with partial sums in each task.
    Groups with more than a thousandth of all rows, of which there are less
    than a thousand, reach their rows by broadcast; the others by a join on
    their hash. A group of any size is thus spread over all tasks.
    """
    carried = carried or {}
    bitmaps = repeated_facts(docs, text_col, bits)
    mark = fresh(docs, "_mark")
    rows = _surviving(docs, text_col, bitmaps, bits, mark)
    full = F.when(F.col(mark), F.unhex(F.sha2(_content(docs, text_col), 256)))
    rows = rows.select(
        named(docs, id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        full.alias("full"),
        *[c.alias(n) for n, c in carried.items()],
    )
    rows = durable(rows, "hashes")
    groups = rows.where("full IS NOT NULL").groupBy("full").agg(
        F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("first")
    )
    groups = durable(groups, "groups")
    total = rows.count()
    hot = groups.where(F.col("group_size") * HOT_SHARE > total)
    cold = groups.where(F.col("group_size") * HOT_SHARE <= total)
    alone = rows.where("full IS NULL").select(
        "*", F.lit(1).cast("long").alias("group_size"), F.struct("id", "row").alias("first")
    )
    shared = rows.where("full IS NOT NULL")
    in_hot = shared.join(F.broadcast(hot), "full")
    in_cold = shared.join(F.broadcast(hot.select("full")), "full", "left_anti").join(cold, "full")
    found = alone.unionByName(in_hot).unionByName(in_cold)
    return found.select(
        "id", "row", "full", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), *carried,
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = FILTER_BITS
) -> DataFrame:
    """``docs`` with one row of each group of ``exact_groups``, columns unchanged, whatever their names.

    Texts without an equal by length and beginning stay where they are; only
    the others are shuffled, by id and hash.
    """
    bitmaps = repeated_facts(docs, text_col, bits)
    found = exact_groups(docs, id_col, text_col, bits=bits)
    mark, key = fresh(docs, "_mark"), fresh(docs, "_key")
    kept = found.where("kept AND full IS NOT NULL").select(F.struct("id", "full").alias(key))
    rows = _surviving(docs, text_col, bitmaps, bits, mark)
    full = F.unhex(F.sha2(_content(docs, text_col), 256))
    keyed = rows.where(F.col(mark)).select(
        *columns_of(docs), F.struct(named(docs, id_col).alias("id"), full.alias("full")).alias(key)
    )
    some = keyed.dropDuplicates([key]).join(kept, key, "left_semi").select(*columns_of(docs))
    return rows.where(~F.col(mark)).select(*columns_of(docs)).unionAll(some)
