"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight, which sets how many words the mix takes from it, and
a schedule of relative weights over training progress 0 to 1, which sets when.
The schedule is integrated to the source's cumulative demand; a document's
place in its source's shuffled word stream, put through the inverse of that
demand, is its training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wiretally.llm.columns import fresh, named, row_key
from wiretally.llm.storage import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Relative weight at evenly spaced points of progress, for each of WEIGHTS.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
RATIO = 1.5
REPEATS = 2
#: Hex digits of the hash that cut a source's stream into parts.
PART_DIGITS = 4


def words_in(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stream_key(doc_id: Column, text: Column) -> Column:
    """Hex digits that fix a document's place in its source, the same on every run.

    The text takes part, so that rows which share an id, or have none, do not
    crowd into one part.
    """
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat(own, F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(id, source, text_hash, size, key)`` of every row."""
    key = row_key(docs, id_col, text_col)
    return docs.select(
        key["id"].alias("id"),
        named(docs, source_col).alias("source"),
        key["text_hash"].alias("text_hash"),
        words_in(named(docs, text_col)).alias("size"),
        stream_key(named(docs, id_col), named(docs, text_col)).alias("key"),
    )


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    ratio: float = RATIO,
    repeats: int = REPEATS,
) -> DataFrame:
    """``(source, source_size, target, schedule)``, one row per source.

    Sources in code point order, null last, take ``weights`` and ``schedules``
    in turn and share ``ratio`` times all words by weight. No target is above
    ``repeats`` times its source's size; the excess is shared anew among the
    others. With sources ordered by limit over weight, those at their limit
    come first, so that one pass of running sums gives the share of the rest.
    Windows here run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(named) - 1) % len(weights) + 1
    ranked = by_source.select(
        "source",
        "source_size",
        F.row_number().over(named).alias("rank"),
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
        F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in schedules]), turn).alias("schedule"),
        (F.lit(float(repeats)) * F.col("source_size")).alias("most"),
    )
    by_limit = W.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = W.partitionBy()
    shares = ranked.select(
        "*",
        F.row_number().over(by_limit).alias("nth"),
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("most").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        .alias("settled"),
        F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)).alias("open"),
    ).withColumn("share", (F.lit(float(ratio)) * F.col("total") - F.col("settled")) / F.col("open"))
    fits = F.col("share") * F.col("weight") <= F.col("most")
    first = F.min(F.when(fits, F.struct("nth", "share"))).over(everything)
    final = shares.withColumn("final", first["share"])
    target = F.least(F.col("most"), F.coalesce(F.col("final") * F.col("weight"), F.col("most")))
    return final.select("source", "source_size", target.alias("target"), "schedule")


def _progress(done: Column, target: Column, schedule: Column) -> Column:
    """Progress at which a source's demand reaches ``done`` words.

    Demand has a straight line between neighbouring points of the schedule, so
    its integral is quadratic there and is inverted by the root that stays
    finite when the line is level.
    """
    pieces = F.size(schedule) - 1
    steps = F.sequence(F.lit(1), pieces)
    area = F.transform(
        steps, lambda k: (F.element_at(schedule, k) + F.element_at(schedule, k + 1)) / 2
    )
    whole = F.aggregate(area, F.lit(0.0), lambda a, x: a + x)
    need = F.when(target > 0, done / target * whole).otherwise(F.lit(0.0))
    below = F.transform(
        steps, lambda k: F.aggregate(F.slice(area, F.lit(1), k - 1), F.lit(0.0), lambda a, x: a + x)
    )
    piece = F.greatest(F.lit(1), F.size(F.filter(below, lambda x: x <= need)))
    rest = need - F.element_at(below, piece)
    a, b = F.element_at(schedule, piece), F.element_at(schedule, piece + 1)
    root = F.sqrt(F.greatest(a * a + F.lit(2.0) * (b - a) * rest, F.lit(0.0)))
    within = F.when(rest > 0, F.lit(2.0) * rest / (a + root)).otherwise(F.lit(0.0))
    return (piece - 1 + within) / pieces


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    **settings,
) -> DataFrame:
    """``(id, text_hash, size, source_size, target, copies, taken, positions)`` per row.

    A source's documents follow one another in the order of a hash of their id and text
    (then id, then text hash), again and again; the mix takes whole copies as
    long as a copy's middle lies below the source's target. ``positions`` has
    the training position, 0 to 1, of each copy. Null and empty texts have size
    0 and take nothing; null is a source of its own; repeated rows take places
    of their own; no rows give no rows. ``settings`` go to ``source_targets``.

    The running sum over a source goes in two steps: over at most 16^4 parts
    of it by hash, and within each part.
    """
    sizes = durable(sized(docs, id_col, source_col, text_col), "sizes")
    targets = source_targets(sizes, **settings)
    keyed = sizes.withColumn("part", F.substring("key", 1, PART_DIGITS)).withColumn(
        "at", F.struct(F.col("source").alias("s"), F.col("part").alias("p"))
    )
    parts = keyed.groupBy("at").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("at.s").orderBy("at.p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("at", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    own = F.struct(F.col("source").alias("s")).alias("own")
    parts = parts.withColumn("own", F.struct(F.col("at.s").alias("s"))).join(
        targets.select(own, "source_size", "target", "schedule"), "own"
    )
    within = W.partitionBy("at").orderBy("key", "id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(parts.drop("own"), "at")
    middle = F.col("before") + F.col("inner") + F.col("size") / F.lit(2.0)
    room = F.col("target") - middle
    copies = F.when((room > 0) & (F.col("source_size") > 0), F.ceil(room / F.col("source_size")))
    placed = placed.select(
        "id", "text_hash", "size", "source_size", "target", "schedule", middle.alias("middle"),
        F.coalesce(copies, F.lit(0)).cast("int").alias("copies"),
    )
    nth = F.sequence(F.lit(0), F.col("copies") - 1)
    places = F.transform(
        nth,
        lambda k: _progress(
            F.col("middle") + k * F.col("source_size"), F.col("target"), F.col("schedule")
        ),
    )
    none = F.array().cast("array<double>")
    return placed.select(
        "id", "text_hash", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, places).otherwise(none).alias("positions"),
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    **settings,
) -> DataFrame:
    """``docs`` in training order: a row per copy, its columns and ``position``.

    A column named ``position``, in any case, is replaced; others may have any
    name. Rows are range-sorted by position; documents that the mix does not
    reach are not in it. Rows that repeat both id and text count as often as
    they stand in ``docs``.
    """
    plan = mix_plan(docs, id_col, source_col, text_col, **settings)
    key, place = fresh(docs, "_row_key"), fresh(docs, "_position")
    places = plan.where("copies > 0").select(
        F.struct("id", "text_hash").alias(key), F.explode("positions").alias(place)
    )
    keyed = docs.select("*", row_key(docs, id_col, text_col).alias(key))
    placed = keyed.dropDuplicates([key]).join(places, key)
    carried = [named(docs, c) for c in docs.columns if c.lower() != "position"]
    return placed.select(*carried, F.col(place).alias("position")).orderBy("position", named(docs, id_col))
