"""Resampling documents toward a target distribution by hashed n-gram importance.

Runs of one and two words are counted by hash bucket, in the documents and in a
target. A bucket's gain is the logarithm of how much likelier the target makes
it; a document's weight is the mean gain of its n-grams. Weights plus Gumbel
noise are scores, and the highest scores are a draw without replacement in
proportion to the weights' exponentials.

Within a batch n-grams are interned in an open-addressed table of NumPy arrays:
the XXH64 of an n-gram's bytes picks its slot, a slot is taken only by equal
bytes, and each slot holds the bucket and the count of its n-gram. The CRC of a
bucket is thus taken once per distinct n-gram, and the slot numbers of the
occurrences gather counts and gains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wiretally.llm.columns import columns_of, fresh, named, row_key
from wiretally.llm.storage import durable
from wiretally.llm.tokens import ASCII_LOWER, NOT_ALNUM, buffers, edges, slices, utf8
from wiretally.session import shuffle_width

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7

#: Words that are interned together, whatever texts they are in.
_PART_WORDS = 1 << 17
#: Longer n-grams are hashed and compared one by one.
_LONG = 256

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * _P2, 31) * _P1


class Bytes:
    """Bytes with unaligned reads of 8 and 4 of them at any place, zeros beyond the end."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        n = len(data) + 1
        self.u64 = np.ndarray((n,), "<u8", self.data, strides=(1,))
        self.u32 = np.ndarray((n,), "<u4", self.data, strides=(1,))

    def _xxh64(self, at: np.ndarray, n: int) -> np.ndarray:
        """XXH64 (seed 0) of ranges of the same length."""
        done = 0
        if n >= 32:
            acc = [
                np.full(len(at), (int(_P1) + int(_P2)) % (1 << 64), np.uint64),
                np.full(len(at), _P2),
                np.zeros(len(at), np.uint64),
                np.full(len(at), (1 << 64) - int(_P1), np.uint64),
            ]
            while done + 32 <= n:
                acc = [_round(a, self.u64[at + (done + 8 * k)]) for k, a in enumerate(acc)]
                done += 32
            h = sum((_rotated(a, r) for a, r in zip(acc, (1, 7, 12, 18), strict=True)), np.uint64(0))
            for a in acc:
                h = (h ^ _round(np.uint64(0), a)) * _P1 + _P4
        else:
            h = np.full(len(at), _P5)
        h = h + np.uint64(n)
        while done + 8 <= n:
            h = _rotated(h ^ _round(np.uint64(0), self.u64[at + done]), 27) * _P1 + _P4
            done += 8
        if done + 4 <= n:
            h = _rotated(h ^ (self.u32[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
            done += 4
        for k in range(done, n):
            h = _rotated(h ^ (self.data[at + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """XXH64 of each range; ranges of a length are hashed side by side."""
        found = np.zeros(len(start), np.uint64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own, n = order[lo:hi], int(length[order[lo]])
            if n <= _LONG:
                found[own] = self._xxh64(start[own], n)
            else:
                found[own] = [xxhash.xxh64_intdigest(self.data[i : i + n].data) for i in start[own].tolist()]
        return found

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` bytes at ``a`` and at ``b`` are the same."""
        same = np.ones(len(a), bool)
        left = np.flatnonzero(n <= _LONG)
        done = 0
        while len(left):
            differ = self.u64[a[left] + done] ^ self.u64[b[left] + done]
            unused = np.maximum(8 - (n[left] - done), 0).astype(np.uint64) * np.uint64(8)
            same[left] &= (differ << unused) == 0
            done += 8
            left = left[(n[left] > done) & same[left]]
        for i in np.flatnonzero(n > _LONG).tolist():
            x, y, size = int(a[i]), int(b[i]), int(n[i])
            same[i] = x == y or np.array_equal(self.data[x : x + size], self.data[y : y + size])
        return same


class Interned(NamedTuple):
    """The slot of every occurrence, and bucket and count of every slot."""

    slot: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def intern(data: Bytes, start: np.ndarray, length: np.ndarray, buckets: int) -> Interned:
    """Puts byte ranges into a table at most half full, by linear probing.

    All ranges probe side by side. Those that find their slot free claim it, one
    of them gets it, and those with the owner's bytes stay; the others go on.
    """
    n = len(start)
    size = 1 << max(4, (2 * n).bit_length())
    key = data.hashes(start, length)
    slot = (key & np.uint64(size - 1)).astype(np.int64)
    owner = np.full(size, -1, np.int64)
    todo = np.arange(n)
    while len(todo):
        at = slot[todo]
        free = owner[at] < 0
        owner[at[free]] = todo[free]
        held = owner[at]
        same = (key[held] == key[todo]) & (length[held] == length[todo])
        check = np.flatnonzero(same & (held != todo))
        same[check] = data.equal(start[held[check]], start[todo[check]], length[todo[check]])
        todo = todo[~same]
        slot[todo] = (slot[todo] + 1) & (size - 1)
    bucket = np.zeros(size, np.int64)
    used = np.flatnonzero(owner >= 0)
    view, first = data.data.data, start[owner[used]]
    ends = first + length[owner[used]]
    crc = [zlib.crc32(view[i:j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
    bucket[used] = np.array(crc, np.int64) % buckets
    return Interned(slot, bucket, np.bincount(slot, minlength=size))


def ngrams(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, Interned]]:
    """Row of each n-gram of a text column, and the n-grams interned, part by part.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lowered;
    n-grams are words and pairs of words with one space between. Parts have at
    most 131,072 words, so that a text of any length takes bounded room beyond
    its own bytes.
    """
    data, offsets = buffers(texts)
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        bounds = offsets[lo : hi + 1] - offsets[lo]
        begin, end = edges(NOT_ALNUM[ASCII_LOWER[part]], bounds)
        row = np.searchsorted(bounds, begin, side="right") - 1
        for first in range(0, len(begin), _PART_WORDS):
            # One word more, for the pair that the part's last word begins.
            own = slice(first, first + _PART_WORDS + 1)
            size, of_row = end[own] - begin[own], row[own]
            stop = np.cumsum(size + 1) - 1
            start = stop - size
            line = np.full(stop[-1] + 1, 0x20, np.uint8)
            shift = np.repeat(begin[own] - start, size)
            spot = np.arange(len(shift)) + np.repeat(np.arange(len(size)), size)
            line[spot] = ASCII_LOWER[part[spot + shift]]
            singles = np.arange(min(len(size), _PART_WORDS))
            pairs = np.flatnonzero(of_row[1:] == of_row[:-1])
            at = np.concatenate([start[singles], start[pairs]])
            until = np.concatenate([stop[singles], stop[pairs + 1]])
            rows = lo + np.concatenate([of_row[singles], of_row[pairs]])
            yield rows, intern(Bytes(line), at, until - at, buckets)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: occurrences of n-grams by bucket over all rows, summed in each task first.

    A null text has none.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in ngrams(utf8(batch.column(0)), buckets):
                np.add.at(total, found.bucket, found.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    part = docs.select(named(docs, text_col).alias("text")).mapInArrow(of_batches, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of every bucket that the source uses, from counts of both.

    The gain is the floor of 1000 times the logarithm of the ratio of shares,
    each count raised by one; at most ``buckets`` rows.
    """
    both = source.select("bucket", F.col("n").alias("s")).join(
        target.select("bucket", F.col("n").alias("t")), "bucket", "full"
    )
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    over = W.partitionBy()
    shares = (F.col("t") + 1) * (F.sum("s").over(over) + float(buckets))
    shares = shares / ((F.col("s") + 1) * (F.sum("t").over(over) + float(buckets)))
    return both.select("bucket", F.floor(F.log(shares) * 1000).alias("gain"))


def weighted(
    docs: DataFrame,
    gains: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """``(id, text_hash, n_features, weight)`` of every row: the floored mean gain of its n-grams.

    ``gains`` has at most ``buckets`` rows, which every task gets as an array.
    Without n-grams the weight is 0.
    """
    known = gains.toArrow()
    gain = np.zeros(buckets)
    gain[known.column("bucket").to_numpy()] = known.column("gain").to_numpy()
    key = row_key(docs, id_col, text_col)
    rows = docs.select(key["id"].alias("id"), key["text_hash"].alias("text_hash"), named(docs, text_col).alias("text"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for row, found in ngrams(utf8(batch.column("text")), buckets):
                # Whole numbers, exact in doubles.
                total += np.bincount(row, gain[found.bucket][found.slot], minlength=batch.num_rows)
                count += np.bincount(row, minlength=batch.num_rows)
            weight = total.astype(np.int64) // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(count), pa.array(weight)],
                names=["id", "text_hash", "n_features", "weight"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(of_batches, f"id {kind}, text_hash long, n_features long, weight long")


def noise(id_: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate that the id and the seed fix, rounded down; null counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def ranked(scored: DataFrame, wanted: int) -> DataFrame:
    """Adds ``rank`` 1 to ``wanted`` to the rows with the highest ``score``, null to the others.

    Ties go to the smaller id, null last, then to the smaller text hash, then
    the smaller ``row``. Scores are whole numbers in a narrow range (gains and
    noise are logarithms), so a table of counts per score finds the lowest that
    is drawn. Only rows from there on are range-sorted; a row's rank is its
    place in its range and the size of the ranges before.
    """
    by_score = scored.groupBy("score").count()
    upto = F.sum("count").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0))
    lowest = by_score.withColumn("upto", upto).where(F.col("upto") >= wanted).agg(F.max("score")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted or lowest is None:
        return scored.select("*", none)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("text_hash"), F.asc("row")]
    top = scored.where(F.col("score") >= lowest).repartitionByRange(shuffle_width(scored.sparkSession), *order)
    top = top.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    top = durable(top, "ranges").withColumn("range", F.shiftright("place", 33))
    ranges = top.groupBy("range").agg(F.count("*").alias("size"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    # One row per shuffle partition.
    placed = top.join(F.broadcast(ranges), "range")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    placed = placed.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return placed.unionByName(scored.where(F.col("score") < lowest).select("*", none))


def importance_draw(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``(id, text_hash, row, n_features, weight, score, rank)``, one row per row of ``docs``.

    ``percent`` of the rows with at least ``least_words`` words are drawn, those
    with the highest scores; ``rank`` counts them from 1 and is null for all
    others. Null and empty texts have no n-grams, weight 0 and no rank.
    Repeated rows count each and have ranks of their own; equal ids share their
    noise. Texts of any length are counted whole. An empty target has gains
    too; empty ``docs`` give no rows. Other columns are not looked at.
    """
    source = bucket_counts(docs, text_col, buckets)
    gains = bucket_gains(source, bucket_counts(target, target_col, buckets), buckets)
    found = weighted(docs, gains, id_col, text_col, buckets)
    found = found.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    found = durable(found.withColumn("row", F.monotonically_increasing_id()), "scores")
    # n words make 2 n - 1 n-grams.
    fits = F.col("n_features") >= 2 * least_words - 1 if least_words > 0 else F.lit(True)
    eligible = found.where(fits)
    drawn = ranked(eligible, eligible.count() * percent // 100)
    rest = found.where(~fits).withColumn("rank", F.lit(None).cast("long"))
    order = ["id", "text_hash", "row", "n_features", "weight", "score", "rank"]
    return drawn.unionByName(rest).select(*order)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that ``importance_draw`` draws, columns unchanged.

    Rows that repeat both id and text come as often as they are drawn. Columns
    may have any name.
    """
    drawn = importance_draw(docs, target, id_col, text_col, **settings).where("rank IS NOT NULL")
    key, times = fresh(docs, "_key"), fresh(docs, "_times")
    counts = drawn.groupBy(F.struct("id", "text_hash").alias(key)).agg(F.count("*").cast("int").alias(times))
    keyed = docs.select("*", row_key(docs, id_col, text_col).alias(key))
    copies = keyed.dropDuplicates([key]).join(counts, key)
    again = copies.select("*", F.explode(F.sequence(F.lit(1), F.col(times))).alias(fresh(copies, "_nth")))
    return again.select(*columns_of(docs))
