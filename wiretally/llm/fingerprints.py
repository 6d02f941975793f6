"""Document fingerprints: SimHash over weighted terms, and tables to search them.

Every term of a document, a run of words, has a 64-bit hash and a weight that
grows with the logarithm of its count. Each bit of the hash votes for or against
the fingerprint's bit with that weight. Fingerprints within a Hamming radius are
found through permuted block tables: the bits are cut into blocks, and each
table brings other blocks to the front and matches them exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.tokens import mix, sliced_words, utf8

BITS = 64
#: Words of a term.
TERM_WORDS = 3
#: Ranges of ids per shuffle partition, so that no partition gets much more than its share.
RANGES = 4

_STEP = 1 << 16


def terms(word: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words, of all words in shorter rows."""
    if not len(word):
        return row, word
    count = np.bincount(row)
    size = np.minimum(count, width)[row]
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    place = np.arange(len(word)) - first[row]
    begins = np.flatnonzero(place + size <= count[row])
    total = np.zeros(len(begins), np.uint64)
    for k in range(width):
        inside = k < size[begins]
        at = np.minimum(begins + k, len(word) - 1)
        total = np.where(inside, total * np.uint64(0x9FB21C651E98DF25) + word[at], total)
    return row[begins], mix(total)


def distinct_terms(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct terms, rows ascending, and their counts."""
    marked = mix(term ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first, count = np.unique(marked, return_index=True, return_counts=True)
    order = np.argsort(first)
    return row[first[order]], term[first[order]], count[order]


def votes(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """Fingerprints of rows from their terms' hashes and whole-number weights."""
    weight = weight.astype(np.float32)
    balance = np.zeros((n_rows, BITS), np.float64)
    for lo in range(0, len(row), _STEP):
        part = slice(lo, lo + _STEP)
        bits = np.unpackbits(term[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        signed = (bits.astype(np.float32) * 2 - 1) * weight[part, None]
        cuts = np.flatnonzero(np.diff(row[part], prepend=-1))
        balance[row[part][cuts]] += np.add.reduceat(signed, cuts, axis=0)
    return np.packbits(balance > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint_texts(texts: pa.Array, width: int = TERM_WORDS) -> np.ndarray:
    """64-bit fingerprints. Words are cut at ASCII white space, A-Z lowered; none give 0."""
    found = np.zeros(len(texts), np.uint64)
    for lo, hi, _, w in sliced_words(texts, 1 << 20):
        row, term, count = distinct_terms(*terms(w.hash, w.row, width))
        # In eighths, so that sums are exact and equal texts get equal fingerprints.
        found[lo:hi] = votes(row, term, np.round(8 + 8 * np.log2(count)), hi - lo)
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprinted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = TERM_WORDS
) -> DataFrame:
    """``(id, fp)`` of every row, ``fp`` as a signed 64-bit number; null texts count as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprint_texts(utf8(batch.column("text")), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp)], names=["id", "fp"])

    return rows.mapInArrow(of_batches, f"id {kind}, fp long")


def block_tables(radius: int, blocks: int) -> list[int]:
    """Masks, as signed numbers, of the bits that each table matches exactly.

    At most ``radius`` of the blocks can differ, so that for every pair within
    the radius some choice of ``blocks - radius`` blocks is equal throughout.
    """
    bounds = [round(k * BITS / blocks) for k in range(blocks + 1)]
    block = [(1 << bounds[k + 1]) - (1 << bounds[k]) for k in range(blocks)]
    masks = [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def within_radius(
    queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int | None = None
) -> DataFrame:
    """``(query, fp, distance)``: all distinct fingerprints near each distinct query fingerprint.

    Both tables have ``fp``. ``blocks`` sets how many leading bits a table
    matches; by default they outnumber the fingerprints' logarithm, so that
    tables have few chance hits at any size. The result does not depend on it.
    Distinct fingerprints are compared, so copies cost nothing here; tables with
    many equal keys are left to Spark's splitting of skewed joins.
    """
    known = fingerprints.select("fp").where("fp is not null").distinct()
    asked = queries.select(F.col("fp").alias("query")).where("query is not null").distinct()
    if blocks is None:
        need = max(8, known.count().bit_length())
        sizes = range(radius + 1, 2 * radius + 3)
        enough = (b for b in sizes if BITS * (b - radius) // b >= need)
        blocks = next(enough, sizes[-1])
    masks = F.array(*[F.lit(m) for m in block_tables(radius, blocks)])

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select(name, F.posexplode(masks).alias("block", "mask"))
        return each.select(name, "block", F.col(name).bitwiseAND(F.col("mask")).alias("front"))

    pairs = keyed(asked, "query").join(keyed(known, "fp"), ["block", "front"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))).cast("int")
    pairs = pairs.select("query", "fp", distance.alias("distance")).where(F.col("distance") <= radius)
    return pairs.distinct()


def with_near_counts(found: DataFrame, asked: Column, radius: int = 3) -> DataFrame:
    """Adds ``n_near`` to rows with ``fp`` in hex: how many rows lie within the radius.

    Rows where ``asked`` holds are looked up among all rows, themselves
    included; the others have null.
    """
    number = F.conv("fp", 16, -10).cast("long")
    copies = found.groupBy(number.alias("fp")).agg(F.count("*").alias("n"))
    chosen, rest = found.where(asked), found.where(~asked | asked.isNull())
    near = within_radius(chosen.select(number.alias("fp")), copies, radius)
    near = near.join(copies, "fp").groupBy("query").agg(F.sum("n").alias("n_near"))
    counted = chosen.withColumn("query", number).join(near, "query", "left").drop("query")
    return counted.unionByName(rest.withColumn("n_near", F.lit(None).cast("long")))


class _Place(NamedTuple):
    """Where a document goes: code 2k for range k, 2k + 1 behind it as its follower."""

    cuts: np.ndarray

    def codes(self, ids: pd.Series) -> pd.Series:
        """Range times 2, plus 1 for a document that heads its range."""
        known = ids.notna().to_numpy()
        value = ids.fillna(0).to_numpy().astype(np.int64)
        below = np.searchsorted(self.cuts, value, side="left")
        head = np.zeros(len(value), bool)
        if len(self.cuts):
            head = self.cuts[np.minimum(below, len(self.cuts) - 1)] == value
        code = 2 * (len(self.cuts) - below) + head
        return pd.Series(np.where(known, code, 2 * len(self.cuts)))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _in_order(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each document with the one after it, over batches sorted by range and place."""

    def batch_of(ids: list, texts: list[str], fps: list[int], after: list[int]) -> pa.RecordBatch:
        own = np.array(fps, np.uint64)
        kept = [i for i, k in enumerate(after) if k >= 0]
        changed = [edited(texts[i], texts[after[i]]) for i in kept]
        own_fp, next_fp = own[kept], own[[after[i] for i in kept]]
        edited_fp = fingerprint_texts(pa.array(changed, pa.large_string()), width)
        shown = lambda found: [f"{x:016x}" for x in found.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in kept], pa.int64()),
                pa.array([len(texts[i]) for i in kept], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(shown(own_fp), pa.string()),
                pa.array(shown(edited_fp), pa.string()),
                pa.array(likeness(own_fp, edited_fp), pa.float64()),
                pa.array(likeness(own_fp, next_fp), pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"],
        )

    held: tuple | None = None  # the last document so far, which waits for the next one
    head: tuple | None = None  # the first document of the range at hand
    for batch in batches:
        texts = utf8(batch.column("text"))
        rows = list(zip(
            batch.column("place").to_pylist(), batch.column("id").to_pylist(), texts.to_pylist(),
            fingerprint_texts(texts, width).tolist(), strict=True,
        ))
        out: list[tuple] = [held] if held else []
        after = [-1] * len(out)
        follows = [head]
        pending = 0 if held else -1  # index in ``out`` of the document that waits
        for row in rows:
            place = row[0]
            if pending >= 0 and out[pending][0] // 2 != place // 2:
                out.append(follows[-1])  # a range that nothing follows: its own first document
                after.append(-1)
                after[pending] = len(out) - 1
                pending, head = -1, None
            if place % 2:
                if pending >= 0:
                    out.append(row)
                    after.append(-1)
                    after[pending] = len(out) - 1
                pending, head = -1, None
                continue
            out.append(row)
            after.append(-1)
            if pending >= 0:
                after[pending] = len(out) - 1
            else:
                head = row
                follows.append(head)
            pending = len(out) - 1
        held = out[pending] if pending >= 0 else None
        if out:
            yield batch_of([r[1] for r in out], [r[2] for r in out], [r[3] for r in out], after)
    if held:
        both = [held, head]
        yield batch_of([r[1] for r in both], [r[2] for r in both], [r[3] for r in both], [1, -1])


def edit_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = TERM_WORDS
) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how near both and the next come.

    The next document is the one with the next lower id (equal ids: by text
    hash; null ids last), after the last the first. The edited text has its last
    third replaced by the start of the next document. Returns ``(id, n_chars,
    edited_sha256, fp, edited_fp, near_edited, near_next)``, one row per row.
    Null texts count as empty; a table of one row is followed by itself.

    Ids, whole numbers, are cut into ranges at values that occur. The document
    that heads a range also goes behind the range before it, so that each range
    is complete, and texts move once.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    width_now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = width_now * RANGES
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    found = docs.select(F.col(id_col).cast("long").alias("id")).agg(
        F.percentile_approx("id", shares, 100 * ranges).alias("cuts"), F.max("id").alias("most")
    ).first()
    cuts = np.unique(np.array(found["cuts"] or [], np.int64))
    if len(cuts) and cuts[-1] == found["most"]:
        cuts = cuts[:-1]
    placing = _Place(cuts)
    code = F.pandas_udf(lambda ids: placing.codes(ids), "long")
    rows = rows.withColumn("code", code("id"))
    own = F.col("code") - F.col("code") % 2
    none = F.array().cast("array<bigint>")
    behind = F.when(F.col("code") % 2 == 1, F.array(own - 1)).otherwise(none)
    if found["most"] is not None:
        around = F.array(F.lit(2 * len(cuts) + 1).cast("long"))
        behind = F.concat(behind, F.when(F.col("id") == found["most"], around).otherwise(none))
    placed = rows.withColumn("place", F.explode(F.concat(F.array(own), behind))).drop("code")
    placed = placed.withColumn("text_hash", F.xxhash64("text"))
    placed = placed.withColumn("range", F.shiftright("place", 1))
    placed = placed.repartition(width_now, "range").sortWithinPartitions(
        "place", F.col("id").desc_nulls_last(), "text_hash"
    )
    return placed.select("place", "id", "text").mapInArrow(
        lambda batches: _in_order(batches, width),
        "id long, n_chars long, edited_sha256 string, fp string, edited_fp string, "
        "near_edited double, near_next double",
    )
