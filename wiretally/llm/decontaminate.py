"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive words; only the kept positions
are hashed, so a substituted word at an ignored position does not hide a copy.
A hit aligns a document with a benchmark item, and the overlap along that
alignment is then compared word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.columns import named
from wiretally.llm.tokens import NOT_ALNUM, mix, per_row, sliced_words, utf8

#: Kept positions. The first three meet every run of 13 words of which any two are
#: substituted; the last two are short and meet what may be substituted in items of
#: fewer words, which alone are indexed by them.
SEEDS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 1, 2), (0, 1, 3))
LONG_SEEDS = 3
#: Words of the overlap window that has to agree.
WINDOW = 13
SIMILARITY = 0.8
SHORT_WORDS = WINDOW
#: Items shorter than this cannot be told from ordinary phrases.
LEAST_WORDS = 5
#: Benchmark bytes that one pass over the documents is matched against.
BLOCK_BYTES = 16 << 20

_FILTER_BITS = 23
#: Pairs of equal seed hashes of one text and one item that are not written out one by one.
_MANY = 1 << 16
_HOW = {"gaps": NOT_ALNUM, "fold": None}


class Items(NamedTuple):
    """One block of the benchmark: all words, and every seed hash with its place."""

    ids: pa.Array
    bounds: np.ndarray
    words: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    filter: np.ndarray


def seed_hashes(word: np.ndarray, row: np.ndarray, seed_no: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions of a seed that lie in one row, and the seed's hash there."""
    seed = SEEDS[seed_no]
    n = len(word) - seed[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, seed_no + 1, np.uint64)
    for k in seed:
        total = total * np.uint64(0x9FB21C651E98DF25) + word[k : k + n]
    inside = np.flatnonzero(row[:n] == row[seed[-1] : seed[-1] + n])
    return inside, mix(total[inside])


def index_items(ids: pa.Array, texts: pa.Array) -> Items:
    """Seed hashes of benchmark items, sorted, with a bitmap that most hashes miss."""
    found = [w for _, _, _, w in sliced_words(texts, 1 << 62, **_HOW)]
    word = found[0].hash if found else np.zeros(0, np.uint64)
    row = found[0].row if found else np.zeros(0, np.int64)
    bounds = per_row(row, len(ids))
    size = np.diff(bounds)
    parts = []
    for k in range(len(SEEDS)):
        first, h = seed_hashes(word, row, k)
        own = size[row[first]]
        fits = own >= LEAST_WORDS if k < LONG_SEEDS else (own >= LEAST_WORDS) & (own < SHORT_WORDS)
        parts.append((first[fits], h[fits]))
    at = np.concatenate([p[0] for p in parts])
    hashes = np.concatenate([p[1] for p in parts])
    order = np.argsort(hashes, kind="stable")
    bitmap = np.zeros(1 << _FILTER_BITS, bool)
    bitmap[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Items(ids, bounds, word, hashes[order], at[order], np.packbits(bitmap, bitorder="little"))


def _maybe(items: Items, h: np.ndarray) -> np.ndarray:
    """False where no item has the hash."""
    bit = h >> np.uint64(64 - _FILTER_BITS)
    return (items.filter[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _best_overlap(same: np.ndarray, item_words: int) -> tuple[int, int, int] | None:
    """Matches, first and end word of the overlap, if the texts agree well enough."""
    window = min(WINDOW, item_words)
    if len(same) < window:
        return None
    run = np.concatenate([[0], np.cumsum(same)])
    agree = run[window:] - run[:-window]
    good = np.flatnonzero(agree >= math.ceil(SIMILARITY * window))
    if len(good):
        first, end = int(good[0]), int(good[-1]) + window
    elif len(same) == item_words and run[-1] >= SIMILARITY * item_words:
        first, end = 0, item_words
    else:
        return None
    return int(run[end] - run[first]), first, end


def _alignments(row: np.ndarray, at: np.ndarray, left: np.ndarray, times: np.ndarray, items: Items) -> np.ndarray:
    """Distinct ``(row, item, start)``: where an item's first word would stand in the text.

    Each hit of a text, at word ``at``, meets ``times`` places of items, from
    ``left`` on in the index. Where one hash is frequent in a text and in an item, as
    in repetitive texts, the differences of places come from a convolution of
    the two, in time that hardly grows with the number of pairs.
    """
    # Hits of one hash in one row are a group, and so are an item's places of a hash.
    order = np.lexsort((at, left, row))
    row, at, left, times = row[order], at[order], left[order], times[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (left[1:] != left[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    many = count * times[first] > _MANY
    plain = ~np.repeat(many, count)
    reps = times[plain]
    nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    q = items.at[np.repeat(left[plain], reps) + nth]
    item = np.searchsorted(items.bounds, q, side="right") - 1
    start = np.repeat(at[plain], reps) - (q - items.bounds[item])
    found = [np.stack([np.repeat(row[plain], reps), item, start])]
    for lo, n in zip(first[many].tolist(), count[many].tolist(), strict=True):
        places = np.sort(items.at[left[lo] : left[lo] + times[lo]])
        owner = np.searchsorted(items.bounds, places, side="right") - 1
        spots = at[lo : lo + n]
        for i in np.unique(owner).tolist():
            own = places[owner == i] - items.bounds[i]
            shifts = _differences(spots, own)
            found.append(np.stack([np.full(len(shifts), row[lo]), np.full(len(shifts), i), shifts]))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distinct ``x - y`` with x of ``a`` and y of ``b``."""
    if len(a) * len(b) <= _MANY:
        return np.unique(a[:, None] - b[None])
    low, high = a.min(), b.max()
    x, y = np.zeros(a.max() - low + 1), np.zeros(high - b.min() + 1)
    x[a - low] = 1
    y[high - b] = 1
    size = 1 << int(len(x) + len(y) - 1).bit_length()
    met = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[: len(x) + len(y) - 1]
    return np.flatnonzero(met > 0.5) + low - high


def _best_of(word: np.ndarray, lo: int, hi: int, starts: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
    """Matches, first and end word of the best overlap of ``word[lo:hi]`` with an item.

    Alignments with the longest overlap go first, later ones before earlier
    ones, so that the rest can be left out as soon as none of them can win.
    """
    first = np.maximum(starts, lo)
    end = np.minimum(starts + len(item), hi)
    best = (0, 0, 0)
    for k in np.lexsort((-first, first - end)).tolist():
        a, b, start = int(first[k]), int(end[k]), int(starts[k])
        if b - a < best[0] or (b - a == best[0] and a - lo < best[1]):
            break
        same = word[a:b] == item[a - start : b - start]
        if found := _best_overlap(same, len(item)):
            best = max(best, (found[0], found[1] + a - lo, found[2] + a - lo))
    return best if best[0] else None


def overlaps(texts: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """``(row, item, first word, end word, matches)`` of each verified overlap, best per pair."""
    if not len(items.hashes):
        return
    for lo, hi, _, w in sliced_words(texts, **_HOW):
        bounds = per_row(w.row, hi - lo)
        spots, marks = [], []
        for k in range(len(SEEDS)):
            at, h = seed_hashes(w.hash, w.row, k)
            may = _maybe(items, h)
            spots.append(at[may])
            marks.append(h[may])
        at, h = np.concatenate(spots), np.concatenate(marks)
        left = np.searchsorted(items.hashes, h, "left")
        times = np.searchsorted(items.hashes, h, "right") - left
        hit = times > 0
        if not hit.any():
            continue
        at, left, times = at[hit], left[hit], times[hit]
        row, item, start = _alignments(w.row[at], at, left, times, items)
        cuts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
        for k, until in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)], strict=True):
            r, i = int(row[k]), int(item[k])
            own = items.words[items.bounds[i] : items.bounds[i + 1]]
            if best := _best_of(w.hash, int(bounds[r]), int(bounds[r + 1]), start[k:until], own):
                matches, first, end = best
                yield lo + r, i, first, end, matches


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_BYTES``, each indexed on its own.

    A benchmark of any size goes through in blocks, so what a task holds is
    bounded; each block costs one pass over the documents.
    """
    rows = benchmark.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    rows = rows.where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toArrow()
        part = part.sort_by([("id", "ascending"), ("text", "ascending")])
        yield index_items(part.column("id").combine_chunks(), utf8(part.column("text")))


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, first_word, end_word, matches, similarity)`` per overlapping pair.

    Words are runs of letters and digits in lower case. A pair is reported if,
    along one alignment, a window of 13 words (or the whole item, if shorter)
    agrees in 80 % of its words, or 80 % of the whole item does. The span covers
    the first to the last such window of the best alignment. Null and empty
    texts, and items of fewer than 5 words, overlap nothing; repeated rows are
    each reported; equal items are reported each under its id. Texts of any
    length are compared whole; other columns are not looked at.
    """
    id_type = docs.schema[doc_id].dataType
    item_type = benchmark.schema[item_id].dataType
    rows = docs.select(named(docs, doc_id).alias("id"), F.lower(named(docs, text_col)).alias("text"))
    schema = (
        f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, "
        "first_word int, end_word int, matches int, similarity double"
    )

    def against(items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                found = np.array(list(overlaps(utf8(batch.column("text")), own)), np.int64)
                row, item, first, end, matches = found.reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(row)),
                        own.ids.take(pa.array(item)),
                        *[pa.array(x.astype(np.int32)) for x in (first, end, matches)],
                        pa.array(matches / np.maximum(end - first, 1)),
                    ],
                    names=["doc_id", "item_id", "first_word", "end_word", "matches", "similarity"],
                )

        return rows.mapInArrow(of_batches, schema)

    found = None
    for items in item_blocks(benchmark, item_id, text_col):
        found = against(items) if found is None else found.unionAll(against(items))
    return found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows that overlap any benchmark item; see ``benchmark_overlaps``.

    Rows are filtered where they lie, without a shuffle. Columns may have any
    name; null and empty texts stay.
    """
    columns, own_text = docs.columns, text_col
    plain = [f"c{k}" for k in range(len(columns))]
    text_col = plain[columns.index(text_col)]
    docs = docs.toDF(*plain)
    for items in item_blocks(benchmark, item_id, own_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        lowered = docs.select("*", F.lower(text_col).alias("lowered"))

        def of_batches(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                text = batch.column(batch.num_columns - 1)
                clean[[row for row, *_ in overlaps(utf8(text), shared.value)]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(clean))

        docs = lowered.mapInArrow(of_batches, docs.schema)
    return docs.toDF(*columns)
