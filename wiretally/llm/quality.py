"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is the log odds of a logistic model over hashed
words, token shapes and layout ratios. The sites a document comes from add
theirs: the mean of a host shrinks toward that of all documents, the mean of a
path toward its host's, each by as much as the spread between sites and the
spread within them say. A site with few documents thus says little.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wiretally.llm.columns import columns_of, fresh, named, row_key
from wiretally.llm.storage import durable
from wiretally.llm.tokens import (
    ASCII_LOWER,
    NOT_ALNUM,
    WHITESPACE,
    buffers,
    hashes,
    mix,
    per_row,
    slices,
    utf8,
    words,
)

BUCKET_BITS = 18
#: Bytes of the word beginnings that are features beside the words.
STEMS = (4, 5)
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
THRESHOLD = 0.5
#: Bounds of the shrinkage, in documents' worth of evidence.
STRENGTH = (1.0, 1e6)

_SHIFT = np.uint64(64 - BUCKET_BITS)
_LEVELS = 12

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")


class Features(NamedTuple):
    """Distinct feature buckets of each row, rows ascending."""

    row: np.ndarray
    bucket: np.ndarray


def _ratios(data, offsets, token, n_rows: int, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bucket per row and layout ratio, in steps that are finer near 0."""
    count = np.bincount(token.row, minlength=n_rows)
    byte_row = np.repeat(np.arange(n_rows), np.diff(offsets))

    def share(mark: np.ndarray, rows: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.bincount(rows[mark], minlength=n_rows) / np.maximum(whole, 1)

    solid = np.bincount(byte_row[~WHITESPACE[data]], minlength=n_rows)
    same = np.zeros(len(token.hash), bool)
    same[1:] = (token.hash[1:] == token.hash[:-1]) & (token.row[1:] == token.row[:-1])
    ratios = [
        share((data >= 0x41) & (data <= 0x5A), byte_row, solid),
        share(NOT_ALNUM[data] & ~WHITESPACE[data], byte_row, solid),
        share(same, token.row, count),
        distinct / np.maximum(count, 1),
        np.minimum(solid / np.maximum(count, 1) / 40, 1),
    ]
    levels = [np.minimum((np.sqrt(r) * _LEVELS).astype(np.int64), _LEVELS) for r in ratios]
    rows = np.tile(np.arange(n_rows), len(levels))
    codes = np.concatenate([k * (_LEVELS + 1) + x for k, x in enumerate(levels)])
    return rows, (mix(codes.astype(np.uint64) + np.uint64(1)) >> _SHIFT).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    """Hashed words and their beginnings, token shapes (runs of one character class) and ratios."""
    n_rows = len(offsets) - 1
    low = ASCII_LOWER[data]
    word = words(low, offsets, NOT_ALNUM, None)
    token = words(data, offsets, WHITESPACE, None)
    shape = _SHAPE[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[token.start] = True
    kept = ~WHITESPACE[data]
    kept[1:] &= (shape[1:] != shape[:-1]) | starts[1:-1]
    place = np.concatenate([[0], np.cumsum(kept)])
    shapes = hashes(shape[kept], place[token.start], place[token.end])
    shapes = mix(shapes + np.uint64(0x5851F42D4C957F2D))

    def keys(row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return np.unique((row << BUCKET_BITS) | bucket)

    of_words = keys(word.row, (word.hash >> _SHIFT).astype(np.int64))
    distinct = np.bincount(of_words >> BUCKET_BITS, minlength=n_rows)
    stems = [
        keys(word.row[long], ((mix(hashes(low, word.start[long], word.start[long] + n)) >> _SHIFT)).astype(np.int64))
        for n in STEMS
        for long in [word.end - word.start > n]
    ]
    of_shapes = keys(token.row, (shapes >> _SHIFT).astype(np.int64))
    of_ratios = keys(*_ratios(data, offsets, token, n_rows, distinct))
    key = np.unique(np.concatenate([of_words, *stems, of_shapes, of_ratios]))
    return Features(key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1))


def sliced_features(texts: pa.Array) -> Iterator[tuple[int, int, Features]]:
    data, offsets = buffers(texts)
    for lo, hi in slices(offsets):
        yield lo, hi, features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


class Model(NamedTuple):
    weight: np.ndarray
    bias: float

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts))
        for lo, hi, f in sliced_features(texts):
            found[lo:hi] = np.bincount(f.row, self.weight[f.bucket], minlength=hi - lo)
        return found + self.bias


def fit_model(rows: list[np.ndarray], good: np.ndarray, rounds: int = 12, step: float = 0.3) -> Model:
    """Logistic regression by adaptive gradient steps over the rows in a fixed order."""
    n_good = float(good.sum())
    prior = float(np.log((n_good + 0.5) / (len(good) - n_good + 0.5)))
    weight = np.zeros(1 << BUCKET_BITS)
    if n_good in (0.0, float(len(good))):
        return Model(weight, prior if len(good) else 0.0)
    seen = np.full(1 << BUCKET_BITS, 1e-8)
    bias, bias_seen = prior, 1e-8
    order = np.random.default_rng(17)
    for _ in range(rounds):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            bucket = np.concatenate([rows[i] for i in batch])
            local = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            z = np.bincount(local, weight[bucket], minlength=len(batch)) + bias
            miss = good[batch] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            touched, inverse = np.unique(bucket, return_inverse=True)
            slope = np.bincount(inverse, miss[local]) - 1e-3 * weight[touched]
            seen[touched] += slope * slope
            weight[touched] += step * slope / np.sqrt(seen[touched])
            bias_seen += float(miss.sum()) ** 2
            bias += step * float(miss.sum()) / np.sqrt(bias_seen)
    return Model(weight, bias)


def labelled(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, good)``: good is quality 1 and not toxic; the worse of repeated labels counts."""
    toxic = F.coalesce("toxic", F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    good = F.when(F.col("quality") == 1, 1 - toxic).otherwise(0).cast("int")
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.min(good).alias("good"))


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
) -> Model:
    """The model, from at most ``fit_rows`` labelled documents that a hash of the id picks.

    Only the picked ids, few by the bound, are sent to all tasks. The features
    of their documents meet in one task, which fits the model; the driver sees
    nothing but the weights.
    """
    picked = labelled(labels, id_col).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    chosen = docs.select(named(docs, id_col).alias("id"), named(docs, text_col).alias("text"))
    chosen = chosen.join(F.broadcast(picked), "id").select("id", "good", "text")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for lo, hi, f in sliced_features(utf8(batch.column("text"))):
                bounds = per_row(f.row, hi - lo)
                bucket = f.bucket.astype(np.int32)
                found += [bucket[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("good"), pa.array(found, pa.binary())],
                names=["id", "good", "buckets"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = [row for batch in held for row in _bucket_rows(batch.column("buckets"))]
        ids = [i for batch in held for i in batch.column("id").to_pylist()]
        good = np.array([g for batch in held for g in batch.column("good").to_pylist()], np.float64)
        order = sorted(range(len(rows)), key=lambda i: (ids[i], len(rows[i]), int(rows[i].sum())))
        model = fit_model([rows[i] for i in order], good[order])
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weight.tobytes()]), pa.array([float(model.bias)])], names=["weight", "bias"]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    sample = chosen.mapInArrow(of_batches, f"id {kind}, good int, buckets binary")
    # At most ``fit_rows`` rows.
    model = sample.repartition(1).mapInArrow(fit, "weight binary, bias double").first()
    if model is None:
        return fit_model([], np.zeros(0))
    return Model(np.frombuffer(bytes(model["weight"])), model["bias"])


def _bucket_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The buckets of each row, as views into the column."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.int32) if data is not None else np.zeros(0, np.int32)
    return (values[i // 4 : j // 4] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Mean over all documents, and within-group over between-group variance."""
    n, mean = F.col("n"), F.col("s") / F.col("n")
    total: Row = groups.agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.sum(n * mean * mean).alias("between"),
        F.sum(n * n).alias("squares"),
    ).first()
    if not total["n"]:
        return 0.5, STRENGTH[1]
    mean = total["s"] / total["n"]
    within = max(total["q"] - total["between"], 0.0) / max(total["n"] - total["groups"], 1)
    spread = total["between"] - total["n"] * mean * mean - (total["groups"] - 1) * within
    scale = total["n"] - total["squares"] / total["n"]
    between = spread / scale if scale > 0 else 0.0
    strength = within / between if between > 0 else STRENGTH[1]
    return mean, min(max(strength, STRENGTH[0]), STRENGTH[1])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_posteriors(
    docs: DataFrame,
    model: Model,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(id, text_hash, p_text, p_host, p_path, p_good, keep)`` of every row.

    ``p_text`` is the text's own probability of being good, ``p_host`` and
    ``p_path`` are the shrunken means of its sites, the path's without the
    document itself, and ``p_good`` combines text and path. A null host or path
    is a site of its own. Null and empty texts are judged like any other, by
    the features of an empty text, and very long ones as a whole; repeated rows
    each count.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = row_key(docs, id_col, text_col)
    rows = docs.select(
        own["id"].alias("id"),
        own["text_hash"].alias("text_hash"),
        host.cast("string").alias("host"),
        path.cast("string").alias("path"),
        named(docs, text_col).alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = shared.value.log_odds(utf8(batch.column("text")))
            names = ["id", "text_hash", "host", "path"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(odds)], names=[*names, "odds"]
            )

    scored = rows.mapInArrow(
        of_batches, f"id {kind}, text_hash long, host string, path string, odds double"
    )
    scored = durable(scored.withColumn("p", 1 / (1 + F.exp(-F.col("odds")))), "evidence")
    scored = scored.withColumn("site", F.struct("host", "path"))
    paths = scored.groupBy("site").agg(
        F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")
    )
    paths = durable(paths, "paths").withColumn("at", F.struct("site.host"))
    hosts = paths.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean, host_strength = _strength(hosts)
    _, path_strength = _strength(paths)
    host_mean = (F.col("s") + host_strength * mean) / (F.col("n") + host_strength)
    hosts = hosts.select("at", host_mean.alias("p_host"))
    sites = paths.join(hosts, "at").select("site", "n", "s", "p_host")
    others = F.col("s") - F.col("p") + path_strength * F.col("p_host")
    path_mean = others / (F.col("n") - 1 + path_strength)
    prior = _logit(F.lit(mean))
    found = scored.join(sites, "site").withColumn("p_path", path_mean)
    found = found.withColumn(
        "p_good", 1 / (1 + F.exp(-(F.col("odds") + _logit(F.col("p_path")) - prior)))
    )
    return found.select(
        "id", "text_hash", F.col("p").alias("p_text"), "p_host", "p_path", "p_good",
        (F.col("p_good") >= threshold).alias("keep"),
    )


def drop_low_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns unchanged.

    See ``site_posteriors`` for nulls, empty and very long texts and repeated
    rows. Columns may have any name. Empty ``docs`` or ``labels`` give no rows
    and a model without weights.
    """
    model = fitted(docs, labels, id_col, text_col)
    judged = site_posteriors(docs, model, host, path, id_col, text_col)
    key = fresh(docs, "_row_key")
    kept = judged.where("keep").select(F.struct("id", "text_hash").alias(key))
    keyed = docs.select("*", row_key(docs, id_col, text_col).alias(key))
    return keyed.join(kept, key, "left_semi").select(*columns_of(docs))
