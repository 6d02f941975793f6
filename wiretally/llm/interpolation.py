"""Language-model scoring by deleted interpolation.

A word's probability after another mixes three maximum-likelihood estimates:
of the pair, of the word, and of any word. The mixture depends on how often the
context was seen; its weights are learned by expectation-maximisation on the
pairs of documents held out from the counts.

Texts are encoded once into chunks of word numbers. Each chunk asks for the
corpus counts of its distinct words and pairs, sorted 64-bit keys dealt by
range, and gets them back as arrays. A key is asked for once per chunk at most,
so that no word or pair, however frequent, weighs on one task.

A task holds one chunk at a time, and few arrays of its length: what is worked
out per pair goes through blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.storage import durable
from wiretally.llm.tokens import mix, sliced_words, utf8

#: Text bytes of a chunk.
CHUNK_BYTES = 16 << 20
#: Pairs of a chunk that are worked on at once.
BLOCK = 1 << 17
#: Roles of a document: only scored, counted, and held out from the counts to learn the weights.
SCORED, COUNTED, HELD = 0, 1, 2
#: Parts of the key range for each shuffle partition.
PARTS = 2
EM_ROUNDS = 60
#: The least weight of the any-word estimate, so that every text has a probability.
FLOOR = 1e-4

_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x632BE59BD9B4E019)
_BUCKETS = 48
#: Steps of log2 in which probabilities are tallied for the weights.
_FINE = 4
_STATS = -1


def packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: most high bytes are 0."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * width, codec="zstd", asbytes=True) if n else b""
    planes = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return np.ascontiguousarray(planes).view(kind)[:, 0] if n else np.zeros(0, kind)


def packed_keys(keys: np.ndarray, least: int) -> bytes:
    """Ascending keys, by the steps from ``least`` up."""
    return packed(np.diff(keys, prepend=np.uint64(least)))


def unpacked_keys(data: bytes, n: int, least: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, np.uint64), dtype=np.uint64) + np.uint64(least)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct values, and where among them each value is."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    found = ordered[first]
    del ordered
    place = np.cumsum(first, dtype=np.int32)
    place -= 1
    index = np.empty(len(values), np.int32)
    index[order] = place
    return found, index


def blocks(n: int) -> Iterator[slice]:
    return (slice(lo, min(lo + BLOCK, n)) for lo in range(0, n, BLOCK))


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other; a whole batch of chunks is never made into Python objects."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class Chunk(NamedTuple):
    """Word numbers of consecutive documents, each ended by the end token."""

    vocabulary: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    roles: np.ndarray

    def token_roles(self) -> np.ndarray:
        return np.repeat(self.roles, self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (context, word) codes, and the code's index per token.

        The context of a first word is the start, numbered after the vocabulary.
        """
        n = len(self.vocabulary)
        code = np.empty(len(self.words), np.int64)
        code[1:] = self.words[:-1]
        code[np.cumsum(self.lengths) - self.lengths] = n
        code *= n + 1
        code += self.words
        return distinct(code)

    def pair_keys(self, codes: np.ndarray) -> np.ndarray:
        n = len(self.vocabulary)
        hashes = np.concatenate([self.vocabulary, [_START]])
        keys = np.empty(len(codes), np.uint64)
        for at in blocks(len(codes)):
            context, word = np.divmod(codes[at], n + 1)
            keys[at] = mix(
                hashes[context] * np.uint64(0x9FB21C651E98DF25) + hashes[word] * np.uint64(0xD6E8FEB86659FD93)
            )
        return keys


_ENCODED = "chunk long, n_words int, n_tokens int, vocabulary binary, words binary, lengths binary, roles binary"


def encoded(docs: DataFrame, role: Column, id_col: str, text_col: str) -> DataFrame:
    """Chunks of whole documents, with their ids; written once, since chunks follow batches."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), role.cast("int").alias("role"), F.col(text_col).alias("text")
    )

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, made = (context.partitionId() if context else 0) << 32, 0
        ids: list[pa.Array] = []
        roles: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            lengths = np.concatenate(counts) + 1
            word = np.empty(int(lengths.sum()), np.uint64)
            end = np.zeros(len(word), bool)
            end[np.cumsum(lengths) - 1] = True
            word[end] = _END
            word[~end] = np.concatenate(hashes)
            vocabulary, index = distinct(word)
            order = np.argsort(-np.bincount(index), kind="stable")  # small numbers for frequent words
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            own = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([base + made], pa.int64()),
                    pa.array([len(vocabulary)], pa.int32()),
                    pa.array([len(word)], pa.int32()),
                    pa.array([vocabulary[order].tobytes()], pa.binary()),
                    pa.array([packed(rank[index])], pa.binary()),
                    pa.array([packed(lengths.astype(np.int32))], pa.binary()),
                    pa.array([np.concatenate(roles).astype(np.int8).tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                ],
                names=["chunk", "n_words", "n_tokens", "vocabulary", "words", "lengths", "roles", "ids"],
            )

        for batch in batches:
            texts = utf8(batch.column("text"))
            for lo, hi, data, w in sliced_words(texts):
                ids.append(batch.column("id").slice(lo, hi - lo))
                roles.append(batch.column("role").slice(lo, hi - lo).to_numpy())
                hashes.append(w.hash)
                counts.append(np.bincount(w.row, minlength=hi - lo))
                size += len(data) + 64 * (hi - lo)
                if size >= CHUNK_BYTES:
                    yield chunk()
                    made, size = made + 1, 0
                    ids, roles, hashes, counts = [], [], [], []
        if ids:
            yield chunk()

    return rows.mapInArrow(of_batches, f"{_ENCODED}, ids array<{kind}>")


def _chunk(row: dict) -> Chunk:
    roles = np.frombuffer(row["roles"], np.int8)
    return Chunk(
        np.frombuffer(row["vocabulary"], np.uint64),
        unpacked(row["words"], row["n_tokens"], np.int32),
        unpacked(row["lengths"], len(roles), np.int32),
        roles,
    )


_CHUNK_COLUMNS = ["chunk", "n_words", "n_tokens", "vocabulary", "words", "lengths", "roles"]
_COUNTS = "chunk long, part int, n int, counted binary, kept binary"


def _least(part: int, parts: int) -> int:
    """The smallest key of a part."""
    return part % parts << (65 - parts.bit_length())


def _requests(parts: int):
    """Keys of each chunk by part, with its own counts of all and of not held-out training tokens."""
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def asked(chunk: int, first: int, keys: np.ndarray, at: np.ndarray, role: np.ndarray) -> Iterator[tuple]:
        counted = np.bincount(at[role != SCORED], minlength=len(keys))
        kept = np.bincount(at[role == COUNTED], minlength=len(keys))
        order = np.argsort(keys)
        keys = keys[order]
        lows = np.arange(1, parts, dtype=np.uint64) << shift if parts > 1 else []
        cuts = [0, *np.searchsorted(keys, lows).tolist(), len(keys)]
        for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if lo < hi:
                pick = order[lo:hi]
                yield (
                    chunk, first + p, hi - lo, packed_keys(keys[lo:hi], _least(p, parts)),
                    packed(counted[pick]), packed(kept[pick]),
                )

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            own = _chunk(row)
            role = own.token_roles()
            out = [*asked(row["chunk"], 0, own.vocabulary, own.words, role)]
            codes, index = own.pairs()
            keys = own.pair_keys(codes)
            del codes
            out += asked(row["chunk"], parts, keys, index, role)
            del keys, index
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x, t)
                    for x, t in zip(
                        zip(*out, strict=True),
                        (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()),
                        strict=True,
                    )
                ],
                names=["chunk", "part", "n", "keys", "counted", "kept"],
            )

    return of_batches


def _served(parts: int):
    """Corpus counts for all requests of a part, and how many words it has in training."""

    def of_part(table: pa.Table) -> pa.Table:
        size = table.column("n").to_pylist()
        least = _least(table.column("part")[0].as_py(), parts)
        bounds = [0, *np.cumsum(size).tolist()]
        keys = np.empty(bounds[-1], np.uint64)
        for data, lo, hi in zip(table.column("keys"), bounds[:-1], bounds[1:], strict=True):
            keys[lo:hi] = unpacked_keys(data.as_py(), hi - lo, least)
        found, index = distinct(keys)
        del keys
        sums, back = [], []
        for name in ("counted", "kept"):
            total = np.zeros(len(found), np.int64)
            for data, lo, hi in zip(table.column(name), bounds[:-1], bounds[1:], strict=True):
                np.add.at(total, index[lo:hi], unpacked(data.as_py(), hi - lo, np.int64))
            sums.append(total)
            back.append([packed(total[index[lo:hi]]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)])
        part = table.column("part")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        if part < parts:
            types = [packed(np.array([(total > 0).sum()])) for total in sums]
            chunks, size = [*chunks, _STATS], [*size, 1]
            back = [[*b, t] for b, t in zip(back, types, strict=True)]
        return pa.table(
            {
                "chunk": pa.array(chunks, pa.int64()),
                "part": pa.array([part] * len(chunks), pa.int32()),
                "n": pa.array(size, pa.int32()),
                "counted": pa.array(back[0], pa.binary()),
                "kept": pa.array(back[1], pa.binary()),
            }
        )

    return of_part


class Corpus(NamedTuple):
    """Totals over the training documents, all and not held out."""

    tokens: tuple[int, int]
    types: tuple[int, int]
    docs: tuple[int, int]


_ANSWERED = (
    "chunk long, n_words int, n_pairs int, n_tokens int, words binary, lengths binary, roles binary, "
    "counted_words binary, counted_pairs binary, n_cells int, cells binary, times binary, types array<long>"
)


def _answered_rows(kept_tokens: int, kept_docs: int):
    """The chunk's row with its words' and pairs' counts, and the tally of its held-out pairs."""

    def of_chunk(replies: pa.Table, chunks: pa.Table) -> pa.Table:
        order = np.argsort(replies.column("part").to_numpy(), kind="stable")
        replies = replies.take(pa.array(order))
        if not chunks.num_rows:  # the totals' own group
            types = [
                sum(int(unpacked(b.as_py(), 1, np.int64)[0]) for b in replies.column(c)) for c in ("counted", "kept")
            ]
            made = {"chunk": pa.array([_STATS]), "types": pa.array([types])}
            for name in _ANSWERED_COLUMNS[1:-1]:
                made[name] = pa.nulls(1, pa.int32() if name.startswith("n_") else pa.binary())
            made["ids"] = pa.nulls(1, chunks.schema.field("ids").type)
            return pa.table({c: made[c] for c in [*_ANSWERED_COLUMNS, "ids"]})
        own = _chunk(chunks.drop_columns(["ids"]).to_pylist()[0])
        codes, index = own.pairs()
        times = np.bincount(index[own.token_roles() == HELD], minlength=len(codes))
        del index
        n = len(own.vocabulary)
        order = [np.argsort(own.vocabulary), np.argsort(own.pair_keys(codes))]

        def counts(name: str) -> tuple[np.ndarray, np.ndarray]:
            """Of the words and of the pairs; replies come in order of their keys."""
            found = np.empty(n, np.int64), np.empty(len(codes), np.int64)
            done = 0
            for data, size in zip(replies.column(name), replies.column("n").to_pylist(), strict=True):
                kind = int(done >= n)
                lo = done - kind * n
                found[kind][order[kind][lo : lo + size]] = unpacked(data.as_py(), size, np.int64)
                done += size
            return found

        words, pairs = counts("kept")
        held = np.flatnonzero(times)
        cells, times = _tally(own, codes[held], times[held], words, pairs[held], kept_tokens, kept_docs)
        del words, pairs, held
        words, pairs = counts("counted")
        made = {c: chunks.column(c) for c in ("chunk", "n_words", "n_tokens", "words", "lengths", "roles", "ids")}
        made |= {"n_pairs": pa.array([len(codes)], pa.int32()), "n_cells": pa.array([len(cells)], pa.int32())}
        made["types"] = pa.nulls(1, pa.list_(pa.int64()))
        stored = {"counted_words": words, "counted_pairs": pairs, "cells": cells, "times": times}
        made |= {name: pa.array([packed(values)], pa.binary()) for name, values in stored.items()}
        return pa.table({c: made[c] for c in [*_ANSWERED_COLUMNS, "ids"]})

    return of_chunk


_ANSWERED_COLUMNS = [part.split()[0] for part in _ANSWERED.split(", ")]


def _answered_chunk(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk, whose hashes have done their work, and its words' and pairs' counts."""
    roles = np.frombuffer(row["roles"], np.int8)
    own = Chunk(
        np.zeros(row["n_words"], np.uint64),
        unpacked(row["words"], row["n_tokens"], np.int32),
        unpacked(row["lengths"], len(roles), np.int32),
        roles,
    )
    words = unpacked(row["counted_words"], row["n_words"], np.int64)
    return own, words, unpacked(row["counted_pairs"], row["n_pairs"], np.int64)


def _estimates(
    own: Chunk, codes: np.ndarray, words: np.ndarray, pairs: np.ndarray, tokens: int, docs: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context, and the pair's and the word's estimate, per distinct pair."""
    n = len(own.vocabulary)
    seen = np.concatenate([words, [docs]])[codes // (n + 1)]
    bucket = np.minimum(np.ceil(np.log2(seen + 1)).astype(np.int64), _BUCKETS - 1)
    return bucket, pairs / np.maximum(seen, 1), words[codes % (n + 1)] / max(tokens, 1)


def _level(p: np.ndarray) -> np.ndarray:
    """0 for no probability, else 1 + steps below 1."""
    safe = np.where(p > 0, p, 1.0)
    return np.where(p > 0, 1 + np.round(-np.log2(safe) * _FINE), 0).astype(np.int64)


def _tally(
    own: Chunk, codes: np.ndarray, times: np.ndarray, words: np.ndarray, pairs: np.ndarray, tokens: int, docs: int
) -> tuple[np.ndarray, np.ndarray]:
    """Held-out pairs by context bucket and by level of both estimates, and how many."""
    cell = np.empty(len(codes), np.int64)
    for at in blocks(len(codes)):
        bucket, two, one = _estimates(own, codes[at], words, pairs[at], tokens, docs)
        cell[at] = (bucket << 32) | (_level(two) << 16) | _level(one)
    cells, place = distinct(cell)
    return cells, np.bincount(place, times, minlength=len(cells)).astype(np.int64)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in single_rows(batches):
        found = [unpacked(row[c], row["n_cells"], np.int64) for c in ("cells", "times")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["cell", "times"])


def learned_weights(cell: np.ndarray, times: np.ndarray, types: int) -> np.ndarray:
    """Weights of the pair, word and any-word estimate in each context bucket.

    Expectation-maximisation over the tallies until ``EM_ROUNDS``. A context
    never seen has no pair estimate. Buckets without held-out pairs take the
    weights of the nearest lower one.
    """
    bucket = cell >> 32
    value = lambda level: np.where(level > 0, 2.0 ** (-(level - 1) / _FINE), 0.0)
    estimates = np.stack(
        [value((cell >> 16) & 0xFFFF), value(cell & 0xFFFF), np.full(len(cell), 1 / (types + 1))], axis=1
    )
    weights = np.full((_BUCKETS, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    for k in range(_BUCKETS):
        mine = bucket == k
        if not mine.any():
            weights[k] = weights[k - 1] if k > 1 else weights[k]
            continue
        parts, count, own = estimates[mine], times[mine], weights[k]
        for _ in range(EM_ROUNDS):
            share = parts * own
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            own = (share * count[:, None]).sum(axis=0)
            own /= own.sum()
        own = own * (1 - FLOOR)
        own[2] += FLOOR
        weights[k] = own
    return weights


def _scores(corpus: Corpus, weights: np.ndarray):
    """Every document's sums over its tokens."""
    base_of = corpus.tokens[0] + 0.5 * (corpus.types[0] + 1)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(single_rows(iter([batch.drop_columns(["ids"])]))):
                own, words, pairs = _answered_chunk(row)
                codes, index = own.pairs()
                model = np.empty(len(codes))
                for at in blocks(len(codes)):
                    bucket, two, one = _estimates(own, codes[at], words, pairs[at], corpus.tokens[0], corpus.docs[0])
                    w = weights[bucket]
                    model[at] = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (corpus.types[0] + 1))
                del codes, pairs
                starts = np.cumsum(own.lengths) - own.lengths
                sums = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                base = np.log10((words + 0.5) / base_of)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[k].values,
                        pa.array(own.roles.astype(np.int32)),
                        pa.array(own.lengths.astype(np.int64)),
                        pa.array(sums((words > 0)[own.words].astype(np.int64))),
                        pa.array(sums(base[own.words])),
                        pa.array(sums(model[index])),
                    ],
                    names=["id", "role", "n_tokens", "n_known", "base_score", "score"],
                )

    return of_batches


def scored(docs: DataFrame, role: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, role, n_tokens, n_known, train_tokens, base_score, score)``, one row per row.

    ``role`` is 0 for documents that are only scored, 1 for those counted, and 2
    for those that the weights are learned on and then counted as well. Tokens
    are runs of anything but ASCII white space with A-Z lowered, and one end per
    document; a null text counts as empty. ``score`` is the model's log10
    probability of the text, ``base_score`` that of smoothed word counts alone.
    Repeated rows are documents of their own. Without training documents all
    estimates but the any-word one are 0.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    chunks = durable(encoded(docs, role, id_col, text_col), "chunks")
    width = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 << max(0, (width - 1).bit_length())
    requests = chunks.select(*_CHUNK_COLUMNS).mapInArrow(
        _requests(parts), "chunk long, part int, n int, keys binary, counted binary, kept binary"
    )
    replies = requests.groupBy("part").applyInArrow(_served(parts), _COUNTS)
    schema = f"{_ANSWERED}, ids array<{kind.simpleString()}>"

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            roles = np.frombuffer(row["roles"], np.int8)
            lengths = unpacked(row["lengths"], len(roles), np.int32)
            for k in (COUNTED, HELD):
                one = [[k], [int((roles == k).sum())], [int(lengths[roles == k].sum())]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in one], names=["role", "docs", "tokens"])

    found = chunks.select("roles", "lengths").mapInArrow(sizes, "role long, docs long, tokens long")
    found = {r["role"]: r for r in found.groupBy("role").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    of = lambda k, c: found[k][c] if k in found else 0
    both = lambda c: (of(COUNTED, c) + of(HELD, c), of(COUNTED, c))
    rows = _answered_rows(of(COUNTED, "tokens"), of(COUNTED, "docs"))
    answered = replies.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(rows, schema)
    answered = durable(answered, "answered")
    total = answered.where(F.col("chunk") == _STATS).select("types").first()
    types = total["types"] if total else [0, 0]
    answered = answered.where(F.col("chunk") != _STATS)
    corpus = Corpus(both("tokens"), (types[0], types[1]), both("docs"))
    tallies = answered.select("n_cells", "cells", "times").mapInArrow(_tallies, "cell long, times long")
    tallies = tallies.groupBy("cell").agg(F.sum("times").alias("times")).orderBy("cell").toArrow()
    weights = learned_weights(tallies.column("cell").to_numpy(), tallies.column("times").to_numpy(), corpus.types[1])
    from pyspark.sql.pandas.types import to_arrow_type

    result = answered.mapInArrow(
        _scores(corpus, weights),
        f"id {kind.simpleString()}, role int, n_tokens long, n_known long, base_score double, score double",
    )
    return result.withColumn("train_tokens", F.lit(corpus.tokens[0]).cast("long"))
