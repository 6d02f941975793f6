"""Language identification by cross-parsing against suffix automata.

Each language has a suffix automaton of labelled sample text. A document is
parsed into the longest phrases that occur in the sample; a text in the
sample's language needs few of them. Phrases times the bits that point to one
is an estimate of the cross entropy, and the language with the least wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wiretally.llm.tokens import buffers, slices, utf8

#: Sample excerpts per language and characters in each, and characters of all languages.
EXCERPTS = 150
EXCERPT_CHARS = 200
TOTAL_CHARS = 200_000
#: Characters that an excerpt has at least, however many languages there are.
LEAST_CHARS = 20
#: Parts of a language's texts, among which the excerpts are picked first.
PARTS = 64
UNKNOWN = "und"

#: A text is parsed in stretches of so many symbols, side by side as far as that goes.
_STRETCH = 256
_SLICE = 1 << 20

# Bytes of lowered UTF-8: letters and bytes of other characters stand for
# themselves, anything else separates words.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x80:] = np.arange(27, 27 + 128)
_SYMBOLS = 27 + 128


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a slice with runs of separators as one, and where each row's begin."""
    symbol = _SYMBOL[data]
    kept = symbol > 0
    kept[1:] |= symbol[:-1] > 0
    place = np.concatenate([[0], np.cumsum(kept)])
    return symbol[kept], place[offsets]


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in text.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in step[state]:
            step[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = step[state][symbol]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                copy = len(step)
                step.append(dict(step[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state >= 0 and step[state].get(symbol) == target:
                    step[state][symbol] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return step


class Parser(NamedTuple):
    """All automata in one table of next states, -1 for none."""

    langs: tuple[str, ...]
    column: np.ndarray
    width: int
    table: np.ndarray
    root: np.ndarray
    bits: np.ndarray

    def phrases(self, symbol: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each row in each language, rows by languages.

        The result is that of one parse from a row's first symbol to its last.
        A parse is fixed by the state it starts in, so all stretches are parsed
        from the root at first, then from where the one before ended. Parses
        soon fall into step; only stretches whose start still changes after
        that are parsed once more, in order.
        """
        n_rows = len(bounds) - 1
        count = np.diff(bounds)
        stretches = -(-count // _STRETCH)
        row = np.repeat(np.arange(n_rows), stretches)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        start = bounds[:-1][row] + nth * _STRETCH
        length = np.minimum(count[row] - nth * _STRETCH, _STRETCH)
        column = self.column[symbol]
        begun = np.repeat(self.root[:, None], len(row), axis=1)
        found, ended = self._parsed(column, start, length, begun)

        def again(own: np.ndarray) -> None:
            after = ended[:, own - 1]
            own, after = (x[..., (after != begun[:, own]).any(axis=0)] for x in (own, after))
            if len(own):
                begun[:, own] = after
                found[:, own], ended[:, own] = self._parsed(column, start[own], length[own], after)

        again(np.flatnonzero(nth > 0))
        left = np.flatnonzero(nth > 0)
        left = left[(ended[:, left - 1] != begun[:, left]).any(axis=0)]
        # From a row's first open stretch on, each may open the next.
        open_from = np.full(n_rows, np.iinfo(np.int64).max)
        np.minimum.at(open_from, row[left], nth[left])
        todo = np.flatnonzero(nth >= open_from[row])
        for own in np.split(todo[np.argsort(nth[todo], kind="stable")], np.flatnonzero(np.diff(np.sort(nth[todo]))) + 1):
            again(own)
        last = np.flatnonzero(np.diff(np.append(row, n_rows)))
        found[:, last] += ended[:, last] != self.root[:, None]
        return np.stack([np.bincount(row, f, minlength=n_rows) for f in found], axis=1)

    def _parsed(
        self, column: np.ndarray, start: np.ndarray, length: np.ndarray, begun: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end within each stretch, and the state at its end, languages by stretches."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        active = len(start) - np.searchsorted(length[::-1], np.arange(1, _STRETCH + 1), side="left")
        state = begun[:, order]
        found = np.zeros(state.shape, np.int32)
        root = (self.root * self.width)[:, None]
        for t in range(_STRETCH):
            m = active[t]
            if not m:
                break
            now = column[start[:m] + t]
            after = self.table[state[:, :m] * self.width + now]
            miss = after < 0
            if miss.any():
                # A phrase ends and the next begins here; a symbol that the sample
                # lacks is a phrase of its own, unless the text had just begun.
                ended = miss & (state[:, :m] != self.root[:, None])
                fresh = self.table[root + now]
                lost = miss & (fresh < 0)
                found[:, :m] += ended
                found[:, :m] += lost
                after = np.where(miss, np.where(lost, self.root[:, None], fresh), after)
            state[:, :m] = after
        back = np.argsort(order)
        return found[:, back], state[:, back]


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    """Automata of ``(language, lowered text)``, kept for the life of a Python worker."""
    texts = []
    for _, text in samples:
        data = np.frombuffer(text, np.uint8)
        texts.append(symbols(data, np.array([0, len(data)]))[0])
    used = np.unique(np.concatenate([*texts, np.zeros(1, np.uint8)]))
    column = np.full(_SYMBOLS, len(used), np.int64)
    column[used] = np.arange(len(used))
    width = len(used) + 1
    tables, roots, total = [], [], 0
    for text in texts:
        steps = suffix_automaton(column[text])
        table = np.full((len(steps), width), -1, np.int32)
        for state, step in enumerate(steps):
            for symbol, target in step.items():
                table[state, symbol] = target + total
        tables.append(table)
        roots.append(total)
        total += len(steps)
    table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
    bits = np.log2(np.maximum([len(t) for t in texts], 2)) if texts else np.zeros(0)
    return Parser(tuple(k for k, _ in samples), column, width, table, np.array(roots, np.int64), bits)


def learned_samples(
    docs: DataFrame, known: Column, lang_col: str = "lang", text_col: str = "text"
) -> tuple[tuple[str, bytes], ...]:
    """Sample text per language, from the rows where ``known`` holds and the language is not null.

    At most ``EXCERPTS`` stretches of ``EXCERPT_CHARS`` characters per language,
    from texts and places that a hash of the text picks; copies count once. If
    all languages together would pass ``TOTAL_CHARS``, each has fewer stretches
    and, beyond 1000 languages, shorter ones, of 20 characters at least. Every
    language is learned. Only the picked hashes go to all tasks and only the
    stretches come to the driver.
    """
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.where(known & F.col(lang_col).isNotNull() & lettered)
    rows = rows.select(
        F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("pick"), F.lower(text_col).alias("text")
    )
    langs = rows.select("lang").distinct().count()
    each = min(EXCERPTS, max(1, TOTAL_CHARS // EXCERPT_CHARS // max(1, langs)))
    chars = min(EXCERPT_CHARS, max(LEAST_CHARS, TOTAL_CHARS // max(1, langs)))
    # The first of every part, then the first of those: no task sees a whole language.
    part = F.pmod(F.shiftright("pick", 8), F.lit(PARTS)).alias("part")
    picked = rows.select("lang", "pick", part).distinct()
    for group in (["lang", "part"], ["lang"]):
        nth = F.row_number().over(W.partitionBy(*group).orderBy("pick"))
        picked = picked.withColumn("nth", nth).where(F.col("nth") <= each)
    picked = picked.drop("part")
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    stretch = F.substring("text", (F.pmod("pick", room) + 1).cast("int"), F.lit(chars))
    chosen = rows.join(F.broadcast(picked), ["lang", "pick"])
    chosen = chosen.groupBy("lang", "nth").agg(F.min(stretch).alias("text")).orderBy("lang", "nth")
    found: dict[str, list[str]] = {}
    for r in chosen.toArrow().to_pylist():
        found.setdefault(r["lang"], []).append(r["text"])
    return tuple((lang, " ".join(found[lang]).encode()) for lang in sorted(found))


def identified(
    docs: DataFrame,
    samples: tuple[tuple[str, bytes], ...],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, lang_pred, score)`` of every row, from its whole text and nothing else.

    ``score`` is the runner-up's cross entropy over that of both, 0.5 for a tie
    (which the first language takes) to 1. A null text, one without letters, and
    any text if no language was learned are ``und`` with score 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.when(lettered, F.lower(text)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(shared.value)
        for batch in batches:
            blank = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            data, offsets = buffers(utf8(batch.column("text")))
            lang = np.full(batch.num_rows, UNKNOWN, object)
            score = np.zeros(batch.num_rows)
            for lo, hi in slices(offsets, _SLICE) if own.langs else ():
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                cost = own.phrases(*symbols(part, at)) * own.bits
                best = cost.argmin(axis=1)
                lang[lo:hi] = np.array(own.langs, object)[best]
                ordered = np.sort(cost, axis=1)
                first, second = ordered[:, 0], ordered[:, min(1, ordered.shape[1] - 1)]
                both = np.maximum(first + second, 1e-9)
                score[lo:hi] = second / both if len(own.langs) > 1 else 1.0
            lang[blank], score[blank] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lang, pa.string()), pa.array(score)],
                names=["id", "lang_pred", "score"],
            )

    return rows.mapInArrow(of_batches, f"id {kind}, lang_pred string, score double")
