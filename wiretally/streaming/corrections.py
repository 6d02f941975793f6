"""Reversals and event runs of a stream whose segments land in any order.

As in ``streaming.stateful``, tasks settle the packets they read next to each
other, and only the first and last packet of each run of rows reach the
operator with state. Here the state keeps those edges of all runs of a key in
blocks of the arrival order. A run that lands late is put between its
neighbours: it is compared with the run before it, and the run after it is
compared anew. The output is a log of changes, in which a later ``revision``
of a packet replaces an earlier one and ``holds`` tells whether it is still a
hit. ``latest_changes`` reads the log; whatever order the segments landed in,
its rows are those of ``operators.sequence``.

A micro-batch reads and writes the blocks its runs fall into and one on either
side, never the whole state. The state has one row of edges per run, some
10,000 packets or a segment, unless ``keep_records`` bounds it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wiretally.streaming.stateful import EDGE_LANE, edge_runs, event_rows, reversal_rows

BLOCK_BITS = 16
_FACTS = "revision long, newest long, floor long, floor_value long, blocks array<long>"
_EDGE = ["seq", "value", "tail_seq", "tail_value"]
_ADDED = "prev long, has_prev boolean, out_of_order boolean, holds boolean, revision long"


class RelinkEdges(StatefulProcessor):
    """Links runs of rows, and links them anew when one lands between them.

    ``runs`` has the edges of the runs that begin in a block, in order.
    ``blocks`` lists the blocks that have any; ``floor`` is the last packet of
    the runs that were forgotten, or -1.
    """

    def __init__(
        self,
        keys: list[str],
        extra: dict[str, str],
        starts_count: bool,
        drops_only: bool,
        keep_records: int | None,
        block_bits: int = BLOCK_BITS,
    ) -> None:
        self.keys = keys
        self.extra = extra
        self.starts_count = starts_count
        self.drops_only = drops_only
        self.keep_records = keep_records
        self.block = 1 << block_bits
        self.fields = [*_EDGE, *extra]
        self.shown = [*keys, "seq", "value", *extra]
        self.shown += ["prev", "has_prev", "out_of_order", "holds", "revision"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        arrays = {c: "bigint" for c in _EDGE} | self.extra
        runs = ", ".join(f"{c} array<{t}>" for c, t in arrays.items())
        self.facts = handle.getValueState("facts", _FACTS)
        self.runs = handle.getMapState("runs", "block long", runs)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[-1] != EDGE_LANE:
            for settled in rows:
                settled = settled.assign(has_prev=True, out_of_order=False, holds=True, revision=0)
                yield settled[self.shown]
            return
        edges = pd.concat(list(rows))
        revision, newest, floor, floor_value, blocks = self.facts.get() or (0, -1, -1, 0, [])
        revision, blocks = revision + 1, list(blocks)
        forgotten = edges["seq"] <= floor
        fresh = edges.loc[~forgotten, self.fields]
        if len(fresh):
            touched = sorted({int(b) for b in fresh["seq"] // self.block})
            near = self._near(fresh, touched, blocks)
            near["prev"] = self._before(near, floor, floor_value)
            # What a stored run was compared with so far; the runs around a fresh one are all here.
            near["was"] = self._before(near[near["stored"]], floor, floor_value)
            yield self._changes(near, key, revision)
            for block, runs in near.groupby(near["seq"] // self.block):
                if block in touched:
                    self.runs.updateValue((int(block),), tuple(runs[f].tolist() for f in self.fields))
            blocks = sorted({*blocks, *touched})
            newest = max(newest, int(fresh["tail_seq"].max()))
            if self.keep_records is not None:
                floor, floor_value, blocks = self._forget(newest, floor, floor_value, blocks)
        self.facts.update((revision, newest, floor, floor_value, blocks))
        if forgotten.any():
            lost = edges[forgotten].assign(
                prev=0, has_prev=False, out_of_order=True, holds=True, revision=revision
            )
            yield lost[self.shown]

    def close(self) -> None:
        pass

    def _near(self, fresh: pd.DataFrame, touched: list[int], blocks: list[int]) -> pd.DataFrame:
        """The fresh runs and the stored ones around them, in order."""
        wanted = set()
        for b in touched:
            first = max(bisect_left(blocks, b) - 1, 0)
            wanted.update(blocks[first : bisect_right(blocks, b) + 1])
        stored = [
            pd.DataFrame({f: list(v) for f, v in zip(self.fields, self.runs.getValue((b,)))})
            for b in sorted(wanted)
        ]
        parts = [*(s.assign(stored=True) for s in stored), fresh.assign(stored=False)]
        near = pd.concat(parts).sort_values("seq", ignore_index=True)
        if (near["seq"].iloc[1:].to_numpy() <= near["tail_seq"].iloc[:-1].to_numpy()).any():
            raise ValueError("rows of a segment must arrive in order, and once")
        return near

    @staticmethod
    def _before(runs: pd.DataFrame, floor: int, floor_value: int) -> pd.Series:
        prev = runs["tail_value"].astype("Int64").shift(1)
        if len(runs) and floor >= 0:
            prev.iloc[0] = floor_value
        return prev

    def _hits(self, value: pd.Series, prev: pd.Series) -> pd.Series:
        known, linked = prev.fillna(0).astype("int64"), prev.notna()
        differs = (value < known) if self.drops_only else (value != known)
        return ((linked & differs) | (~linked & self.starts_count)).astype(bool)

    def _changes(self, near: pd.DataFrame, key: tuple, revision: int) -> pd.DataFrame:
        now = self._hits(near["value"], near["prev"])
        before = self._hits(near["value"], near["was"]) & near["stored"]
        as_before = near["prev"].eq(near["was"]).fillna(False).astype(bool)
        as_before |= near["prev"].isna() & near["was"].isna()
        changed = (now & ~(before & as_before)) | (before & ~now)
        out = near[changed]
        return out.assign(
            **dict(zip(self.keys, key)),
            prev=out["prev"].fillna(0).astype("int64"),
            has_prev=out["prev"].notna().astype(bool),
            out_of_order=False,
            holds=now[changed],
            revision=revision,
        )[self.shown]

    def _forget(
        self, newest: int, floor: int, floor_value: int, blocks: list[int]
    ) -> tuple[int, int, list[int]]:
        """Drops the blocks that ended ``keep_records`` before the newest record."""
        last = (newest - self.keep_records) // self.block
        old = blocks[: bisect_left(blocks, last)]
        if old:
            runs = dict(zip(self.fields, self.runs.getValue((old[-1],))))
            floor, floor_value = runs["tail_seq"][-1], runs["tail_value"][-1]
            for block in old:
                self.runs.removeKey((block,))
        return floor, floor_value, blocks[len(old) :]


def _relinked(
    rows: DataFrame,
    keys: list[str],
    extra: list[str],
    starts_count: bool,
    drops_only: bool,
    in_order: bool,
    keep_records: int | None,
    block_bits: int,
) -> DataFrame:
    runs, base = edge_runs(rows, keys, extra, drops_only, in_order)
    types = {c: runs.schema[c].dataType.simpleString() for c in extra}
    return runs.groupBy(*keys, "lane").transformWithStateInPandas(
        RelinkEdges(keys, types, starts_count, drops_only, keep_records, block_bits),
        f"{base}, {_ADDED}",
        "Append",
        "None",
    )


def stream_reversal_changes(
    packets: DataFrame,
    in_order: bool = True,
    keep_records: int | None = None,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Changes to the reversals of a stream, for ``latest_changes``.

    Without ``keep_records`` a segment may land at any time. With it, runs that
    lie more than that many records behind the newest (rounded up to a block)
    are forgotten but for the last packet among them; a segment that belongs
    between them is flagged ``out_of_order``, as in ``stream_reversals``.
    """
    keys = ["capture_id", "packet_id"]
    linked = _relinked(reversal_rows(packets), keys, [], False, True, in_order, keep_records, block_bits)
    return linked.select(
        *keys,
        "seq",
        F.col("value").alias("frame_id"),
        F.when(F.col("has_prev"), F.col("prev")).alias("prev_frame_id"),
        "out_of_order",
        "holds",
        "revision",
    )


def stream_event_run_changes(
    packets: DataFrame,
    in_order: bool = True,
    keep_records: int | None = None,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Changes to the run starts of a stream's event codes; as ``stream_reversal_changes``."""
    extra = ["code", "session_time"]
    linked = _relinked(
        event_rows(packets), ["capture_id"], extra, True, False, in_order, keep_records, block_bits
    )
    return linked.select("capture_id", "seq", *extra, "out_of_order", "holds", "revision")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The packets that are hits by their newest revision.

    Only packets at the edge of a run have more than one revision, so the rows
    to group are hardly more than the rows that remain.
    """
    keys = [c for c in ("capture_id", "packet_id", "seq") if c in changes.columns]
    values = [c for c in changes.columns if c not in (*keys, "revision")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "revision").alias("newest"))
    shown = [f"newest.{c}" if c in values else c for c in changes.columns if c not in ("holds", "revision")]
    return newest.where("newest.holds").select(*shown)
