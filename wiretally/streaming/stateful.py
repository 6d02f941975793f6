"""Reversals and event runs on a stream.

Both compare a packet with the one before it, and ``lag`` is not defined on
streams. A segment's rows reach a task in order, so most comparisons settle
right there, next to the scan. Only the first and last packet of each run of
rows a task saw, one row per batch and key, go to a stateful operator that
links them in arrival order. A hot capture therefore never sends its packets
to one task, just its edges. Hits that are settled pass the operator in
``LANES`` groups a key, by segment: a group for every segment would cost more
than its rows.

Rows must come in order within a segment, as ``stream_captures`` delivers
them; after a shuffle, or from files that lost that order, pass
``in_order=False``. Then every packet is an edge: as exact, but a hot capture's
packets of one micro-batch, which ``files_per_trigger`` bounds, meet in one
task. A segment that lands after its successor was processed cannot be linked
any more: its first packet is emitted with ``out_of_order`` set, and the batch
operators remain the authority. Where segments land in any order, use
``streaming.corrections``, which keeps more state and takes back what changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wiretally.functions import event_code_key
from wiretally.operators.sequence import event_packets
from wiretally.session import ROCKSDB_PROVIDER, STATE_STORE

EDGE_LANE = -1
LANES = 64


class LinkEdges(StatefulProcessor):
    """Links runs of rows; keeps the last packet seen per key."""

    def __init__(self, starts_count: bool, drops_only: bool, ttl_ms: int | None) -> None:
        self.starts_count = starts_count
        self.drops_only = drops_only
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, value long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[-1] != EDGE_LANE:
            for settled in rows:
                yield settled.drop(columns=["lane", "tail_seq", "tail_value"]).assign(
                    has_prev=True, out_of_order=False
                )
            return
        edges = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        if (edges["seq"].iloc[1:].to_numpy() <= edges["tail_seq"].iloc[:-1].to_numpy()).any():
            raise ValueError("rows of a segment must arrive in order")
        stored = self.last.get()
        seen = -1 if stored is None else stored[0]
        late = edges["seq"] <= seen
        on_time = edges[~late]
        prev = on_time["tail_value"].astype("Int64").shift(1)
        if len(on_time):
            prev.iloc[0] = None if stored is None else stored[1]
            newest = on_time.iloc[-1]
            self.last.update((int(newest["tail_seq"]), int(newest["tail_value"])))
        linked = prev.notna()
        known = prev.fillna(0).astype("int64")
        differs = (on_time["value"] < known) if self.drops_only else (on_time["value"] != known)
        hit = (linked & differs) | (~linked & self.starts_count)
        out = pd.concat(
            [
                on_time.assign(prev=known, has_prev=linked.astype(bool), out_of_order=False)[
                    hit.astype(bool)
                ],
                edges[late].assign(prev=0, has_prev=False, out_of_order=True),
            ]
        )
        yield out.drop(columns=["lane", "tail_seq", "tail_value"])

    def close(self) -> None:
        pass


def lane_of(segment: pd.Series) -> np.ndarray:
    """The lane of each segment's settled hits."""
    mixed = pd.util.hash_array(segment.to_numpy(np.int64))
    return (mixed % np.uint64(LANES)).astype(np.int64)


def edge_runs(
    rows: DataFrame, keys: list[str], extra: list[str], drops_only: bool, in_order: bool
) -> tuple[DataFrame, str]:
    """Runs of rows as their first and last packet, and the hits settled within; with their schema."""
    if rows.sparkSession.conf.get(STATE_STORE, "") != ROCKSDB_PROVIDER:
        raise ValueError(f"set {STATE_STORE} to {ROCKSDB_PROVIDER}, as build_session does")
    columns = [*keys, "segment", "seq", "value", *extra]
    rows = rows.select(*columns)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shown = [*keys, "seq", "value", *extra]
    base = ", ".join(f"{c} {types[c]}" for c in shown)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            run = [*keys, "segment"]
            batch = batch.sort_values([*run, "seq"], ignore_index=True)
            same = (batch[run] == batch[run].shift(1)).all(axis=1) & in_order
            prev = batch["value"].shift(1, fill_value=0)
            differs = (batch["value"] < prev) if drops_only else (batch["value"] != prev)
            ends = ~same.shift(-1, fill_value=False)
            heads = batch[~same].assign(
                lane=EDGE_LANE,
                prev=0,
                tail_seq=batch.loc[ends, "seq"].to_numpy(),
                tail_value=batch.loc[ends, "value"].to_numpy(),
            )
            hit = same & differs
            settled = batch[hit].assign(
                lane=lane_of(batch.loc[hit, "segment"]), prev=prev[hit], tail_seq=0, tail_value=0
            )
            yield pd.concat([heads, settled]).drop(columns="segment")

    return rows.mapInPandas(
        settle, f"{base}, lane long, prev long, tail_seq long, tail_value long"
    ), base


def _link(
    rows: DataFrame,
    keys: list[str],
    extra: list[str],
    starts_count: bool,
    drops_only: bool,
    in_order: bool,
    ttl_ms: int | None,
) -> DataFrame:
    """Rows whose value differs from (or falls below) the one before, per key."""
    runs, base = edge_runs(rows, keys, extra, drops_only, in_order)
    return runs.groupBy(*keys, "lane").transformWithStateInPandas(
        LinkEdges(starts_count, drops_only, ttl_ms),
        f"{base}, prev long, has_prev boolean, out_of_order boolean",
        "Append",
        "None" if ttl_ms is None else "ProcessingTime",
    )


def reversal_rows(packets: DataFrame) -> DataFrame:
    """Frames as the values that reversals compare."""
    return packets.select(
        "capture_id", "packet_id", "segment", "seq", F.col("frame_id").alias("value")
    )


def event_rows(packets: DataFrame) -> DataFrame:
    """Event codes as the values that runs compare."""
    return event_packets(packets, "segment").withColumn("value", event_code_key(F.col("code")))


def stream_reversals(
    packets: DataFrame, in_order: bool = True, ttl_ms: int | None = None
) -> DataFrame:
    """The reversal packets of a stream, as ``operators.sequence.reversals``.

    ``ttl_ms`` drops the state of captures that went quiet for that long. Spark
    keeps such a query busy with expiry, so it suits a processing-time trigger
    and never ends under ``availableNow``.
    """
    keys = ["capture_id", "packet_id"]
    linked = _link(reversal_rows(packets), keys, [], False, True, in_order, ttl_ms)
    return linked.select(
        "capture_id",
        "packet_id",
        "seq",
        F.col("value").alias("frame_id"),
        F.when(F.col("has_prev"), F.col("prev")).alias("prev_frame_id"),
        "out_of_order",
    )


def stream_event_runs(
    packets: DataFrame, in_order: bool = True, ttl_ms: int | None = None
) -> DataFrame:
    """The run starts of a stream's event codes, as ``operators.sequence.event_runs``."""
    extra = ["code", "session_time"]
    linked = _link(event_rows(packets), ["capture_id"], extra, True, False, in_order, ttl_ms)
    return linked.select("capture_id", "seq", *extra, "out_of_order")
