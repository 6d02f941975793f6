"""The interval report on a stream: totals, rates, silent types and silent intervals.

Tasks first reduce all datagrams they read to a few rows per window, so a hot
capture sends its counts and never its packets. A stateful operator keeps, per
capture, the running totals of every window and type. Whatever changes a
window, new data or late data, it reports that window and all later ones once
more, with the next ``revision``; ``latest_reports`` keeps the newest row of
each. After the last batch these are the rows of
``plans.interval_report.interval_report``, however the segments were landed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wiretally.functions import header_field, is_datagram, is_valid, megabytes, rate, size_text
from wiretally.operators.names import with_packet_name
from wiretally.operators.rates import window_start, with_window
from wiretally.session import ROCKSDB_PROVIDER, STATE_STORE

# Stands for the capture as a whole beside its types.
WHOLE_CAPTURE = -1
# What a task found: packets and bytes of a window, a size, a session or the first packet.
COUNT, SIZE, SESSION, FIRST = range(4)

_PART = "kind int, window_index long, packet_id int, size int, session string, n long, bytes long, seq long, started long"
_ROW = (
    "revision long, window_index long, is_partial boolean, uptime double, bytes_total long, "
    "sessions long, packet_id int, total long, n long, seen_sizes array<int>"
)
_FACTS = "revision long, first_seq long, started long, floor long, hi long, heard long"
_NONE = 1 << 62
# So many rows of parts are held before they are collapsed.
HELD_ROWS = 1 << 17


class IntervalReports(StatefulProcessor):
    """Running totals per window and type of one capture.

    ``cells`` has packets and total of every window and type since the type was
    first seen, ``whole`` the bytes and sessions so far; both are dense, so a
    change is carried on from its window without looking at those before.
    ``sizes`` and ``sessions`` have the first window of each.
    """

    def __init__(self, width: int, keep_windows: int | None, idle_windows: int | None) -> None:
        self.width = width
        self.keep_windows = keep_windows
        self.idle_windows = idle_windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", _FACTS)
        self.cells = handle.getMapState("cells", "window_index long, packet_id int", "n long, total long")
        self.whole = handle.getMapState("whole", "window_index long", "bytes long, sessions long")
        self.sizes = handle.getMapState("sizes", "packet_id int, size int", "first long")
        self.sessions = handle.getMapState("sessions", "session string", "first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.facts.get() or (0, _NONE, 0, _NONE, -_NONE, -_NONE)
        revision, first_seq, started, floor, hi, heard = held
        packets, received, sessions = defaultdict(int), defaultdict(int), defaultdict(int)
        changed, newest = _NONE, max(hi, heard)
        # The frames of a capture are never held together, and a size or session is looked up once.
        for p in (p for part in _collapsing(f.assign(capture_id=0) for f in rows) for p in part.itertuples(index=False)):
            w = p.window_index
            changed = min(changed, w)
            if p.kind == COUNT:
                packets[w, p.packet_id] += p.n
                received[w] += p.bytes
                newest, heard = max(newest, w), max(heard, w)
            elif p.kind == SIZE:
                self._lower(self.sizes, (p.packet_id, p.size), w)
            elif p.kind == SESSION:
                before, now = self._lower(self.sessions, (p.session,), w)
                if now != before:
                    sessions[now] += 1
                    if before is not None:
                        sessions[before] -= 1
            elif p.seq < first_seq:
                # All windows count their uptime from the first packet.
                first_seq, started, changed = p.seq, p.started, -_NONE
        if hi != -_NONE and newest > hi:
            changed = min(changed, hi)  # the last window is partial no more
        yield from self._carried(
            key, packets, received, sessions, changed, hi, newest, revision + 1, first_seq, started, floor, heard
        )
        if self.idle_windows is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.width // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Reports the windows that went by in silence, up to the last that has ended."""
        revision, first_seq, started, floor, hi, heard = self.facts.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        newest = now * 1000 // self.width - 1
        newest = min(newest, heard + self.idle_windows)
        if newest > hi:
            yield from self._carried(
                key, {}, {}, {}, hi, hi, newest, revision + 1, first_seq, started, floor, heard
            )
        if newest < heard + self.idle_windows:
            self.handle.registerTimer(now + self.width // 1000)

    def close(self) -> None:
        pass

    @staticmethod
    def _lower(state, key: tuple, window: int) -> tuple[int | None, int]:
        """The first window before and now."""
        held = state.getValue(key)
        before = None if held is None else held[0]
        if before is None or window < before:
            state.updateValue(key, (window,))
            return before, window
        return before, before

    def _carried(
        self, key, packets, received, sessions, changed, hi, newest, revision, first_seq, started, floor, heard
    ) -> Iterator[pd.DataFrame]:
        """Adds what is new to all windows from the changed one to the newest, and reports those."""
        seen = defaultdict(list)
        for (packet_id, size), (first,) in self.sizes.iterator():
            seen[packet_id].append((first, size))
        lows = {p: min(s)[0] for p, s in seen.items()}
        lowest = min([floor, *received, *sessions, *lows.values()])
        kept_from, oldest = (-_NONE if self.keep_windows is None else w - self.keep_windows for w in (hi, newest))
        start = max(changed, lowest, kept_from)
        # What is older than all windows that are kept counts in totals alone.
        bytes_run = sum(b for w, b in received.items() if w < start)
        sessions_run = sum(s for w, s in sessions.items() if w < start)
        last = (self.whole.getValue((hi,)) if hi != -_NONE else None) or (0, 0)
        totals = []
        for w in range(start, newest + 1):
            bytes_run += received.get(w, 0)
            sessions_run += sessions.get(w, 0)
            old = last if w > hi else self.whole.getValue((w,)) or (0, 0)
            totals.append((old[0] + bytes_run, old[1] + sessions_run))
            self.whole.updateValue((w,), totals[-1])
        out = []
        for packet_id in sorted(seen):
            sizes = sorted(seen[packet_id])
            run = sum(n for (w, p), n in packets.items() if p == packet_id and w < start)
            last = (self.cells.getValue((hi, packet_id)) if hi != -_NONE else None) or (0, 0)
            for w in range(max(start, lows[packet_id]), newest + 1):
                n = packets.get((w, packet_id), 0)
                run += n
                old = (0, last[1]) if w > hi else self.cells.getValue((w, packet_id)) or (0, 0)
                cell = (old[0] + n, old[1] + run)
                self.cells.updateValue((w, packet_id), cell)
                uptime = ((w + 1) * self.width - started) / 1e6
                out.append(
                    (revision, w, w == newest, uptime, *totals[w - start], packet_id, cell[1], cell[0],
                     sorted(s for first, s in sizes if first <= w))
                )
        for w in range(max(lowest, kept_from), oldest):
            self.whole.removeKey((w,))
            for packet_id in seen:
                self.cells.removeKey((w, packet_id))
        self.facts.update((revision, first_seq, started, max(lowest, oldest), newest, heard))
        if out:
            found = pd.DataFrame(out, columns=[c.split()[0] for c in _ROW.split(", ")])
            found.insert(0, "capture_id", key[0])
            yield found


def _collapsed(parts: pd.DataFrame) -> pd.DataFrame:
    """``parts`` with what several say of the same capture and window, size or session in one row."""
    by_kind = {k: parts[parts["kind"] == k] for k in (COUNT, SIZE, SESSION, FIRST)}
    groups = {COUNT: ["window_index", "packet_id"], SIZE: ["packet_id", "size"], SESSION: ["session"]}
    found = []
    for kind, keys in groups.items():
        grouped = by_kind[kind].groupby(["capture_id", *keys], as_index=False, sort=False)
        rows = grouped[["n", "bytes"]].sum() if kind == COUNT else grouped[["window_index"]].min()
        found.append(rows.assign(kind=kind))
    first = by_kind[FIRST].reset_index(drop=True)
    found.append(first.loc[first.groupby("capture_id")["seq"].idxmin()])
    out = pd.concat([f for f in found if len(f)]).reindex(columns=parts.columns)
    numbers = [c for c in out.columns if c not in ("capture_id", "session")]
    out[numbers] = out[numbers].fillna(0).astype("int64")
    return out.reset_index(drop=True)


def _collapsing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The collapsed rows of all frames, held together only until they are ``HELD_ROWS``."""
    held, n, floor = [], 0, 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n > floor + HELD_ROWS:
            held = [_collapsed(pd.concat(held, ignore_index=True))]
            n = floor = len(held[0])
            if n > HELD_ROWS:  # distinct, so that holding them on saves little
                yield held[0]
                held, n, floor = [], 0, 0
    if n:
        yield _collapsed(pd.concat(held, ignore_index=True))


def _parts(rows: DataFrame, capture_id: str) -> DataFrame:
    """What the rows of a task add, a few rows per capture and window."""
    names = ["capture_id", *[c.split()[0] for c in _PART.split(", ")]]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            valid = batch[batch["packet_id"] != WHOLE_CAPTURE]
            by_window = batch.groupby(["capture_id", "window_index", "packet_id"], as_index=False)
            counts = by_window.agg(n=("seq", "size"), bytes=("size", "sum")).assign(kind=COUNT)
            found = [counts]
            for kind, keys in ((SIZE, ["packet_id", "size"]), (SESSION, ["session"])):
                firsts = valid.groupby(["capture_id", *keys], as_index=False)["window_index"].min()
                found.append(firsts.assign(kind=kind))
            first = valid.loc[valid.groupby("capture_id")["seq"].idxmin()]
            found.append(first[["capture_id", "window_index", "seq", "started"]].assign(kind=FIRST))
            out = pd.concat(found).reindex(columns=names)
            numbers = [c for c in names[1:] if c != "session"]
            out[numbers] = out[numbers].fillna(0).astype("int64")
            yield out

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _collapsing(reduce(batches))

    return rows.mapInPandas(of_task, f"capture_id {capture_id}, {_PART}")


def stream_interval_report(
    datagrams: DataFrame,
    seconds: float = 2.0,
    keep_windows: int | None = None,
    idle_windows: int | None = None,
) -> DataFrame:
    """``interval_report`` of a stream of raw datagrams with ``recv_ts``, in revisions.

    ``datagrams`` has ``capture_id, seq, recv_ts, size, payload``, runts
    included; those without ``recv_ts`` are left out. Each micro-batch reports
    the windows it changed and all later ones of the capture, so that a segment
    that lands late corrects what was reported. Types and intervals without
    packets are reported with a rate of 0.

    State grows by a row per window and type. With ``keep_windows`` only so many
    windows before the newest are kept: what lands later than that still counts
    in all later totals, but its own window's rate is not corrected any more.
    With ``idle_windows`` a processing-time timer also reports windows in which
    nothing at all arrives, until a capture has been silent for so many; such a
    query never ends by itself.
    """
    if datagrams.sparkSession.conf.get(STATE_STORE, "") != ROCKSDB_PROVIDER:
        raise ValueError(f"set {STATE_STORE} to {ROCKSDB_PROVIDER}, as build_session does")
    size = F.col("size")
    valid = is_valid(size)
    rows = with_window(datagrams.where(is_datagram(size) & F.col("recv_ts").isNotNull()), seconds).select(
        "capture_id",
        "window_index",
        "seq",
        size,
        F.when(valid, header_field(F.col("payload"), "packet_id")).otherwise(WHOLE_CAPTURE).alias("packet_id"),
        F.when(valid, header_field(F.col("payload"), "session_uid").cast("string")).alias("session"),
        F.unix_micros("recv_ts").alias("started"),
    )
    kind = datagrams.schema["capture_id"].dataType.simpleString()
    found = (
        _parts(rows, kind)
        .groupBy("capture_id")
        .transformWithStateInPandas(
            IntervalReports(round(seconds * 1_000_000), keep_windows, idle_windows),
            f"capture_id {kind}, {_ROW}",
            "Append",
            "None" if idle_windows is None else "ProcessingTime",
        )
    )
    report = found.select(
        "capture_id",
        "window_index",
        window_start(seconds).alias("window_start"),
        "is_partial",
        "uptime",
        megabytes(F.col("bytes_total")).alias("megabytes"),
        "sessions",
        "packet_id",
        "total",
        rate(F.col("n"), F.lit(float(seconds))).alias("hz"),
        size_text(F.col("seen_sizes")).alias("sizes"),
        "revision",
    )
    return with_packet_name(report)


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest revision of each capture, window and type, without its number."""
    keys = ["capture_id", "window_index", "packet_id"]
    values = [c for c in reports.columns if c not in (*keys, "revision")]
    newest = reports.groupBy(*keys).agg(F.max_by(F.struct(*values), "revision").alias("newest"))
    return newest.select(*[f"newest.{c}" if c in values else c for c in reports.columns if c != "revision"])
