"""

Queries run over packets made from the whole ``events`` table (see
``wiretally.fixtures``). The SQL is written from the definitions of the
results, not from the Spark plans: plain window functions and joins, no chunks.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wiretally.fixtures import (  # noqa: E402
    DATAGRAMS_SQL,
    capture_manifest,
    encode,
    events_as_datagrams,
    events_as_packets,
)
from wiretally.functions import header_field, is_valid, packet_size, size_text  # noqa: E402
from wiretally.layout import HEADER_FIELDS, PACKET_NAMES  # noqa: E402
from wiretally.operators import names, rates, sequence, stats  # noqa: E402
from wiretally.operators.headers import decode_headers  # noqa: E402
from wiretally.operators.ordering import CHUNK_BITS  # noqa: E402
from wiretally.plans.capture_summary import capture_summary, in_report_order  # noqa: E402
from wiretally.plans.interval_report import interval_report  # noqa: E402
from wiretally.plans.type_summary import flashbacks, type_summary  # noqa: E402
from wiretally.session import scratch_dir, use_rocksdb, use_utc  # noqa: E402
from wiretally.sources.anchors import with_recv_ts  # noqa: E402
from wiretally.sources.archive import read_archive, stream_archive, write_archive  # noqa: E402
from wiretally.sources.captures import (  # noqa: E402
    capture_files,
    frame_damage,
    open_files,
    read_captures,
    read_packets,
)
from wiretally.sources.export import SEGMENT_BITS, write_captures  # noqa: E402
from wiretally.sources.files import resolve  # noqa: E402
from wiretally.sources.growing import stream_growing_captures  # noqa: E402
from wiretally.sources.packets import read_packets_table, write_packets  # noqa: E402
from wiretally.sources.splits import read_split_captures  # noqa: E402
from wiretally.streaming.aggregates import (  # noqa: E402
    stream_packet_rates,
    stream_sessions,
    stream_type_stats,
)
from wiretally.streaming.ingest import stream_captures  # noqa: E402
from wiretally.streaming.corrections import (  # noqa: E402
    latest_changes,
    stream_event_run_changes,
    stream_reversal_changes,
)
from wiretally.streaming.reports import latest_reports, stream_interval_report  # noqa: E402
from wiretally.streaming.results import run_appending, run_complete  # noqa: E402
from wiretally.streaming.stateful import stream_event_runs, stream_reversals  # noqa: E402

# The fixture spans 30 days, so windows are long.
WINDOW_SECONDS = 6 * 3600
WINDOW_US = WINDOW_SECONDS * 1_000_000

# Small settings for the queries that cross many boundaries.
FEW_BITS = 10
FEW_WINDOWS_BITS = 3
RANGE_BYTES = 20_000
FILES_AT_ONCE = 16
# A batch costs the same however little it reads, so a long landing takes more files at once.
MOST_BATCHES = 16

RAW_COLUMNS = ["capture_id", "seq", "recv_mono", "payload"]
DECODED = ["capture_id", "seq", "recv_mono", "size", *HEADER_FIELDS, "event_code"]


def entry(spark: SparkSession) -> DataFrame:
    """Which packet types each capture holds, how many, and at which sizes."""
    return queries()["packet_type_stats"](spark, "/root/testdata/sf0.001")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(events_as_datagrams(spark, sf_dir)).select(*RAW_COLUMNS)


def _exported(
    spark: SparkSession, sf_dir: str, label: str, segment_bits: int = SEGMENT_BITS
) -> str:
    path = f"{scratch_dir(spark, label)}/log"
    write_captures(_raw(spark, sf_dir), path, segment_bits)
    return path


def _capture_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs whose files have lost up to 60 bytes at their end, by segment."""
    files = open_files(spark.read, _exported(spark, sf_dir, "damage", FEW_BITS), "int")
    lost = F.pmod(F.shiftright("segment", FEW_BITS) * 7 + F.col("capture_id"), F.lit(61))
    cut = files.withColumn("content", F.substring("content", F.lit(1), (F.col("length") - lost).cast("int")))
    return frame_damage(cut)


def _capture_split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = capture_files(spark, _exported(spark, sf_dir, "ranges"), "int")
    return _payload_facts(read_split_captures(files, RANGE_BYTES))


def _files_at_once(spark: SparkSession, landing: str) -> int:
    """Files of a micro-batch, so that all files land in at most ``MOST_BATCHES``."""
    return max(FILES_AT_ONCE, -(-capture_files(spark, landing, "int").count() // MOST_BATCHES))


def _few_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _exported(spark, sf_dir, "landing", FEW_BITS)
    files = _files_at_once(spark, landing)
    return stream_captures(spark, landing, "int", files, headers_only=True)


def _wire_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Datagrams and packets of logs that were exported, framed, decoded and stored."""
    root = scratch_dir(spark, "wire")
    logs = _exported(spark, sf_dir, "wire-log")
    write_archive(read_captures(spark, logs, "int"), f"{root}/archive")
    write_packets(read_packets(spark, logs, "int"), f"{root}/packets")
    return read_archive(spark, f"{root}/archive"), read_packets_table(spark, f"{root}/packets")


def _wire_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_report_order(type_summary(_wire_tables(spark, sf_dir)[1]))


def _wire_capture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    received, packets = _wire_tables(spark, sf_dir)
    return in_report_order(capture_summary(capture_manifest(spark, sf_dir), received, packets))


def _wire_interval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = capture_manifest(spark, sf_dir)
    received, packets = (with_recv_ts(t, manifest) for t in _wire_tables(spark, sf_dir))
    return _shown_windows(interval_report(received, packets, WINDOW_SECONDS))


def _interval_report_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    received, packets = events_as_datagrams(spark, sf_dir), events_as_packets(spark, sf_dir)
    return interval_report(received, packets, WINDOW_SECONDS, relative=True)


def _interval_report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    received, packets = events_as_datagrams(spark, sf_dir), events_as_packets(spark, sf_dir)
    return _shown_windows(interval_report(received, packets, WINDOW_SECONDS, FEW_WINDOWS_BITS))


def _running_totals_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    received, packets = events_as_datagrams(spark, sf_dir), events_as_packets(spark, sf_dir)
    return rates.running_capture_totals(_windowed(received), _windowed(packets), FEW_WINDOWS_BITS)


def _packet_rates_dense_blocks(packets: DataFrame) -> DataFrame:
    found = rates.dense_rates(_windowed(packets), WINDOW_SECONDS, FEW_WINDOWS_BITS)
    return _shown_windows(found)


def _stream_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = run_complete(stream_type_stats(_few_at_a_time(spark, sf_dir)), "stream-types")
    return counted.withColumn("sizes", size_text(F.col("sizes")))


def _shown_windows(df: DataFrame) -> DataFrame:
    """Window starts as the zone-free type, beside their index."""
    if "window_start" not in df.columns:
        df = df.withColumn("window_start", rates.window_start(WINDOW_SECONDS))
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _windowed(df: DataFrame) -> DataFrame:
    return rates.with_window(df, WINDOW_SECONDS)


def _packet_sizes(packets: DataFrame) -> DataFrame:
    return stats.packet_sizes(packets).withColumn("sizes", size_text(F.col("sizes")))


def _packet_rates(packets: DataFrame) -> DataFrame:
    return _shown_windows(rates.packet_rates(_windowed(packets), WINDOW_SECONDS))


def _packet_rates_relative(packets: DataFrame) -> DataFrame:
    return rates.packet_rates(
        rates.with_relative_window(packets, WINDOW_SECONDS), WINDOW_SECONDS
    )


def _packet_rates_dense(packets: DataFrame) -> DataFrame:
    return _shown_windows(rates.dense_rates(_windowed(packets), WINDOW_SECONDS))


def _running_type_totals(packets: DataFrame) -> DataFrame:
    found = rates.packet_rates(_windowed(packets), WINDOW_SECONDS)
    return rates.running_type_totals(found).drop("hz")


def _running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.running_capture_totals(
        _windowed(events_as_datagrams(spark, sf_dir)), _windowed(events_as_packets(spark, sf_dir))
    )


def _interval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_windows(
        interval_report(
            events_as_datagrams(spark, sf_dir), events_as_packets(spark, sf_dir), WINDOW_SECONDS
        )
    )


def _capture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_report_order(
        capture_summary(
            capture_manifest(spark, sf_dir),
            events_as_datagrams(spark, sf_dir),
            events_as_packets(spark, sf_dir),
        )
    )


def _decode_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_headers(_raw(spark, sf_dir)).select(*DECODED)


def _header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).where(is_valid(packet_size(F.col("payload"))))
    return raw.select(
        "capture_id", "seq", *[header_field(F.col("payload"), f).alias(f) for f in HEADER_FIELDS]
    )


def _receive_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = events_as_packets(spark, sf_dir).select("capture_id", "seq", "recv_mono")
    return with_recv_ts(stamped, capture_manifest(spark, sf_dir)).withColumn(
        "recv_ts", F.col("recv_ts").cast("timestamp_ntz")
    )


def _payload_facts(raw: DataFrame) -> DataFrame:
    return raw.select(
        "capture_id", "seq", "recv_mono", "size", F.md5(F.hex("payload")).alias("payload_md5")
    )


def _capture_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payload_facts(read_captures(spark, _exported(spark, sf_dir, "log"), "int"))


def _capture_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = capture_files(spark, _exported(spark, sf_dir, "split"), "int")
    return _payload_facts(read_split_captures(files))


def _archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark, 'archive')}/archive"
    write_archive(_raw(spark, sf_dir), path, cluster=True)
    return _payload_facts(read_archive(spark, path))


def _stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "stream-archive")
    raw = stream_captures(spark, _exported(spark, sf_dir, "landing"), "int")
    stream_archive(raw, f"{root}/archive", f"{root}/checkpoint").awaitTermination()
    return _payload_facts(read_archive(spark, f"{root}/archive"))


def _live_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _exported(spark, sf_dir, "landing")
    return stream_captures(spark, landing, "int", headers_only=True)


def _stream_packet_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = with_recv_ts(_live_packets(spark, sf_dir), capture_manifest(spark, sf_dir))
    counted = run_complete(stream_packet_rates(live, WINDOW_SECONDS), "stream-rates")
    return _shown_windows(counted)


def _stream_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_appending(stream_reversals(_live_packets(spark, sf_dir)), "stream-reversals")


def _stream_event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_appending(stream_event_runs(_live_packets(spark, sf_dir)), "stream-runs")


def _stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_complete(stream_sessions(_live_packets(spark, sf_dir)), "stream-sessions")


def _reported(spark: SparkSession, sf_dir: str, few: bool = False) -> DataFrame:
    """The report of a stream: whole logs at once, or short segments, a few at a time."""
    landing = _exported(spark, sf_dir, "landing", FEW_BITS if few else SEGMENT_BITS)
    live = stream_captures(spark, landing, "int", *([_files_at_once(spark, landing)] if few else []))
    live = with_recv_ts(live, capture_manifest(spark, sf_dir))
    written = run_appending(stream_interval_report(live, WINDOW_SECONDS), "stream-report")
    return _shown_windows(latest_reports(written))


def _stream_interval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(spark, sf_dir)


def _stream_interval_report_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(spark, sf_dir, few=True)


def _copy_part(files: DataFrame, source: str, target: str, share: float) -> int:
    """Copies the first bytes of every log, by tasks; the number of logs."""

    def copy(batches):
        for batch in batches:
            for path in batch["path"]:
                name = path[path.index("capture_id=") :]
                store, root = resolve(source)
                with store.open_input_stream(f"{root}/{name}") as log:
                    data = log.read()
                store, root = resolve(target)
                store.create_dir(os.path.dirname(f"{root}/{name}"))
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(data[: round(len(data) * share)])
            yield batch[["path"]]

    return files.select("path").mapInPandas(copy, "path string").count()


def _stream_growing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that grow in three steps, mostly to the middle of a record, and a restart after each."""
    whole, root = _exported(spark, sf_dir, "whole"), scratch_dir(spark, "growing")
    files = capture_files(spark, whole, "int")
    for share in (0.37, 0.74, 1.0):
        _copy_part(files, whole, f"{root}/logs", share)
        live = stream_growing_captures(spark, f"{root}/logs", f"{root}/progress", "int")
        found = run_appending(live, "growing", f"{root}/out")
    return _payload_facts(found)


def _landed_parts(
    spark: SparkSession, sf_dir: str, link: Callable[[DataFrame], DataFrame], late: bool
) -> DataFrame:
    """Segments that land in parts, each a micro-batch, and a restart after each part.

    Parts are quarters of the record numbers in order; or, for late segments,
    every third segment first, then each one before those, then the rest. The
    times at which parallel tasks finish their files decide nothing.
    """
    whole, root = _exported(spark, sf_dir, "whole", FEW_BITS), scratch_dir(spark, "parts")
    files = capture_files(spark, whole, "int")
    first = F.regexp_extract("path", r"segment-(\d+)\.bin$", 1).cast("long")
    number = F.shiftright(first, FEW_BITS)
    if late:
        parts = [number % 3 == k for k in (0, 2, 1)]
    else:
        n = (files.agg(F.max(number)).first()[0] or 0) + 1
        parts = [F.floor(number * 4 / n) == k for k in range(4)]
    for part in parts:
        landed = _copy_part(files.where(part), whole, f"{root}/logs", 1.0)
        if landed:
            live = stream_captures(spark, f"{root}/logs", "int", landed, headers_only=True)
            found = run_appending(link(live), "parts", f"{root}/out")
    return found


def _stream_reversals_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed_parts(spark, sf_dir, stream_reversals, late=False)


def _stream_event_runs_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed_parts(spark, sf_dir, stream_event_runs, late=False)


def _stream_reversals_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_changes(_landed_parts(spark, sf_dir, stream_reversal_changes, late=True))


def _stream_event_runs_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_changes(_landed_parts(spark, sf_dir, stream_event_run_changes, late=True))


def _training_data() -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and SQL of the training-data operators; none where they are not installed."""
    try:
        import corpus_pipeline
        from wiretally.llm import queries as llm
    except ModuleNotFoundError as error:
        if error.name not in ("corpus_pipeline", "wiretally.llm"):
            raise
        return {}, {}
    built, sql = llm.queries(), llm.oracle_sql()
    built["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return built, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query, each a function of the session and a table folder."""

    def on_packets(build: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf_dir: build(events_as_packets(spark, sf_dir))

    def on_datagrams(build: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf_dir: build(events_as_datagrams(spark, sf_dir))

    builders = {
        "packet_type_stats": on_packets(lambda p: in_report_order(type_summary(p))),
        "packet_counts": on_packets(lambda p: names.with_packet_name(stats.packet_counts(p))),
        "packet_sizes": on_packets(_packet_sizes),
        "last_frames": on_packets(stats.last_frames),
        "reversal_counts": on_packets(stats.reversal_counts),
        "flashbacks": on_packets(flashbacks),
        "reversals": on_packets(sequence.reversals),
        "event_packets": on_packets(sequence.event_packets),
        "event_runs": on_packets(sequence.event_runs),
        "event_sequence": on_packets(lambda p: sequence.event_sequence(sequence.event_runs(p))),
        "capture_totals": on_datagrams(stats.capture_totals),
        "capture_uptime": on_packets(stats.capture_uptime),
        "capture_sessions": on_packets(stats.capture_sessions),
        "first_packet": on_packets(stats.first_packet),
        "types_seen": on_packets(names.types_seen),
        "missing_types": on_packets(names.missing_types),
        "packet_rates": on_packets(_packet_rates),
        "packet_rates_relative": on_packets(_packet_rates_relative),
        "packet_rates_dense": on_packets(_packet_rates_dense),
        "running_type_totals": on_packets(_running_type_totals),
        "running_totals": _running_totals,
        "interval_report": _interval_report,
        "capture_summary": _capture_summary,
        "decode_headers": _decode_headers,
        "header_fields": _header_fields,
        "receive_times": _receive_times,
        "capture_roundtrip": _capture_roundtrip,
        "capture_split_roundtrip": _capture_split_roundtrip,
        "archive_roundtrip": _archive_roundtrip,
        "stream_archive": _stream_archive,
        "stream_packet_rates": _stream_packet_rates,
        "stream_reversals": _stream_reversals,
        "stream_event_runs": _stream_event_runs,
        "stream_interval_report": _stream_interval_report,
        "stream_interval_report_batches": _stream_interval_report_batches,
        "stream_growing_log": _stream_growing_log,
        "stream_sessions": _stream_sessions,
        "stream_type_stats": _stream_type_stats,
        "capture_damage": _capture_damage,
        "wire_type_stats": _wire_type_stats,
        "wire_capture_summary": _wire_capture_summary,
        "wire_interval_report": _wire_interval_report,
        "interval_report_relative": _interval_report_relative,
        # The same operators with settings small enough to cross many chunks,
        # blocks, ranges, segments and batches on small tables.
        "packet_type_stats_chunks": on_packets(
            lambda p: in_report_order(type_summary(p, FEW_BITS))
        ),
        "reversal_counts_chunks": on_packets(lambda p: stats.reversal_counts(p, FEW_BITS)),
        "reversals_chunks": on_packets(lambda p: sequence.reversals(p, FEW_BITS)),
        "event_runs_chunks": on_packets(lambda p: sequence.event_runs(p, FEW_BITS)),
        "event_sequence_parts": on_packets(
            lambda p: sequence.event_sequence(sequence.event_runs(p, FEW_BITS), FEW_BITS)
        ),
        "packet_rates_dense_blocks": on_packets(_packet_rates_dense_blocks),
        "running_totals_blocks": _running_totals_blocks,
        "interval_report_blocks": _interval_report_blocks,
        "capture_split_ranges": _capture_split_ranges,
        "stream_reversals_batches": _stream_reversals_batches,
        "stream_event_runs_batches": _stream_event_runs_batches,
        "stream_reversals_late": _stream_reversals_late,
        "stream_event_runs_late": _stream_event_runs_late,
    }

    def in_utc(build):
        return lambda spark, sf_dir: build(use_rocksdb(use_utc(spark)), sf_dir)

    builders |= _training_data()[0]
    return {name: in_utc(build) for name, build in builders.items()}


_CATALOG = ", ".join(f"({i}, '{name}')" for i, name in PACKET_NAMES.items())

# Payload bytes as hex, least significant byte first.
_FLOAT_BITS = "cast(cast(session_time AS bit) AS uinteger)"


def _hex(value: str, width: int) -> str:
    return " || ".join(
        f"printf('%02X', cast(({value} >> {8 * i}) & 255 AS int))" for i in range(width)
    )


_PAYLOAD_HEX = " || ".join(
    [
        _hex("packet_format", 2),
        *[
            _hex(f, 1)
            for f in ("game_year", "game_major", "game_minor", "packet_version", "packet_id")
        ],
        _hex("cast(session_uid AS uhugeint)", 8),
        _hex(_FLOAT_BITS, 4),
        _hex("frame_id", 4),
        _hex("overall_frame_id", 4),
        _hex("player_car", 1),
        _hex("secondary_car", 1),
        "coalesce(hex(event_code), '00000000')",
    ]
)

def _framed(name: str, bits: int) -> str:
    return f"""{name} AS (
  SELECT *, (seq >> {bits}) * {1 << bits} + row_number() OVER (
      PARTITION BY capture_id, seq >> {bits} ORDER BY seq) - 1 AS framed_seq
  FROM datagrams)"""


_WINDOWED = f"wd AS (SELECT *, recv_us // {WINDOW_US} AS window_index FROM datagrams),"

_WITH = f"""{DATAGRAMS_SQL},
names AS (SELECT * FROM (VALUES {_CATALOG}) AS t(packet_id, packet_name)),
lagged AS (
  SELECT *, lag(frame_id) OVER (PARTITION BY capture_id, packet_id ORDER BY seq) AS prev_frame_id
  FROM packets),
type_stats AS (
  SELECT capture_id, packet_id, count(*) AS n,
    array_to_string(list_sort(list(DISTINCT size)), ',') AS sizes,
    count(*) FILTER (WHERE frame_id < prev_frame_id) AS backwards,
    arg_max(frame_id, seq) AS last_frame
  FROM lagged GROUP BY ALL),
events_in AS (
  SELECT capture_id, seq, event_code AS code, session_time FROM packets
  WHERE packet_id = 3 AND size >= 33),
runs AS (
  SELECT capture_id, seq, code, session_time FROM (
    SELECT *, lag(code) OVER (PARTITION BY capture_id ORDER BY seq) AS prev FROM events_in)
  WHERE prev IS NULL OR prev <> code),
first_packets AS (
  SELECT capture_id, seq, packet_format, game_year, game_major, game_minor, player_car,
    recv_mono, recv_us, packet_format = 2023 AS format_ok
  FROM packets
  QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY seq) = 1),
missing AS (
  SELECT c.capture_id, names.packet_id, names.packet_name
  FROM (SELECT DISTINCT capture_id FROM packets) AS c, names
  WHERE NOT EXISTS (
    SELECT 1 FROM packets AS p
    WHERE p.capture_id = c.capture_id AND p.packet_id = names.packet_id)),
flashbacks AS (
  SELECT capture_id, packet_id, backwards,
    coalesce(packet_name, cast(packet_id AS varchar)) AS packet_name
  FROM type_stats LEFT JOIN names USING (packet_id) WHERE backwards > 0),
{_WINDOWED}
wp AS (SELECT * FROM wd WHERE size >= 29),
window_rates AS (
  SELECT capture_id, window_index, packet_id, count(*) AS n FROM wp GROUP BY ALL),
dense AS (
  SELECT g.capture_id, g.packet_id, g.window_index, coalesce(r.n, 0) AS n,
    cast(sum(coalesce(r.n, 0)) OVER (
      PARTITION BY g.capture_id, g.packet_id ORDER BY g.window_index) AS bigint) AS total
  FROM (
    SELECT capture_id, packet_id, unnest(generate_series(lo, hi)) AS window_index
    FROM (SELECT capture_id, packet_id, min(window_index) AS lo FROM wp GROUP BY ALL)
    JOIN (SELECT capture_id, max(window_index) AS hi FROM wd GROUP BY ALL) USING (capture_id)
  ) AS g
  LEFT JOIN window_rates AS r USING (capture_id, packet_id, window_index)),
new_sessions AS (
  SELECT capture_id, session_uid, min(window_index) AS window_index FROM wp GROUP BY ALL),
{_framed("framed", SEGMENT_BITS)},
{_framed("framed_few", FEW_BITS)}
"""

_RATES = f"""
SELECT capture_id, window_index, make_timestamp(window_index * {WINDOW_US}) AS window_start,
  packet_id, n, n / cast({WINDOW_SECONDS} AS double) AS hz
FROM window_rates"""

_PAYLOADS = f"""recv_mono, size,
  md5(left(rpad({_PAYLOAD_HEX}, 200, '0'), 2 * size)) AS payload_md5"""

_ORACLES = {
    "packet_type_stats": """
SELECT capture_id, packet_id, n, sizes, backwards, last_frame,
  coalesce(packet_name, 'UNKNOWN') AS packet_name
FROM type_stats LEFT JOIN names USING (packet_id)""",
    "packet_counts": """
SELECT capture_id, packet_id, count(*) AS n, coalesce(packet_name, 'UNKNOWN') AS packet_name
FROM packets LEFT JOIN names USING (packet_id) GROUP BY ALL""",
    "packet_sizes": "SELECT capture_id, packet_id, sizes FROM type_stats",
    "last_frames": "SELECT capture_id, packet_id, last_frame FROM type_stats",
    "reversal_counts": "SELECT capture_id, packet_id, backwards FROM type_stats",
    "flashbacks": "SELECT * FROM flashbacks",
    "reversals": """
SELECT capture_id, packet_id, seq, frame_id, prev_frame_id
FROM lagged WHERE frame_id < prev_frame_id""",
    "event_packets": "SELECT * FROM events_in",
    "event_runs": "SELECT * FROM runs",
    "event_sequence": f"""
SELECT capture_id, seq >> {CHUNK_BITS} AS part, count(*) AS n_codes,
  string_agg(code, ' ' ORDER BY seq) AS sequence
FROM runs GROUP BY ALL""",
    "capture_totals": """
SELECT capture_id, count(*) AS datagrams, count(*) FILTER (WHERE size < 29) AS runts,
  cast(sum(size) AS bigint) AS total_bytes, cast(sum(size) AS double) / 1e6 AS megabytes
FROM datagrams GROUP BY ALL""",
    "capture_uptime": """
SELECT capture_id, max(recv_mono) - min(recv_mono) AS uptime FROM packets GROUP BY ALL""",
    "capture_sessions": """
SELECT capture_id, count(DISTINCT session_uid) AS sessions FROM packets GROUP BY ALL""",
    "first_packet": "SELECT * EXCLUDE (recv_us) FROM first_packets",
    "types_seen": "SELECT DISTINCT capture_id, packet_id FROM packets",
    "missing_types": "SELECT * FROM missing",
    "packet_rates": _RATES,
    "packet_rates_relative": f"""
SELECT p.capture_id, packet_id,
  cast(floor((p.recv_mono - f.recv_mono) / cast({WINDOW_SECONDS} AS double)) AS bigint)
    AS window_index,
  count(*) AS n, count(*) / cast({WINDOW_SECONDS} AS double) AS hz
FROM packets AS p JOIN first_packets AS f ON p.capture_id = f.capture_id
GROUP BY ALL""",
    "packet_rates_dense": f"""
SELECT capture_id, packet_id, window_index, n, total, n / cast({WINDOW_SECONDS} AS double) AS hz,
  make_timestamp(window_index * {WINDOW_US}) AS window_start
FROM dense JOIN (
  SELECT capture_id, max(window_index) AS hi FROM wp GROUP BY ALL) USING (capture_id)
WHERE window_index <= hi""",
    "running_type_totals": """
SELECT capture_id, packet_id, window_index, n, total FROM dense WHERE n > 0""",
    "running_totals": """
SELECT capture_id, window_index, bytes, packets, sessions,
  cast(sum(bytes) OVER upto AS bigint) AS bytes_total,
  cast(sum(packets) OVER upto AS bigint) AS packets_total,
  cast(sum(sessions) OVER upto AS bigint) AS sessions_total
FROM (
  SELECT capture_id, window_index, cast(sum(size) AS bigint) AS bytes,
    count(*) FILTER (WHERE size >= 29) AS packets FROM wd GROUP BY ALL)
JOIN (
  SELECT w.capture_id, w.window_index, count(s.session_uid) AS sessions
  FROM (SELECT DISTINCT capture_id, window_index FROM wd) AS w
  LEFT JOIN new_sessions AS s USING (capture_id, window_index) GROUP BY ALL)
USING (capture_id, window_index)
WINDOW upto AS (PARTITION BY capture_id ORDER BY window_index)""",
    "interval_report": f"""
SELECT d.capture_id, d.window_index,
  make_timestamp(d.window_index * {WINDOW_US}) AS window_start,
  d.window_index = (SELECT max(window_index) FROM wd WHERE wd.capture_id = d.capture_id)
    AS is_partial,
  cast((d.window_index + 1) * {WINDOW_US} - f.recv_us AS double) / 1e6 AS uptime,
  cast((SELECT sum(size) FROM wd
        WHERE wd.capture_id = d.capture_id AND wd.window_index <= d.window_index)
    AS double) / 1e6 AS megabytes,
  (SELECT count(*) FROM new_sessions AS s
   WHERE s.capture_id = d.capture_id AND s.window_index <= d.window_index) AS sessions,
  d.packet_id, coalesce(packet_name, 'UNKNOWN') AS packet_name, d.total,
  d.n / cast({WINDOW_SECONDS} AS double) AS hz,
  (SELECT array_to_string(list_sort(list(DISTINCT size)), ',') FROM wp
   WHERE wp.capture_id = d.capture_id AND wp.packet_id = d.packet_id
     AND wp.window_index <= d.window_index) AS sizes
FROM dense AS d
JOIN first_packets AS f USING (capture_id)
LEFT JOIN names USING (packet_id)""",
    "capture_summary": """
SELECT m.capture_id,
  CASE WHEN v.packets IS NULL THEN 'no_packets' ELSE 'ok' END AS status,
  coalesce(t.datagrams, 0) AS datagrams, coalesce(t.runts, 0) AS runts,
  coalesce(t.total_bytes, 0) AS total_bytes,
  cast(coalesce(t.total_bytes, 0) AS double) / 1e6 AS megabytes,
  v.packets, v.sessions, v.uptime,
  f.packet_format, f.game_year, f.game_major, f.game_minor, f.player_car, f.format_ok,
  CASE WHEN v.packets IS NOT NULL THEN coalesce(x.missing, '') END AS missing,
  CASE WHEN v.packets IS NOT NULL THEN coalesce(b.flashbacks, '') END AS flashbacks,
  CASE WHEN v.packets IS NOT NULL THEN coalesce(e.event_runs, 0) END AS event_runs
FROM manifest AS m
LEFT JOIN (
  SELECT capture_id, count(*) AS datagrams, count(*) FILTER (WHERE size < 29) AS runts,
    cast(sum(size) AS bigint) AS total_bytes FROM datagrams GROUP BY ALL) AS t USING (capture_id)
LEFT JOIN (
  SELECT capture_id, count(*) AS packets, count(DISTINCT session_uid) AS sessions,
    max(recv_mono) - min(recv_mono) AS uptime FROM packets GROUP BY ALL) AS v USING (capture_id)
LEFT JOIN first_packets AS f USING (capture_id)
LEFT JOIN (
  SELECT capture_id, string_agg(packet_name, ', ' ORDER BY packet_id) AS missing
  FROM missing GROUP BY ALL) AS x USING (capture_id)
LEFT JOIN (
  SELECT capture_id,
    string_agg(packet_name || ' ' || backwards, ', ' ORDER BY packet_id) AS flashbacks
  FROM flashbacks GROUP BY ALL) AS b USING (capture_id)
LEFT JOIN (
  SELECT capture_id, count(*) AS event_runs
  FROM runs GROUP BY ALL) AS e USING (capture_id)""",
    "decode_headers": f"SELECT {', '.join(DECODED)} FROM packets",
    "header_fields": f"SELECT capture_id, seq, {', '.join(HEADER_FIELDS)} FROM packets",
    "receive_times": """
SELECT capture_id, seq, recv_mono, make_timestamp(recv_us) AS recv_ts FROM packets""",
    "capture_roundtrip": f"SELECT capture_id, framed_seq AS seq, {_PAYLOADS} FROM framed",
    "archive_roundtrip": f"SELECT capture_id, seq, {_PAYLOADS} FROM datagrams",
    "stream_packet_rates": _RATES.replace("window_index, make_timestamp", "make_timestamp"),
    "stream_reversals": """
SELECT f.capture_id, packet_id, f.framed_seq AS seq, frame_id, prev_frame_id,
  false AS out_of_order
FROM lagged JOIN framed AS f USING (capture_id, packet_id, seq, frame_id)
WHERE frame_id < prev_frame_id""",
    "stream_event_runs": """
SELECT runs.capture_id, framed_seq AS seq, code, runs.session_time, false AS out_of_order
FROM runs JOIN framed USING (capture_id, seq)""",
}
_ORACLES["capture_split_roundtrip"] = _ORACLES["capture_roundtrip"]
_ORACLES["stream_archive"] = _ORACLES["capture_roundtrip"]
_ORACLES["stream_sessions"] = _ORACLES["capture_sessions"]
_ORACLES["stream_type_stats"] = """
SELECT capture_id, packet_id, n, bytes, sizes FROM type_stats
JOIN (SELECT capture_id, packet_id, cast(sum(size) AS bigint) AS bytes FROM packets GROUP BY ALL)
USING (capture_id, packet_id)"""
_ORACLES["capture_damage"] = f"""
SELECT capture_id, segment, record, byte, kept - byte AS unread_bytes, 'cut record' AS problem
FROM (
  SELECT capture_id, (seq >> {FEW_BITS}) << {FEW_BITS} AS segment, framed_seq AS record,
    cast(sum(size + 12) OVER upto - size - 12 AS bigint) AS byte,
    cast(sum(size + 12) OVER upto AS bigint) AS ends,
    cast(sum(size + 12) OVER (PARTITION BY capture_id, seq >> {FEW_BITS}) AS bigint)
      - ((seq >> {FEW_BITS}) * 7 + capture_id) % 61 AS kept
  FROM framed_few
  WINDOW upto AS (PARTITION BY capture_id, seq >> {FEW_BITS} ORDER BY seq))
WHERE byte < kept AND ends > kept"""
for _name, _like in {
    "wire_type_stats": "packet_type_stats",
    "wire_capture_summary": "capture_summary",
    "wire_interval_report": "interval_report",
    "stream_growing_log": "capture_roundtrip",
    "stream_interval_report": "interval_report",
    "stream_interval_report_batches": "interval_report",
    "packet_type_stats_chunks": "packet_type_stats",
    "reversal_counts_chunks": "reversal_counts",
    "reversals_chunks": "reversals",
    "event_runs_chunks": "event_runs",
    "packet_rates_dense_blocks": "packet_rates_dense",
    "running_totals_blocks": "running_totals",
    "interval_report_blocks": "interval_report",
    "capture_split_ranges": "capture_roundtrip",
}.items():
    _ORACLES[_name] = _ORACLES[_like]
_ORACLES["event_sequence_parts"] = _ORACLES["event_sequence"].replace(
    f"seq >> {CHUNK_BITS}", f"seq >> {FEW_BITS}"
)
for _name in ("stream_reversals", "stream_event_runs"):
    _ORACLES[f"{_name}_batches"] = _ORACLES[_name].replace("framed AS f", "framed_few AS f").replace(
        "JOIN framed USING", "JOIN framed_few USING"
    )
    _ORACLES[f"{_name}_late"] = _ORACLES[f"{_name}_batches"]

# Windows from each capture's first valid packet, by its own clock.
_RELATIVE_WITH = _WITH.replace(
    _WINDOWED,
    f"""wd AS (
  SELECT d.*, cast(floor((d.recv_mono - f.recv_mono) / cast({WINDOW_SECONDS} AS double)) AS bigint)
    AS window_index
  FROM datagrams AS d JOIN first_packets AS f USING (capture_id)),""",
)
_RELATIVE_REPORT = (
    _ORACLES["interval_report"]
    .replace(f"  make_timestamp(d.window_index * {WINDOW_US}) AS window_start,\n", "")
    .replace(
        f"cast((d.window_index + 1) * {WINDOW_US} - f.recv_us AS double) / 1e6",
        f"(d.window_index + 1) * cast({WINDOW_SECONDS} AS double)",
    )
)


def oracle_sql() -> dict[str, str]:
    """Standard SQL with the same result for every query."""
    own = {name: _WITH + sql for name, sql in _ORACLES.items()}
    own["interval_report_relative"] = _RELATIVE_WITH + _RELATIVE_REPORT
    return own | _training_data()[1]
