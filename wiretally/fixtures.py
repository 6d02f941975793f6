"""Packets made from an ``events`` table, for queries and tests.

The mapping is stated once in SQL text that both Spark and the check engine
can run; the two differ only in how they read a JSON field and a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.layout import EVENT_PACKET_BYTES, HEADER_BYTES, HEADER_DTYPE, HEADER_FIELDS

# Seconds between the epoch and the made-up clock origin of a capture.
ANCHOR_SECONDS = 1_700_000_000

MAPPING = {
    "seq": "event_id",
    "capture_id": "cast(user_id % 4 AS int)",
    "recv_us": "recv_us",
    "recv_mono": "cast(recv_us - anchor_us AS double) / cast(1000000 AS double)",
    "size": "size",
    "packet_format": "CASE WHEN size % 10 = 0 THEN 2022 ELSE 2023 END",
    "game_year": "23",
    "game_major": "1",
    "game_minor": "0",
    "packet_version": "1",
    "packet_id": """CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 2
        WHEN 'purchase' THEN 3 WHEN 'click' THEN 6 ELSE 14 END""",
    "session_uid": """cast(cast(9223372036854775808 AS decimal(20,0)) + user_id
        AS decimal(20,0))""",
    "session_time": "cast(value AS float)",
    "frame_id": "cast(round(value * 100) AS bigint)",
    "overall_frame_id": "cast(round(value * 100) AS bigint)",
    "player_car": "19",
    "secondary_car": "255",
    "event_code": f"""CASE WHEN event_type = 'purchase' AND size >= {EVENT_PACKET_BYTES}
        THEN CASE user_id % 3 WHEN 0 THEN 'AAAA' WHEN 1 THEN 'BBBB' ELSE 'CCCC' END END""",
}
SELECT_LIST = [f"{expr} AS {name}" for name, expr in MAPPING.items()]


def _anchor_us(user_id: str = "user_id") -> str:
    return f"(({user_id} % 4) * 1000 + {ANCHOR_SECONDS}) * cast(1000000 AS bigint)"


def events_as_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty datagram, runts included, with its header columns."""
    return _mapped(spark, sf_dir, 1)


def _mapped(spark: SparkSession, sf_dir: str, smallest: int) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (
        events.selectExpr(
            "event_id",
            "user_id",
            "event_type",
            "value",
            "cast(get_json_object(props, '$.k') AS int) AS size",
            "unix_micros(cast(ts AS timestamp)) AS recv_us",
            f"{_anchor_us()} AS anchor_us",
        )
        .where(F.col("size") >= smallest)
        .selectExpr(*SELECT_LIST)
        .withColumn("recv_ts", F.timestamp_micros("recv_us"))
        .drop("recv_us")
    )


def events_as_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid packets only."""
    return _mapped(spark, sf_dir, HEADER_BYTES)


def capture_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with their clock anchor; the last one has no datagram at all."""
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .selectExpr("cast(user_id % 5 AS int) AS capture_id")
        .distinct()
        .selectExpr(
            "capture_id",
            f"(capture_id * 1000 + {ANCHOR_SECONDS}) * cast(1000000 AS bigint) AS anchor_us",
        )
    )


# The mapping for the check engine.
DATAGRAMS_SQL = f"""
WITH datagrams AS (
  SELECT {", ".join(SELECT_LIST)} FROM (
    SELECT event_id, user_id, event_type, value, ts,
      cast(json_extract_string(props, '$.k') AS int) AS size,
      epoch_us(ts) AS recv_us,
      {_anchor_us()} AS anchor_us
    FROM events) AS e
  WHERE size > 0),
packets AS (SELECT * FROM datagrams WHERE size >= {HEADER_BYTES}),
manifest AS (
  SELECT DISTINCT cast(user_id % 5 AS int) AS capture_id FROM events)
"""


def encode(datagrams: DataFrame) -> DataFrame:
    """Replace the header columns by the datagram bytes they stand for.

    Header, code, then zeros up to ``size``; a runt is the header cut short.
    """
    kept = [f for f in datagrams.schema.fields if f.name not in (*HEADER_FIELDS, "event_code")]
    schema = T.StructType([*kept, T.StructField("payload", T.BinaryType())])
    names = [f.name for f in kept]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            header = np.zeros(len(batch), HEADER_DTYPE)
            for name in HEADER_FIELDS:
                column = batch.column(name)
                if pa.types.is_decimal(column.type):
                    column = column.cast(pa.uint64())
                header[name] = column.to_numpy(zero_copy_only=False)
            codes = np.frombuffer(
                "".join(c or "\0\0\0\0" for c in batch.column("event_code").to_pylist()).encode("ascii"),
                np.uint8,
            ).reshape(-1, 4)
            head = np.hstack([header.view(np.uint8).reshape(-1, HEADER_BYTES), codes])
            sizes = batch.column("size").to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            data = np.zeros(ends[-1], np.uint8)
            for i in range(head.shape[1]):
                long_enough = sizes > i
                data[ends[:-1][long_enough] + i] = head[long_enough, i]
            payload = pa.BinaryArray.from_buffers(
                pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(data)]
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), payload], [*names, "payload"]
            )

    return datagrams.mapInArrow(pack, schema)
