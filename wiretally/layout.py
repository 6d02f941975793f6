"""Wire layout of a telemetry datagram and of a capture log.

Everything here is a fixed value of the wire protocol; nothing is tunable.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

# Sizes and markers of the protocol.
HEADER_BYTES = 29
EVENT_CODE_BYTES = 4
EVENT_PACKET_BYTES = HEADER_BYTES + EVENT_CODE_BYTES
EVENT_PACKET_ID = 3
EXPECTED_FORMAT = 2023
MAX_DATAGRAM_BYTES = 4096
LOG_FRAME_BYTES = 12

# The packet header, little-endian and packed.
# column, offset, numpy type, Spark type
HEADER_LAYOUT = [
    ("packet_format", 0, "<u2", T.IntegerType()),
    ("game_year", 2, "u1", T.IntegerType()),
    ("game_major", 3, "u1", T.IntegerType()),
    ("game_minor", 4, "u1", T.IntegerType()),
    ("packet_version", 5, "u1", T.IntegerType()),
    ("packet_id", 6, "u1", T.IntegerType()),
    ("session_uid", 7, "<u8", T.DecimalType(20, 0)),
    ("session_time", 15, "<f4", T.FloatType()),
    ("frame_id", 19, "<u4", T.LongType()),
    ("overall_frame_id", 23, "<u4", T.LongType()),
    ("player_car", 27, "u1", T.IntegerType()),
    ("secondary_car", 28, "u1", T.IntegerType()),
]

# Packet types by id.
PACKET_NAMES = {
    0: "Motion",
    1: "Session",
    2: "LapData",
    3: "Event",
    4: "Participants",
    5: "CarSetups",
    6: "CarTelemetry",
    7: "CarStatus",
    8: "FinalClassification",
    9: "LobbyInfo",
    10: "CarDamage",
    11: "SessionHistory",
    12: "TyreSets",
    13: "MotionEx",
}
UNKNOWN_NAME = "UNKNOWN"

HEADER_FIELDS = [name for name, _, _, _ in HEADER_LAYOUT]

HEADER_DTYPE = np.dtype(
    {
        "names": HEADER_FIELDS,
        "formats": [kind for _, _, kind, _ in HEADER_LAYOUT],
        "offsets": [offset for _, offset, _, _ in HEADER_LAYOUT],
        "itemsize": HEADER_BYTES,
    }
)

# One capture-log record is this frame followed by `length` payload bytes.
LOG_FRAME_DTYPE = np.dtype([("length", "<u4"), ("recv_mono", "<f8")])
