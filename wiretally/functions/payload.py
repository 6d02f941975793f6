"""Column functions over one datagram's payload. All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.layout import (
    EVENT_CODE_BYTES,
    EVENT_PACKET_BYTES,
    EVENT_PACKET_ID,
    EXPECTED_FORMAT,
    HEADER_BYTES,
    HEADER_DTYPE,
    HEADER_LAYOUT,
)

_SPARK_TYPES = {name: spark_type for name, _, _, spark_type in HEADER_LAYOUT}


def packet_size(payload: Column) -> Column:
    """Bytes in the payload."""
    return F.octet_length(payload)


def is_datagram(size: Column) -> Column:
    """Empty datagrams leave no trace anywhere."""
    return size > 0


def is_valid(size: Column) -> Column:
    """True when the datagram is long enough to hold a header."""
    return size >= HEADER_BYTES


def is_event(packet_id: Column, size: Column) -> Column:
    """True when the packet is an event packet that holds a whole code."""
    return (packet_id == EVENT_PACKET_ID) & (size >= EVENT_PACKET_BYTES)


def is_expected_format(packet_format: Column) -> Column:
    return packet_format == EXPECTED_FORMAT


def event_code(payload: Column) -> Column:
    """The four code bytes as ASCII, each non-ASCII byte replaced by U+FFFD.

    A strict US-ASCII decode raises on Spark 4, so bytes go through Latin-1,
    which maps each byte to one character.
    """
    code = F.decode(F.substring(payload, HEADER_BYTES + 1, EVENT_CODE_BYTES), "ISO-8859-1")
    return F.regexp_replace(code, "[^\\x00-\\x7F]", "�")


def event_code_key(code: Column) -> Column:
    """A BIGINT that stands for a four-character code, one-to-one.

    Every character is at most U+FFFD, so 16 bits hold each. Grouping buffers
    can hold a BIGINT in place, which keeps such aggregates hash-based.
    """
    key = F.lit(0).cast("bigint")
    for i in range(EVENT_CODE_BYTES):
        point = F.ascii(F.substring(code, i + 1, 1)).cast("bigint")
        key = key.bitwiseOR(F.shiftleft(point, 16 * (EVENT_CODE_BYTES - 1 - i)))
    return key


def _unsigned(payload: Column, offset: int, width: int) -> Column:
    """A little-endian unsigned integer as DECIMAL(20,0)."""
    big_endian = F.concat(
        *[F.substring(payload, offset + 1 + i, 1) for i in reversed(range(width))]
    )
    return F.conv(F.hex(big_endian), 16, 10).cast("decimal(20,0)")


def _float32(bits: Column) -> Column:
    """The single-precision number with these bits, held in a BIGINT."""
    sign = F.when(F.shiftright(bits, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255).cast("bigint"))
    fraction = bits.bitwiseAND(F.lit((1 << 23) - 1).cast("bigint"))
    finite = F.when(
        exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-149))
    ).otherwise((fraction + (1 << 23)) * F.pow(F.lit(2.0), exponent - 150))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(exponent == 255, special).otherwise(finite)).cast("float")


def header_field(payload: Column, name: str) -> Column:
    """One header field straight from the payload.

    Cheap when a query needs one or two fields; for the whole header use
    :func:`wiretally.operators.headers.decode_headers`.
    """
    kind, offset = HEADER_DTYPE.fields[name]
    raw = _unsigned(payload, offset, kind.itemsize)
    if name == "session_time":
        return _float32(raw.cast("bigint"))
    return raw.cast(_SPARK_TYPES[name])
