"""Column functions."""

from wiretally.functions.measures import megabytes, rate, size_text
from wiretally.functions.payload import (
    event_code,
    event_code_key,
    header_field,
    is_datagram,
    is_event,
    is_expected_format,
    is_valid,
    packet_size,
)

__all__ = [
    "event_code",
    "event_code_key",
    "header_field",
    "is_datagram",
    "is_event",
    "is_expected_format",
    "is_valid",
    "megabytes",
    "packet_size",
    "rate",
    "size_text",
]
