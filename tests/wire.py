"""Hand-made datagrams and logs, and what a capture holds by definition.

``profile`` is the independent answer the Spark jobs are held against. It takes
a whole capture at once and derives each fact from its definition.
"""

from __future__ import annotations

import random
import struct
from itertools import groupby, pairwise

from wiretally.layout import PACKET_NAMES

RAW_SCHEMA = "capture_id int, seq bigint, recv_mono double, payload binary"


def datagram(
    packet_id=0,
    frame=0,
    size=29,
    session=1,
    time=0.0,
    code=b"",
    packet_format=2023,
    overall=None,
    player=19,
    secondary=255,
    year=23,
    major=1,
    minor=2,
    version=1,
) -> bytes:
    little = [
        (packet_format, 2),
        (year, 1),
        (major, 1),
        (minor, 1),
        (version, 1),
        (packet_id, 1),
        (session, 8),
    ]
    head = b"".join(v.to_bytes(w, "little") for v, w in little) + struct.pack("<f", time)
    rest = [(frame, 4), (frame if overall is None else overall, 4), (player, 1), (secondary, 1)]
    head += b"".join(v.to_bytes(w, "little") for v, w in rest)
    return (head + code).ljust(size, b"\0")[:size]


def record(payload: bytes, recv_mono: float) -> bytes:
    return len(payload).to_bytes(4, "little") + struct.pack("<d", recv_mono) + payload


def log(datagrams, start=100.0, step=0.25) -> bytes:
    return b"".join(record(d, start + i * step) for i, d in enumerate(datagrams))


def raw_rows(captures: dict[int, list[bytes]], start=100.0, step=0.25) -> list[tuple]:
    return [
        (capture, i, start + i * step, bytearray(d))
        for capture, datagrams in captures.items()
        for i, d in enumerate(datagrams)
    ]


def random_capture(rng: random.Random, n: int) -> list[bytes]:
    """Packets of several types with rising frames that sometimes fall back."""
    frame, made = 1000, []
    for _ in range(n):
        frame = max(0, frame + rng.choice([0, 1, 1, 2, -5]))
        packet_id = rng.choice([0, 0, 2, 3, 3, 6, 14, 200])
        size = rng.choice([0, 5, 28, 29, 32, 33, 60, 1349])
        made.append(
            datagram(
                packet_id,
                frame,
                size,
                session=rng.choice([7, 2**63, 2**64 - 1]),
                time=frame / 8,
                code=rng.choice([b"SSTA", b"BUTN", b"BUTN", b"\xff\x00AB"]),
                packet_format=rng.choice([2022, 2023]),
            )
        )
    return made


def fields(data: bytes) -> dict:
    """The header fields that the statistics rest on."""
    number = lambda lo, hi: int.from_bytes(data[lo:hi], "little")
    return {
        "type": data[6],
        "session": number(7, 15),
        "frame": number(19, 23),
        "first": (number(0, 2), data[2], data[3], data[4], data[27]),
    }


def profile(datagrams, times, window_of) -> dict:
    """What a whole capture holds, each part from its own definition."""
    kept = [(d, window_of(t)) for d, t in zip(datagrams, times) if d]
    valid = [(fields(d), len(d), w, d) for d, w in kept if len(d) >= 29]
    by_type = {t: [v for v in valid if v[0]["type"] == t] for t in {v[0]["type"] for v in valid}}
    types = {
        t: {
            "n": len(own),
            "sizes": {size for _, size, _, _ in own},
            "back": sum(b[0]["frame"] < a[0]["frame"] for a, b in pairwise(own)),
            "last": own[-1][0]["frame"],
        }
        for t, own in by_type.items()
    }
    codes = [d[29:33].decode("ascii", "replace") for f, size, _, d in valid if f["type"] == 3 and size >= 33]
    windows = range(valid[0][2], kept[-1][1] + 1) if valid else ()
    reports = {
        w: {
            "bytes": sum(len(d) for d, at in kept if at <= w),
            "sessions": len({f["session"] for f, _, at, _ in valid if at <= w}),
            "types": {
                t: (len(upto), sum(v[2] == w for v in upto), sorted({v[1] for v in upto}))
                for t, own in by_type.items()
                if (upto := [v for v in own if v[2] <= w])
            },
        }
        for w in windows
    }
    return {
        "datagrams": len(kept),
        "runts": len(kept) - len(valid),
        "total_bytes": sum(len(d) for d, _ in kept),
        "sessions": len({f["session"] for f, *_ in valid}),
        "first": valid[0][0]["first"] if valid else None,
        "types": types,
        "events": [code for code, _ in groupby(codes)],
        "missing": [name for t, name in sorted(PACKET_NAMES.items()) if t not in types],
        "reports": reports,
    }
