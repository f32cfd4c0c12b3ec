"""Media columns: Ogg containers.

``mux`` writes packets of several logical streams as Ogg pages; ``demux`` verifies
each page's checksum, puts packets together from the lacing values, sorts them by
logical stream and derives each packet's time from the granule positions.

Samples are 8-bit: one byte of payload is one sample of a logical stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = struct.Struct("<4sBBqIIIB")  # capture pattern, version, flags, granule position, serial, sequence, checksum, segments
CONTINUED, FIRST, LAST = 1, 2, 4
#: Identification packet of a stream of 8-bit samples: magic, rate a second, samples in all.
SAMPLES = struct.Struct("<8sIQ")
MAGIC = b"Samples8"
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, bits not mirrored, start and final XOR zero."""
    mirrored = zlib.crc32(data.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRROR), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream, as (granule position, page); a packet comes with the granule position at its end."""
    segments: list[tuple[int, bytes, int]] = []  # lacing value, its bytes, granule position if a packet ends here
    for data, granule in packets:
        values, at = lacing(len(data)), 0
        for k, v in enumerate(values):
            segments.append((v, data[at : at + v], granule if k == len(values) - 1 else -1))
            at += v
    # the identification packet has a page of its own
    cuts = [0, len(lacing(len(packets[0][0]))), *range(len(lacing(len(packets[0][0]))) + 255, len(segments), 255), len(segments)]
    cuts = sorted({c for c in cuts if c <= len(segments)})
    out = []
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = segments[a:b]
        ends = [g for _, _, g in part if g >= 0]
        flags = CONTINUED * (a > 0 and segments[a - 1][0] == 255) | FIRST * (n == 0) | LAST * (b == len(segments))
        granule = ends[-1] if ends else -1
        body = bytes(v for v, _, _ in part) + b"".join(s for _, s, _ in part)
        page = bytearray(HEAD.pack(b"OggS", 0, flags, granule, serial, n, 0, len(part)) + body)
        page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
        out.append((granule, bytes(page)))
    return out


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """First pages of all streams first, then all others by their granule position."""
    firsts, rest = [], []
    for k, (serial, packets) in enumerate(streams.items()):
        own, last = pages(serial, packets), 0
        firsts.append(own[0][1])
        for n, (granule, page) in enumerate(own[1:]):
            last = max(last, granule)
            rest.append((last, n, k, page))
    return b"".join(firsts) + b"".join(p for *_, p in sorted(rest, key=lambda x: x[:3]))


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    times: list[float | None] = field(default_factory=list)
    pages: int = 0
    last: int = 0
    rate: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)
    _next: int = 0


def demux(data: bytes) -> tuple[dict[int, Stream], list[str]]:
    """-> logical streams by serial, and what was wrong.

    A page with a wrong checksum, or cut off, is left out and reading goes on at the
    next capture pattern; a packet that such a gap cuts is dropped and named.
    ``times`` has seconds at a packet's end for the last packet that ends on a page,
    None for the others.
    """
    streams: dict[int, Stream] = {}
    wrong: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + HEAD.size > len(data):
            found = data.find(b"OggS", at + 1)
            wrong.append(f"no page at {at}")
            if found < 0:
                break
            at = found
            continue
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        values = data[at + HEAD.size : at + HEAD.size + n]
        body = at + HEAD.size + n
        end = body + sum(values)
        page = data[at:end]
        if version or len(values) < n or end > len(data) or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            wrong.append(f"bad page at {at}")
            at = data.find(b"OggS", at + 1) if data.find(b"OggS", at + 1) >= 0 else len(data)
            continue
        s = streams.setdefault(serial, Stream())
        broken = number != s._next
        if broken:
            wrong.append(f"pages missing before {number} of stream {serial}")
            s._open = []
        lost = bool(flags & CONTINUED) and not s._open
        s._next, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & LAST)
        parts, done = s._open if flags & CONTINUED else [], 0
        for v in values:
            parts.append(data[body : body + v])
            body += v
            if v < 255:
                if lost:
                    wrong.append(f"a packet of stream {serial} has no beginning")
                    lost = False
                else:
                    packet = b"".join(parts)
                    if not s.packets and packet[:8] == MAGIC and len(packet) == SAMPLES.size:
                        s.rate = SAMPLES.unpack(packet)[1]
                    s.packets.append(packet)
                    s.times.append(None)
                    done += 1
                parts = []
        s._open = parts
        if done and granule >= 0:
            s.times[-1] = granule / s.rate if s.rate else None
            s.last = max(s.last, granule)
        at = end
    wrong += [f"stream {k} ends inside a packet" for k, s in streams.items() if s._open]
    return streams, wrong


def store(payload: bytes, rate: int = 8000, streams: int = 2, block: int = 4000) -> bytes:
    """``payload`` as samples: blocks of ``block`` samples go to the logical streams in turn."""
    out = {}
    for k in range(streams):
        blocks = [payload[a : a + block] for a in range(k * block, len(payload), streams * block)]
        packets, granule = [(SAMPLES.pack(MAGIC, rate, sum(map(len, blocks))), 0)], 0
        for b in blocks:
            granule += len(b)
            packets.append((b, granule))
        out[k + 1] = packets
    return mux(out)


def load(stored: bytes) -> tuple[bytes, dict[int, Stream], list[str]]:
    """-> the payload, the logical streams, and what was wrong.

    Streams that do not begin with an identification packet of samples (other codecs, or
    the page is damaged) give nothing to the payload and are named.
    """
    streams, wrong = demux(stored)
    rows = []
    for serial, s in sorted(streams.items()):
        head = s.packets[0] if s.packets else b""
        if len(head) != SAMPLES.size or head[:8] != MAGIC:
            wrong.append(f"stream {serial} has no samples")
            continue
        rows.append(s.packets[1:])
        if sum(map(len, rows[-1])) != SAMPLES.unpack(head)[2]:
            wrong.append(f"stream {serial} has lost samples")
    blocks = [r[k] for k in range(max(map(len, rows), default=0)) for r in rows if k < len(r)]
    return b"".join(blocks), streams, wrong


def padded(text: str | None, to: int = 64) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % to or (0 if raw else to)), len(raw)


def ogg_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, n_bytes, ogg: each text's padded UTF-8 bytes as an Ogg file.

    Null and empty texts give 64 zero bytes of payload; long ones as many pages as they
    need. Other columns are ignored; every row gives a row, an empty table none.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                raw = [padded(t) for t in batch.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([n for _, n in raw], pa.int64()), pa.array([store(p) for p, _ in raw], pa.binary())], [id_col, "n_bytes", "ogg"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` long, n_bytes long, ogg binary")


READ = {
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "n_pages": pa.int64(), "seconds": pa.float64(), "problems": pa.list_(pa.string()),
}


def read_features(stored: bytes | None) -> tuple:
    payload, streams, wrong = load(stored or b"")
    tail = payload[-64:]
    seconds = max((s.last / s.rate for s in streams.values() if s.rate), default=0.0)
    n_pages = sum(s.pages for s in streams.values())
    levels = [payload.count(0), payload.count(32), payload.count(10)]
    feature = f"streams={len(streams)};pages={n_pages};packets={sum(len(s.packets) for s in streams.values())};seconds={seconds:.6f};" + ";".join(f"{'.'.join(map(str, (k, len(s.packets), s.last)))}" for k, s in sorted(streams.items())) + f";zeros={levels[0]};spaces={levels[1]};lines={levels[2]}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail), len(stored or b""), hashlib.sha256(stored or b"").hexdigest(), feature, n_pages, seconds, wrong


def ogg_features(media: DataFrame, ogg_col: str = "ogg") -> DataFrame:
    """``media`` with what its Ogg column holds: payload digest, checksum of the last 64
    bytes, sizes, a feature line, pages, seconds by granule position, and problems.

    Null or foreign bytes give an empty payload; what is wrong is in ``problems``. New
    columns must not clash with those of ``media``.
    """
    kept = [c for c in media.columns if c != ogg_col]
    if clash := set(kept) & set(READ):
        raise ValueError(f"columns {sorted(clash)} are taken")
    types = {"payload_bytes": "long", "tail_crc32": "long", "media_bytes": "long", "n_pages": "long", "seconds": "double", "problems": "array<string>"}

    def run(batches):
        for batch in batches:
            n = len(kept)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [read_features(b) for b in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(n)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(READ.values())], [*kept, *READ])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*[F.col(f"`{c}`") for c in kept]).schema)
    return media.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ogg_col}`")).mapInArrow(run, ddl + ", " + ", ".join(f"{k} {types.get(k, 'string')}" for k in READ))
