"""Media columns: MPEG audio streams that carry bytes losslessly, and their exact index.

``encode`` stores bytes as MPEG-1 Layer III mono frames at 48 kHz. Every frame has a checksum
and an empty granule pair (its side information is zero: silence), so that all bytes after the
side information are ancillary data; those are the payload. The stream starts with an ID3v2 tag
that holds the payload's lengths and a frame with the variable-bitrate table, and ends with an
ID3v1 tag. Frames have the highest bitrate, the last one the lowest that holds what is left.

``scan_stream`` reads any MPEG audio stream that isn't free-format: it resynchronises on headers
that are followed by another header of the same kind (or by the stream's end), reads the
variable-bitrate table (Xing, Info or VBRI), verifies checksums of all three layers where frames
have them and gives the exact number of samples and the offset of every frame. Of tags it keeps
the ID3v2 text frames (by frame id, TXXX by description) and the ID3v1 fields (id3v1.title and so
on); unsynchronised, compressed and encrypted ID3v2 frames and extended headers are not decoded.

Defined results: null counts as empty; an empty text is 64 zero bytes; bytes between frames are
skipped and counted as resynchronisations; a frame that is cut off by the stream's end is not
one; a wrong checksum is counted and the frame still read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Fixed values of the format: kbit/s by (version is 1, layer) and index, and Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
PAD = 64
SIDE = 17  # bytes of side information of a mono frame


def crc16(data: bytes) -> int:
    """The checksum of frames: polynomial 0x8005, starting from all ones."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _crc16_bits(data: bytes, bits: int) -> int:
    crc = crc16(data[: bits // 8])
    for i in range(bits % 8):
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ data[bits // 8] >> 7 - i) & 1 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    checked: bool
    kbps: int
    hz: int
    mono: bool
    length: int
    samples: int
    side: int


_HEADERS: dict[bytes, Header | None] = {}


def read_header(four: bytes) -> Header | None:
    """The header in four bytes, or None. Free-format streams are not headers."""
    if four in _HEADERS:
        return _HEADERS[four]
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version = (2.5, None, 2, 1)[four[1] >> 3 & 3]
        layer = (None, 3, 2, 1)[four[1] >> 1 & 3]
        rate, step = four[2] >> 4, four[2] >> 2 & 3
        if version and layer and 0 < rate < 15 and step < 3 and four[3] & 3 != 2:
            kbps, hz, padding, mono = BITRATES[version == 1, layer][rate], RATES[version][step], four[2] >> 1 & 1, four[3] >> 6 == 3
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
            length = (12000 * kbps // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + padding
            side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
            found = Header(version, layer, not four[1] & 1, kbps, hz, mono, length, samples, side)
    if len(_HEADERS) > 50_000:
        _HEADERS.clear()
    _HEADERS[four] = found
    return found


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _tag(values: dict[str, str]) -> bytes:
    frames = b""
    for key, value in values.items():
        body = b"\x03" + key.encode() + b"\0" + value.encode()
        frames += b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _syncsafe(len(frames)) + frames


def _frame_head(rate: int, checked: bool = True) -> bytes:
    """Header, checksum and empty side information of a mono frame at 48 kHz."""
    head = bytes((0xFF, 0xFA if checked else 0xFB, rate << 4 | 1 << 2, 0xC0))
    side = bytes(SIDE)
    return head + (struct.pack(">H", crc16(head[2:] + side)) if checked else b"") + side


_SIZES = {r: 3 * BITRATES[True, 3][r] for r in range(1, 15)}
_HEADS = {r: _frame_head(r) for r in _SIZES}
_ROOM = {r: _SIZES[r] - len(_HEADS[r]) for r in _SIZES}


def encode(data: bytes) -> bytes:
    """data, padded with zeros to a positive multiple of 64, as an MPEG audio stream."""
    padded = data + bytes(PAD - len(data) if not data else -len(data) % PAD)
    head, room = _HEADS[14], _ROOM[14]
    full, rest = divmod(len(padded), room)
    parts, sizes = [], [_SIZES[14]] * full
    for i in range(full):
        parts += (head, padded[i * room : (i + 1) * room])
    if rest:
        rate = next(r for r in _SIZES if _ROOM[r] >= rest)
        parts += (_HEADS[rate], padded[full * room :], bytes(_ROOM[rate] - rest))
        sizes.append(_SIZES[rate])
    first = 3 * 48
    total, at, starts = first + sum(sizes), first, [0]
    for s in sizes:
        starts.append(at)
        at += s
    toc = bytes(min(255, starts[p * len(starts) // 100] * 256 // total) for p in range(100))
    table = b"Xing" + struct.pack(">III", 15, len(sizes), total) + toc + struct.pack(">I", 0)
    index = (_frame_head(3, checked=False) + table).ljust(first, b"\0")
    tag = _tag({"payload_bytes": str(len(padded)), "data_bytes": str(len(data))})
    return b"".join((tag, index, *parts, b"TAG".ljust(128, b"\0")))


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    hz: int = 0
    vbr_frames: int = -1
    vbr_bytes: int = -1
    vbr_toc: bytes = b""
    bad_checksums: int = 0
    resyncs: int = 0
    rates: set[int] = field(default_factory=set)
    ancillary: list[bytes] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.samples / self.hz if self.hz else 0.0


_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _read_text(name: str, body: bytes, found: Stream) -> None:
    """Keeps a text frame of an ID3v2 tag. Each string of a UTF-16 frame may have a byte-order mark of its own."""
    if not name.startswith("T") or not body or body[0] >= len(_ENCODINGS):
        return
    text = body[1:].decode(_ENCODINGS[body[0]], errors="replace")
    if body[0] in (1, 2):
        text = text.replace("\ufeff", "")
    if name in ("TXXX", "TXX"):
        name, _, text = text.partition("\0")
    found.tags[name] = text.rstrip("\0")


def _read_last_tag(tag: bytes, found: Stream) -> None:
    """Keeps the fields of an ID3v1 tag that are not empty."""
    numbered = tag[125] == 0 and tag[126] > 0
    for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 125 if numbered else 127)):
        value = tag[lo:hi].partition(b"\0")[0].decode("latin-1").rstrip(" ")
        if value:
            found.tags[f"id3v1.{name}"] = value
    if numbered:
        found.tags["id3v1.track"] = str(tag[126])
    if tag[127] < 255 and any(tag[3:127]):
        found.tags["id3v1.genre"] = str(tag[127])


def _read_tags(data: bytes, found: Stream) -> int:
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        wide = data[at + 3] >= 4
        size = sum((b & 127) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        p, end = at + 10, min(len(data), at + 10 + size)
        while data[at + 3] == 2 and p + 6 <= end and data[p]:  # the old form has short heads
            n = int.from_bytes(data[p + 3 : p + 6], "big")
            _read_text(data[p : p + 3].decode("latin-1"), data[p + 6 : min(end, p + 6 + n)], found)
            p += 6 + n
        while data[at + 3] != 2 and p + 10 <= end and data[p]:
            raw = data[p + 4 : p + 8]
            n = sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if wide else int.from_bytes(raw, "big")
            _read_text(data[p : p + 4].decode("latin-1"), data[p + 10 : min(end, p + 10 + n)], found)
            p += 10 + n
        at = end
    return at


_CHECKED: dict[bytes, int] = {}


def _checksum(covered: bytes) -> int:
    if covered not in _CHECKED:
        if len(_CHECKED) > 50_000:
            _CHECKED.clear()
        _CHECKED[covered] = crc16(covered)
    return _CHECKED[covered]


def _checked(data: bytes, at: int, h: Header, body: int) -> bool:
    want = int.from_bytes(data[at + 4 : at + 6], "big")
    if h.layer == 3:
        return _checksum(data[at + 2 : at + 4] + data[at + 6 : body]) == want
    inside = data[at + 6 : at + h.length]
    bits = 16 + _protected_bits(h, data[at + 3] >> 4, inside)
    return bits <= 16 + 8 * len(inside) and _crc16_bits(data[at + 2 : at + 4] + inside, bits) == want


def _protected_bits(h: Header, mode: int, body: bytes) -> int:
    """The number of bits after the checksum that it covers in Layers I and II: allocations and, in Layer II, scale factor selections."""
    channels = 1 if h.mono else 2
    if h.layer == 1:
        widths = (4,) * 32
    elif h.version != 1:
        widths = (4,) * 4 + (3,) * 7 + (2,) * 19
    else:
        rate = h.kbps // channels
        widths = (4,) * 11 + (3,) * 12 + (2,) * 7 if rate >= 56 else (4,) * 2 + (3,) * (10 if h.hz == 32000 else 6)
        if h.hz == 48000 or rate <= 80:
            widths = widths[:27]
    bound = 4 * (mode & 3) + 4 if mode >> 2 == 1 else 32  # joint stereo shares allocations from there on
    if h.layer == 1:
        return sum(w * (channels if i < bound else 1) for i, w in enumerate(widths))
    value, size, at, chosen = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 512, 0, 0
    for i, w in enumerate(widths):
        for _ in range(channels if i < bound else 1):
            at += w
            if value >> size - at & (1 << w) - 1:
                chosen += 2 if i < bound else 2 * channels
    return at + chosen


def scan_stream(data: bytes) -> Stream:
    """Tags, table, frames and ancillary data of a stream."""
    found = Stream()
    at = _read_tags(data, found)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) >= 128 + at else len(data)
    if end < len(data):
        _read_last_tag(data[end:], found)
    locked: Header | None = None
    while at + 4 <= end:
        h = read_header(data[at : at + 4])
        good = h is not None and at + h.length <= end
        if good and locked is None and at + h.length < end:  # a lone match may be chance: the next must fit too
            after = read_header(data[at + h.length : at + h.length + 4])
            good = after is not None and (after.version, after.layer, after.hz) == (h.version, h.layer, h.hz)
        if not good or locked is not None and (h.version, h.layer, h.hz) != (locked.version, locked.layer, locked.hz):
            if locked is not None or not found.resyncs:
                found.resyncs += 1
            locked = None
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        body = at + 4 + 2 * h.checked + h.side
        if not found.offsets and found.vbr_frames < 0 and data[body : body + 4] in (b"Xing", b"Info"):
            flags = int.from_bytes(data[body + 4 : body + 8], "big")
            p = body + 8
            found.vbr_frames = int.from_bytes(data[p : p + 4], "big") if flags & 1 else -1
            p += 4 * (flags & 1)
            found.vbr_bytes = int.from_bytes(data[p : p + 4], "big") if flags & 2 else -1
            p += 2 * (flags & 2)
            found.vbr_toc = data[p : p + 100] if flags & 4 else b""
        elif not found.offsets and found.vbr_frames < 0 and h.layer == 3 and data[at + 36 : at + 40] == b"VBRI":
            found.vbr_bytes, found.vbr_frames, entries, _, width = struct.unpack(">IIHHH", data[at + 46 : at + 60].ljust(14, b"\0"))
            found.vbr_toc = data[at + 62 : min(at + h.length, at + 62 + entries * width)]
        else:
            if h.checked and not _checked(data, at, h, body):
                found.bad_checksums += 1
            found.offsets.append(at)
            found.samples += h.samples
            found.hz = found.hz or h.hz
            found.rates.add(h.kbps)
            found.ancillary.append(data[body : at + h.length])
        locked = h
        at += h.length
    return found


def decode(data: bytes) -> tuple[bytes, int, Stream]:
    """The padded payload, the length before padding, and the stream's index."""
    found = scan_stream(data)
    payload = b"".join(found.ancillary)[: int(found.tags.get("payload_bytes", "0"))]
    return payload, int(found.tags.get("data_bytes", "0")), found


def feature(found: Stream) -> str:
    """Exact duration and the seek index as one string."""
    seek = hashlib.sha256(struct.pack(f"<{len(found.offsets)}q", *found.offsets)).hexdigest()[:16]
    return f"mpeg frames={len(found.offsets)} samples={found.samples} hz={found.hz} kbps={min(found.rates, default=0)}-{max(found.rates, default=0)} table={found.vbr_frames} bad={found.bad_checksums} resyncs={found.resyncs} seek={seek}"


def _chunks(batch, columns, make, most: int = 1 << 23):
    import pyarrow as pa

    rows, held, lo = [], 0, 0
    for i in range(batch.num_rows):
        row, weight = make(i)
        rows.append(row)
        held += weight
        if held > most or i + 1 == batch.num_rows:
            values = [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(rows)), *values], ["doc_id", *(c for c, _ in columns)])
            rows, held, lo = [], 0, i + 1


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's UTF-8 bytes as a stream."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text")

            def make(i, texts=texts):
                media = encode((texts[i].as_py() or "").encode())
                return (media,), len(media)

            yield from _chunks(batch, [("media", pa.binary())], make)

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, media binary")


def index_media(media: DataFrame) -> DataFrame:
    """What is read back from stored streams: payload digests, duration, seek offsets of frames."""
    id_type = media.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        columns = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("seconds", pa.float64()), ("seek_offsets", pa.list_(pa.int64()))]
        for batch in batches:
            stored = batch.column("media")

            def make(i, stored=stored):
                data = stored[i].as_py() or b""
                payload, n, found = decode(data)
                row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature(found), found.seconds, found.offsets)
                return row, 500 + 8 * len(found.offsets)

            yield from _chunks(batch, columns, make)

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, seek_offsets array<bigint>"
    return media.select("doc_id", "media").mapInArrow(scan, f"doc_id {id_type}, {schema}")
