"""Media columns: MPEG audio.

scan() resynchronises on frame headers (MPEG 1, 2 and 2.5, layers I to III), reads ID3v1 and ID3v2 tags and the Xing/Info and
VBRI tables of variable-bitrate streams, verifies frames' CRC-16 checksums (over the header and layer I's allocation, layer II's allocation and
selection information, or layer III's side information), and gives exact durations (of all samples that the frames decode to, over their sampling
rates) and every frame's offset. What an encoder says that it padded stands beside. store() writes bytes losslessly as such a stream, and stored()
reads them back.

Null and empty contents have no frame; contents and rows that are alike give the same; empty tables stay empty.

A stream made by store() is MPEG 1 layer III, mono, 44.1 kHz, with checksums: an ID3v2 tag with the payload's length, an Info frame with
counts and a seek table, then frames whose side information announces no coded audio (they decode to silence) and whose main data area
holds the payload as ancillary data, at the highest bitrate but for the last frame, which takes the smallest that fits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.tables import documents
from leafloom.llm.text import blocks

# Fixed values of the format: kbit/s by (low sampling rate, layer), Hz by version.
KBITS = {
    (False, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (False, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (False, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (True, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (True, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (True, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSION = {3: "1", 2: "2", 0: "2.5"}
# Fixed values of the format: bits of a subband's allocation in layer II, by table.
ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}
#: The unit that texts are padded to.
UNIT = 64


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    checked: bool
    kbits: int
    hertz: int
    mono: bool
    size: int
    samples: int
    #: The first subband that both channels share.
    bound: int

    @property
    def kind(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.hertz

    @property
    def allocation(self) -> list[int]:
        """Bits of each subband's allocation in layers I and II."""
        if self.layer == 1:
            return [4] * 32
        each = self.kbits if self.mono else self.kbits // 2
        if self.version != 3:
            return ALLOCATION["low"]
        if each < 56:
            return ALLOCATION["d" if self.hertz == 32000 else "c"]
        return ALLOCATION["b" if each >= 96 and self.hertz != 48000 else "a"]

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The meaning of four bytes, or None if they aren't a frame header with a bitrate."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, hertz = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3 or word[3] & 3 == 2:
        return None
    low = version != 3
    kbits, hz, pad = KBITS[low, layer][rate - 1], HERTZ[version][hertz], word[2] >> 1 & 1
    if layer == 1:
        size, samples = (12000 * kbits // hz + pad) * 4, 384
    else:
        samples = 576 if low and layer == 3 else 1152
        size = samples // 8 * 1000 * kbits // hz + pad
    bound = ((word[3] >> 4 & 3) + 1) * 4 if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, kbits, hz, word[3] >> 6 == 3, size, samples, bound)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """Of all bits, or of the first so many."""
    c, whole = 0xFFFF, len(data) if bits is None else bits // 8
    for b in data[:whole]:
        c = (c << 8 ^ _CRC[c >> 8 ^ b]) & 0xFFFF
    for i in range(0 if bits is None else bits % 8):
        c = (c << 1 ^ (0x8005 if (c >> 15 ^ data[whole] >> 7 - i) & 1 else 0)) & 0xFFFF
    return c


def checksum(frame: bytes, h: Header) -> int:
    """What a protected frame's checksum ought to be."""
    if h.layer == 3:
        return crc16(frame[2:4] + frame[6 : 6 + h.side])
    channels, bits, used = 1 if h.mono else 2, 0, 0
    body = int.from_bytes(frame[6:262].ljust(256, b"\0"), "big")
    for band, width in enumerate(h.allocation):
        for _ in range(channels if band < h.bound else 1):
            given = body >> 2048 - bits - width & (1 << width) - 1
            bits += width
            used += (given > 0) * (1 if band < h.bound else channels)
    bits += 2 * used if h.layer == 2 else 0
    return crc16(frame[2:4] + frame[6 : 7 + bits // 8].ljust(1 + bits // 8, b"\0"), 16 + bits)


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    hertz: int = 0
    version: str = ""
    layer: int = 0
    skipped: int = 0
    checked: int = 0
    bad: int = 0
    table: str = ""
    told_frames: int | None = None
    seek: list[int] = field(default_factory=list)
    delay: int | None = None
    padding: int | None = None
    by_hertz: dict[int, int] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    kbits: dict[int, int] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return sum(n / hz for hz, n in self.by_hertz.items())


def _synchsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _text(b: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0] if b else 0, "latin-1")
    return b[1:].decode(kind, "replace").rstrip("\0")


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads a tag at the start; gives its length."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    major, flags, end = data[3], data[5], min(len(data), 10 + _synchsafe(data[6:10]) + (10 if data[5] & 16 else 0))
    body = data[10:end]
    if flags & 0x80 and major < 4:  # unsynchronised as a whole
        body = body.replace(b"\xff\0", b"\xff")
    at, wide = 0, major >= 3
    if flags & 0x40 and wide and len(body) >= 4:  # an extended header
        at = _synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + (10 if wide else 6) <= len(body) and body[at] != 0:
        form = 0
        if wide:
            name, n, form = body[at : at + 4], _synchsafe(body[at + 4 : at + 8]) if major == 4 else int.from_bytes(body[at + 4 : at + 8], "big"), body[at + 9]
        else:
            name, n = body[at : at + 3], int.from_bytes(body[at + 3 : at + 6], "big")
        at += 10 if wide else 6
        if name[:1] == b"T" and at + n <= len(body):
            value = body[at : at + n]
            if major == 4:
                value = value[4:] if form & 1 else value  # behind its length
                value = value.replace(b"\xff\0", b"\xff") if form & 2 else value
            key, value = name.decode("latin-1"), _text(value)
            if key in ("TXXX", "TXX") and "\0" in value:
                key, value = value.split("\0", 1)
            tags[key] = value
        at += n
    return end


def _vbr(frame: bytes, h: Header, s: Stream) -> bool:
    """Reads a Xing, Info or VBRI table; tells whether the frame is one."""
    at = 4 + (2 if h.checked else 0) + h.side
    if (name := frame[at : at + 4]) in (b"Xing", b"Info") and len(frame) >= at + 8:
        if frame[at + 120 : at + 124] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= at + 144:
            trims = int.from_bytes(frame[at + 141 : at + 144], "big")
            s.delay, s.padding = trims >> 12, trims & 4095
        s.table, flags, at = name.decode(), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            s.told_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        at += 4 if flags & 2 else 0
        if flags & 4:
            s.seek = list(frame[at : at + 100])
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        s.table, s.told_frames = "VBRI", int.from_bytes(frame[50:54], "big")
        entries, scale, width = struct.unpack(">HHH", frame[54:60])
        total = 0
        for i in range(entries):
            total += scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big")
            s.seek.append(total)
        return True
    return False


def _follow(data: bytes, at: int, end: int, h: Header, frames: int) -> bool:
    """Whether so many headers of h's kind, or the end, follow the frame at a place."""
    kind = h.kind
    for _ in range(frames):
        at += h.size
        if at == end:
            return True
        h = header(data[at : at + 4]) if at + 4 <= end else None
        if h is None or h.kind != kind:
            return False
    return True


def scan(data: bytes) -> Stream:
    """Reads a stream. Bytes that belong to no tag or whole frame are counted as skipped. Where the last frame doesn't end, a
    header counts as one only if another of the same version, layer and rate, or the end, follows its frame; three have to if the kind is
    not that of the frames before. version, layer and hertz are the last frame's."""
    s = Stream()
    at, end = _id3v2(data, s.tags), len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
            s.tags.setdefault(key, data[end + a : end + b].decode("latin-1").rstrip("\0 "))
    locked: tuple | None = None
    synced = False  # whether the last frame ended here
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is None or at + h.size > end:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            s.skipped += nxt - at
            at, synced = nxt, False
            continue
        if not synced or h.kind != locked:
            if not _follow(data, at, end, h, 1 if locked in (None, h.kind) else 3):
                s.skipped, at, synced = s.skipped + 1, at + 1, False
                continue
            locked, synced = h.kind, True
            s.version, s.layer, s.hertz = VERSION[h.version], h.layer, h.hertz
        if h.checked:
            s.checked += 1
            s.bad += checksum(data[at : at + h.size], h) != int.from_bytes(data[at + 4 : at + 6], "big")
        if not s.frames and not s.table and h.layer == 3 and _vbr(data[at : at + h.size], h, s):
            at += h.size
            continue
        s.frames, s.samples = s.frames + 1, s.samples + h.samples
        s.by_hertz[h.hertz] = s.by_hertz.get(h.hertz, 0) + h.samples
        s.kbits[h.kbits] = s.kbits.get(h.kbits, 0) + 1
        s.offsets.append(at)
        at += h.size
    s.skipped += end - at if at < end else 0
    return s


_SIDE = bytes(17)


def _frame(rate: int, body: bytes) -> bytes:
    """An MPEG 1 layer III mono frame of the rate'th bitrate whose main data area is body, filled up with zeros."""
    word = bytes((0xFF, 0xFA, rate << 4, 0xC4))
    return word + crc16(word[2:] + _SIDE).to_bytes(2, "big") + _SIDE + body + bytes(header(word).size - 23 - len(body))


#: Bytes that a frame of each bitrate holds.
_ROOM = {rate: header(bytes((0xFF, 0xFA, rate << 4, 0xC4))).size - 23 for rate in range(1, 15)}


def store(payload: bytes) -> bytes:
    most = _ROOM[14]
    full = [_frame(14, payload[i : i + most]) for i in range(0, len(payload) - most + 1, most)]
    if rest := payload[len(full) * most :]:
        full.append(_frame(next(r for r, n in _ROOM.items() if n >= len(rest)), rest))
    size, toc, at = sum(map(len, full)), bytearray(), 0
    for percent in range(100):
        at = (len(full) * percent // 100) * len(full[0]) if full else 0
        toc.append(min(255, at * 256 // size) if size else 0)
    info = b"Info" + (7).to_bytes(4, "big") + len(full).to_bytes(4, "big") + size.to_bytes(4, "big") + bytes(toc)
    text = b"\x03payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + bytes(_safe(len(text))) + b"\0\0" + text
    return b"".join([b"ID3\x04\0\0", bytes(_safe(len(tag))), tag, _frame(4, info), *full])


def _safe(n: int) -> tuple[int, int, int, int]:
    return n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127


def stored(data: bytes, s: Stream) -> bytes:
    """The payload of a stream that store() made, out of the frames that scan() found."""
    left, parts = int(s.tags.get("payload", "0")), []
    for at in s.offsets:
        h = header(data[at : at + 4])
        n = min(left, h.size - 23)
        parts.append(data[at + 23 : at + 23 + n])
        left -= n
    return b"".join(parts)


_PROBED = "frames long, samples long, hertz int, seconds double, version string, layer int, vbr_table string, vbr_frames long, seek_table array<long>, frame_offsets array<long>, encoder_delay long, encoder_padding long, crc_checked long, crc_bad long, skipped_bytes long, tags map<string,string>"


def probe(df: DataFrame, content: str = "content") -> DataFrame:
    """df with the columns of _PROBED for its binary column, in place of columns of those names. Nulls and bytes without a frame
    have 0 frames and seconds."""
    df = df.drop(*[c for c in df.columns if c in {p.split()[0] for p in _PROBED.split(", ")}])
    schema = df.select("*", *[F.lit(None).cast(p.split(" ", 1)[1]).alias(p.split()[0]) for p in _PROBED.split(", ")]).schema
    place = df.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [(s.frames, s.samples, s.hertz, s.seconds, s.version, s.layer, s.table, s.told_frames, s.seek, s.offsets, s.delay, s.padding, s.checked, s.bad, s.skipped, list(s.tags.items())) for s in (scan(x.as_py() or b"") for x in batch.column(place))]
            new = [pa.array([r[i] for r in rows], arrow.field(batch.num_columns + i).type) for i in range(16)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=arrow)

    return df.mapInArrow(run, schema)


def feature(s: Stream) -> str:
    seek = zlib.crc32(struct.pack(f"<{len(s.offsets)}Q", *s.offsets))
    rates = ",".join(f"{k}x{n}" for k, n in sorted(s.kbits.items()))
    return f"mpeg{s.version}-layer{s.layer};frames={s.frames};samples={s.samples};seconds={s.samples}/{s.hertz};table={s.table}:{s.told_frames};kbits={rates};crc={s.checked - s.bad}/{s.checked};skipped={s.skipped};seek={seek:08x}"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every text stored as an MPEG stream and read back. Nulls are empty texts, that is a payload of 64 zero bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "seconds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                rows = []
                for i in range(len(b)):
                    text = b.text(i)
                    media = store(text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text)))
                    s = scan(media)
                    back = stored(media, s)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.frames, s.seconds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, len(b)), *map(pa.array, zip(*rows, strict=True))], names)

    return documents(spark, sf_dir, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, seconds double")
