"""Media columns: Ogg files of 8-bit samples (operator 8)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sievemill.llm.common import documents, map_texts, q

RATE = 8_000
BLOCK = 64
PACKET = 16_000
MAGIC = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
#: The first packet of a stream names its kind.
SAMPLES, COMMENT = b"\x80samples8", b"\x81comment"
_HEADER, _HEADER_SIZE = "<4sBBqIIIB", 27
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes aren't an Ogg file, or are damaged."""


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0, without a final inversion.

    That is zlib's CRC on bit-reversed bytes, reversed.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Writer:
    """One logical stream."""

    serial: int
    sequence: int = 0
    pages: list[bytes] = field(default_factory=list)
    _lacing: bytearray = field(default_factory=bytearray)
    _body: bytearray = field(default_factory=bytearray)
    _granule: int = -1
    _continued: bool = False

    def packet(self, data: bytes, granule: int) -> None:
        """granule: samples up to the end of the packet."""
        lacing = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while lacing:
            room = 255 - len(self._lacing)
            part, lacing = lacing[:room], lacing[room:]
            size = sum(part)
            self._lacing += part
            self._body += data[at : at + size]
            at += size
            if not lacing:
                self._granule = granule
            if len(self._lacing) == 255:
                self.flush(continues=bool(lacing))

    def flush(self, last: bool = False, continues: bool = False) -> None:
        if not self._lacing and not last:
            return
        flags = CONTINUED * self._continued | FIRST * (self.sequence == 0) | LAST * last
        head = struct.pack(_HEADER, MAGIC, 0, flags, self._granule, self.serial, self.sequence, 0, len(self._lacing))
        page = bytearray(head + self._lacing + self._body)
        page[22:26] = checksum(bytes(page)).to_bytes(4, "little")
        self.pages.append(bytes(page))
        self.sequence += 1
        self._lacing, self._body, self._granule, self._continued = bytearray(), bytearray(), -1, continues


def write(samples: bytes, comment: bytes = b"", rate: int = RATE) -> bytes:
    """An Ogg file with two logical streams, interleaved: unsigned 8-bit samples, and a comment."""
    sound, note = Writer(1), Writer(2)
    sound.packet(SAMPLES + struct.pack("<I", rate), 0)
    sound.flush()
    note.packet(COMMENT, 0)
    note.flush()
    note.packet(comment, len(samples))
    note.flush(last=True)
    for at in range(0, len(samples), PACKET):
        part = samples[at : at + PACKET]
        sound.packet(part, at + len(part))
    sound.flush(last=True)
    both = [sound.pages[0], note.pages[0], *note.pages[1:2], *sound.pages[1:], *note.pages[2:]]
    return b"".join(both)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of each packet that ends a page's completed packets, else None.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    last_granule: int = 0
    ended: bool = False
    _open: list[bytes] | None = None


def read(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number.  Raises OggError for a wrong checksum, a gap in the pages of a stream,
    a packet whose start or end is missing, or bytes that aren't in a page."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEADER_SIZE:
            raise OggError("truncated header")
        magic, version, flags, granule, serial, sequence, crc, count = struct.unpack_from(_HEADER, data, at)
        if magic != MAGIC or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise OggError("truncated page")
        page = data[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream(serial))
        if sequence != s.pages or s.ended:
            raise OggError(f"stream {serial} misses page {s.pages}")
        if bool(flags & CONTINUED) != (s._open is not None):
            raise OggError(f"stream {serial}: a packet without start or end")
        s.pages += 1
        s.ended = bool(flags & LAST)
        pos, start = at + 27 + count, at + 27 + count
        done = 0
        for size in lacing:
            pos += size
            if size < 255:
                s.packets.append(b"".join([*(s._open or []), data[start:pos]]))
                s.granules.append(None)
                s._open, start = None, pos
                done += 1
        if start < pos or (count and lacing[-1] == 255):
            s._open = [*(s._open or []), data[start:pos]]
        if done:
            s.granules[-1] = granule
            s.last_granule = granule
        at = end
    for s in streams.values():
        if s._open is not None or not s.ended:
            raise OggError(f"stream {s.serial} has no end")
    return streams


def samples_of(data: bytes) -> tuple[bytes, dict[str, float]]:
    """The samples of a file by write() and its features."""
    streams = read(data)
    sound = next((s for s in streams.values() if s.packets and s.packets[0].startswith(SAMPLES)), None)
    if sound is None:
        raise OggError("no stream of samples")
    (rate,) = struct.unpack("<I", sound.packets[0][len(SAMPLES) :])
    raw = b"".join(sound.packets[1:])
    if sound.last_granule != len(raw):
        raise OggError("the last granule position isn't the number of samples")
    wave = np.frombuffer(raw, dtype=np.uint8).astype(np.int64) - 128
    times = [g / rate for g in sound.granules if g is not None]
    return raw, {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()),
        "packets": sum(len(s.packets) for s in streams.values()),
        "seconds": sound.last_granule / rate,
        "last_page_start": times[-2] if len(times) > 1 else 0.0,
        "mean": float(wave.mean()) if len(wave) else 0.0,
        "rms": float(np.sqrt((wave * wave).mean())) if len(wave) else 0.0,
        "crossings": int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0))),
    }


def store(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with n_bytes (of the text in UTF-8) and media: an Ogg file of the text's bytes, padded with zero bytes to a
    positive multiple of BLOCK, as samples.  A null counts as empty; equal texts give equal files."""

    def run(texts: list[str]) -> dict[str, list]:
        raw = [x.encode() for x in texts]
        padded = [x.ljust(max(BLOCK, -(-len(x) // BLOCK) * BLOCK), b"\0") for x in raw]
        return {
            "n_bytes": [len(x) for x in raw],
            "media": [write(p, f"bytes={len(x)}".encode()) for x, p in zip(raw, padded, strict=True)],
        }

    added = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return map_texts(df, run, added, text, keep)


READ = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("media_error", T.StringType()),
    ]
)


def features(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """df without the media column, with what reading each file back gives.

    A null or damaged file isn't fatal: media_error says what is wrong, and the columns of the payload are null.
    Columns of the same names are replaced.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    names = READ.names
    kept = [c for c in (df.columns if keep is None else keep) if c != media and c not in names]
    source = df.select(*[F.col(q(c)) for c in kept], F.col(q(media)).alias("_media"))
    schema = T.StructType([source.schema[c] for c in kept] + READ.fields)

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6 + ("no media",)
        own = (len(data), hashlib.sha256(data).hexdigest())
        try:
            raw, found = samples_of(data)
        except (OggError, struct.error) as e:
            return (None, None, None, *own, None, str(e))
        text = ";".join(f"{k}={v}" if isinstance(v, int) else f"{k}={v:.6f}" for k, v in found.items())
        return (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-BLOCK:]), *own, text, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(len(kept))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            arrays = [batch.column(k) for k in range(len(kept))]
            arrays += [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + names)

    return source.mapInArrow(run, schema)


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    found = features(stored).where(F.col("media_error").isNull() | F.raise_error(F.col("media_error")).isNull())
    return found.drop("media_error")
