"""Payload forms of a bitset of completed offsets, and trackers for one partition.

The distributed form of progress are the runs and bitmaps of operators.offsets. These codecs exist for
payloads that leave Spark: a commit's metadata, and stored snapshots. They work on one snapshot at a
time; encode_snapshots() applies one to a frame by Arrow batches.

A plain snapshot is (base, bit_count, bits): bit k of the integer `bits` stands for offset base + k.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

MAX_METADATA = 4096
RAW, ZSTD = 0, 1
#: Words up to this many bytes are not compressed.
COMPRESS_OVER = 1024
_HEAD = struct.Struct("<bqii")


class Snapshot:
    """Bits from an offset on. Equal if base, length and bits are."""

    def __init__(self, base: int, bit_count: int, bits: int):
        if bit_count < 0 or bits >> bit_count:
            raise ValueError("bits beyond bit_count")
        self.base, self.bit_count, self.bits = base, bit_count, bits

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Snapshot) and (self.base, self.bit_count, self.bits) == (other.base, other.bit_count, other.bits)

    def __hash__(self) -> int:
        return hash((self.base, self.bit_count, self.bits))

    def raw(self, unit: int = 1) -> bytes:
        """Little-endian bytes, as many as the bits need in units of `unit` bytes."""
        size = -(-self.bit_count // (8 * unit)) * unit
        return self.bits.to_bytes(size, "little")

    def runs(self) -> Iterator[tuple[int, int]]:
        """(bit, length) from the first bit on."""
        text = bin(self.bits)[2:].zfill(self.bit_count)[::-1] if self.bit_count else ""
        at = 0
        while at < len(text):
            end = text.find("1" if text[at] == "0" else "0", at)
            end = len(text) if end < 0 else end
            yield int(text[at]), end - at
            at = end


def varint(n: int) -> bytes:
    if n < 0:
        raise ValueError("a varint is not negative")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


class Reader:
    """Takes a payload apart; reading past its end is an error."""

    def __init__(self, payload: bytes):
        self.payload, self.at = payload, 0

    def done(self) -> bool:
        return self.at >= len(self.payload)

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.payload):
            raise ValueError("the payload ends too early")
        self.at += n
        return self.payload[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def varint(self) -> int:
        value = shift = 0
        while shift < 35:
            b = self.byte()
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7
        raise ValueError("the varint is too long")

    def header(self) -> tuple[int, int]:
        return struct.unpack("<qi", self.take(12))


def _header(s: Snapshot) -> bytes:
    return struct.pack("<qi", s.base, s.bit_count)


def _from_bytes(base: int, bit_count: int, raw: bytes) -> Snapshot:
    return Snapshot(base, bit_count, int.from_bytes(raw, "little"))


class RawCodec:
    """The words as they are."""

    name = "raw"

    def encode(self, s: Snapshot) -> bytes:
        return _header(s) + s.raw(8)

    def decode(self, payload: bytes) -> Snapshot:
        r = Reader(payload)
        base, n = r.header()
        return _from_bytes(base, n, r.take(-(-n // 64) * 8))


class WordRuns:
    """(length, word) for each run of equal 64-bit words."""

    name = "word_runs"

    def encode(self, s: Snapshot) -> bytes:
        raw = s.raw(8)
        words = [raw[k : k + 8] for k in range(0, len(raw), 8)]
        out, at = [_header(s)], 0
        for k in range(1, len(words) + 1):
            if k == len(words) or words[k] != words[at]:
                out.append(varint(k - at) + words[at])
                at = k
        return b"".join(out)

    def decode(self, payload: bytes) -> Snapshot:
        r = Reader(payload)
        base, n = r.header()
        size, raw = -(-n // 64) * 8, bytearray()
        while len(raw) < size:
            times = r.varint()
            word = r.take(8)
            if times <= 0 or len(raw) + 8 * times > size:
                raise ValueError("runs of words don't fit the snapshot")
            raw += word * times
        return _from_bytes(base, n, bytes(raw))


class BitRuns:
    """The first bit, then the lengths of alternating runs."""

    name = "bit_runs"

    def encode(self, s: Snapshot) -> bytes:
        if not s.bit_count:
            return _header(s)
        return _header(s) + bytes([s.bits & 1]) + b"".join(varint(n) for _, n in s.runs())

    def decode(self, payload: bytes) -> Snapshot:
        r = Reader(payload)
        base, n = r.header()
        if not n:
            return Snapshot(base, 0, 0)
        bit, at, bits = r.byte() != 0, 0, 0
        while at < n:
            length = r.varint()
            if length <= 0 or at + length > n:
                raise ValueError("runs of bits don't fit the snapshot")
            if bit:
                bits |= ((1 << length) - 1) << at
            bit, at = not bit, at + length
        return Snapshot(base, n, bits)


def _equal_run(raw: bytes, at: int) -> int:
    """Length of the run of 0x00 or 0xFF bytes at a place; 0 if another byte stands there."""
    if raw[at] not in (0x00, 0xFF):
        return 0
    end = at + 1
    while end < len(raw) and raw[end] == raw[at]:
        end += 1
    return end - at


#: Longest run that three bytes of _run_bytes() hold.
LONGEST_RUN = (1 << 21) - 1


def _run_bytes(value: int, length: int) -> bytes:
    """A run's byte and length: bit 7 the value, bit 6 if a second byte follows, 6 + 7 + 8 bits."""
    if length > LONGEST_RUN:
        raise ValueError("the run is too long")
    out = [(0x80 if value else 0) | (0x40 if length >> 6 else 0) | length & 0x3F]
    if length >> 6:
        out.append((0x80 if length >> 13 else 0) | length >> 6 & 0x7F)
        if length >> 13:
            out.append(length >> 13)
    return bytes(out)


class ByteRuns:
    """Literals with their length, in turn with runs of 0x00 or 0xFF bytes of `least` or more."""

    name = "byte_runs"

    def __init__(self, least: int = 3):
        if least < 2:
            raise ValueError("a run has two bytes at least")
        self.least = least

    def encode(self, s: Snapshot) -> bytes:
        raw, out, at, start = s.raw(), [_header(s)], 0, 0
        while at < len(raw):
            run = min(_equal_run(raw, at), LONGEST_RUN)
            if run >= self.least:
                out.append(varint(at - start) + raw[start:at] + _run_bytes(raw[at], run))
                at += run
                start = at
            else:
                at += 1
        if start < len(raw):
            out.append(varint(len(raw) - start) + raw[start:])
        return b"".join(out)

    def decode(self, payload: bytes) -> Snapshot:
        r = Reader(payload)
        base, n = r.header()
        raw = bytearray()
        while not r.done():
            raw += r.take(r.varint())
            if not r.done():
                first = r.byte()
                length = first & 0x3F
                if first & 0x40:
                    second = r.byte()
                    length |= (second & 0x7F) << 6
                    if second & 0x80:
                        length |= r.byte() << 13
                raw += (b"\xff" if first & 0x80 else b"\x00") * length
        if len(raw) != -(-n // 8):
            raise ValueError("runs of bytes don't fit the snapshot")
        return _from_bytes(base, n, bytes(raw))


class PlainByteRuns:
    """Other bytes as they are; 0x00 and 0xFF always with the length of their run."""

    name = "plain_byte_runs"

    def encode(self, s: Snapshot) -> bytes:
        raw, out, at = s.raw(), bytearray(_header(s)), 0
        while at < len(raw):
            run = _equal_run(raw, at)
            out.append(raw[at])
            if run:
                out += varint(run)
            at += max(1, run)
        return bytes(out)

    def decode(self, payload: bytes) -> Snapshot:
        r = Reader(payload)
        base, n = r.header()
        raw = bytearray()
        while not r.done():
            b = r.byte()
            raw += bytes([b]) * (r.varint() if b in (0x00, 0xFF) else 1)
        if len(raw) != -(-n // 8):
            raise ValueError("runs of bytes don't fit the snapshot")
        return _from_bytes(base, n, bytes(raw))


class Compressed:
    """The bytes compressed by a codec of Arrow (zstd or lz4 blocks)."""

    def __init__(self, name: str):
        self.name, self.codec = name, pa.Codec("lz4_raw" if name == "lz4" else name)

    def encode(self, s: Snapshot) -> bytes:
        raw = s.raw()
        return _header(s) + (self.codec.compress(raw, asbytes=True) if raw else b"")

    def decode(self, payload: bytes) -> Snapshot:
        r = Reader(payload)
        base, n = r.header()
        size = -(-n // 8)
        raw = self.codec.decompress(payload[r.at :], decompressed_size=size, asbytes=True) if size else b""
        return _from_bytes(base, n, raw)


CODECS = {c.name: c for c in (RawCodec(), WordRuns(), BitRuns(), ByteRuns(), PlainByteRuns(), Compressed("zstd"), Compressed("lz4"))}


# --- a commit's metadata


def pack_words(head_offset: int, head_index: int, words: Iterable[int]) -> bytes:
    """Codec, head offset, head index, number of words, then the words: compressed if large and smaller so."""
    words = list(words)
    body = b"".join(struct.pack("<Q", w & 0xFFFFFFFFFFFFFFFF) for w in words)
    codec = RAW
    if len(body) > COMPRESS_OVER:
        small = zstandard.ZstdCompressor().compress(body)
        if len(small) < len(body):
            codec, body = ZSTD, small
    return _HEAD.pack(codec, head_offset, head_index, len(words)) + body


def unpack_words(payload: bytes) -> tuple[int, int, list[int]]:
    if len(payload) < _HEAD.size:
        raise ValueError("the payload is too short")
    codec, offset, index, count = _HEAD.unpack_from(payload)
    body = payload[_HEAD.size :]
    if count < 0:
        raise ValueError("a number of words is not negative")
    if codec == ZSTD:
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=8 * count)
    elif codec != RAW:
        raise ValueError(f"unknown codec {codec}")
    if len(body) != 8 * count:
        raise ValueError(f"{len(body)} bytes for {count} words")
    return offset, index, list(struct.unpack(f"<{count}q", body))


def encode_metadata(head_offset: int, head_index: int, words: Iterable[int], most: int = MAX_METADATA) -> str | None:
    """URL-safe base64 without padding; None if that is longer than `most`: then only the offset is committed."""
    text = base64.urlsafe_b64encode(pack_words(head_offset, head_index, words)).decode().rstrip("=")
    return text if len(text) <= most else None


def decode_metadata(text: str) -> tuple[int, int, list[int]]:
    return unpack_words(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))


def encode_snapshots(snapshots: DataFrame, most: int = MAX_METADATA) -> DataFrame:
    """snapshots (columns of schemas.SNAPSHOT among others) with `metadata`."""
    names = snapshots.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in snapshots.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(names.index(c)).to_pylist() for c in ("head_offset", "head_index", "words")]
            text = [encode_metadata(*row, most=most) for row in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*names, "metadata"])

    return snapshots.mapInArrow(run, f"{schema}, metadata string")


# --- trackers of one partition, for handlers that complete out of order


class SetTracker:
    """A set of completed offsets: the plainest form, which the others are held against."""

    def __init__(self, base: int):
        self.last, self.done = base, set()

    def mark(self, offset: int) -> None:
        if offset > self.last:
            self.done.add(offset)

    def processed(self, offset: int) -> bool:
        return offset <= self.last or offset in self.done

    def advance(self) -> int:
        while self.last + 1 in self.done:
            self.last += 1
            self.done.remove(self.last)
        return self.last


class BitTracker:
    """Completed offsets beyond the frontier as one integer's bits, bit 0 the next offset.

    A snapshot is head offset, index 0 and 64-bit words; restored bits suppress reprocessing.
    """

    def __init__(self, base: int, least_bits: int = 128):
        self.last, self.bits, self.least = base, 0, least_bits

    def mark(self, offset: int) -> None:
        if offset > self.last:
            self.bits |= 1 << (offset - self.last - 1)

    def processed(self, offset: int) -> bool:
        return offset <= self.last or bool(self.bits >> (offset - self.last - 1) & 1)

    def advance(self) -> int:
        ones = ((self.bits + 1) & ~self.bits).bit_length() - 1
        self.last += ones
        self.bits >>= ones
        return self.last

    @property
    def bit_capacity(self) -> int:
        need, size = self.bits.bit_length(), self.least
        while size < need:
            size *= 2
        return size

    def snapshot(self) -> tuple[int, int, list[int]]:
        raw = self.bits.to_bytes(self.bit_capacity // 8, "little")
        return self.last + 1, 0, list(struct.unpack(f"<{len(raw) // 8}q", raw))

    @classmethod
    def restore(cls, last: int, snapshot: tuple[int, int, list[int]]) -> BitTracker:
        head, index, words = snapshot
        if head > last + 1:
            raise ValueError("the snapshot's head is ahead of the first uncommitted offset")
        if len(words) < 2 or len(words) & (len(words) - 1) or not 0 <= index < len(words):
            raise ValueError("a ring has a power of two of words, two at least, and its head inside")
        turned = [w & 0xFFFFFFFFFFFFFFFF for w in (*words[index:], *words[:index])]
        bits = sum(w << 64 * k for k, w in enumerate(turned))
        made = cls(last)
        made.bits = bits >> (last + 1 - head)
        return made
