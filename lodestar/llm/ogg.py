"""Ogg media columns: pages, packets, logical streams and timestamps."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(data: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, start and final xor 0.

    It is the mirror image of the usual CRC-32, so zlib computes it over bytes
    whose bits are reversed: its own start and final xor of ones are undone.
    """
    c = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass(slots=True)
class Page:
    offset: int
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: memoryview


def pages(data: bytes) -> Iterator[Page | int]:
    """Pages whose checksum holds, in order; for each that doesn't, or is cut off, its offset.

    Bytes that belong to no page are skipped up to the next capture pattern; after
    a bad page the search goes on behind its capture pattern.
    """
    at, view = data.find(b"OggS"), memoryview(data)
    while at >= 0:
        if at + 27 > len(data):
            yield at
            return
        _, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version == 0 and len(lacing) == n and end <= len(data) and checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) == crc:
            yield Page(at, flags, granule, serial, sequence, lacing, view[at + 27 + n : end])
            at = end if data.startswith(b"OggS", end) else data.find(b"OggS", end)
        else:
            yield at
            at = data.find(b"OggS", at + 4)


@dataclass(slots=True)
class Packet:
    serial: int
    codec: str
    number: int
    sequence: int
    data: bytes
    granule: int | None
    seconds: float | None
    link: int = 0


def opus_samples(packet: bytes) -> int:
    """Length in samples at 48 kHz, from the configuration and frame count of the first bytes."""
    if not packet:
        return 0
    config, code = packet[0] >> 3, packet[0] & 3
    frame = (480, 960, 1920, 2880)[config % 4] if config < 12 else (480, 960)[config % 2] if config < 16 else (120, 240, 480, 960)[config % 4]
    return frame * (1, 2, 2, packet[1] & 63 if len(packet) > 1 else 0)[code]


def flac_samples(packet: bytes) -> int:
    """Block size in the header of a FLAC frame; 0 if it is none."""
    if len(packet) < 5 or packet[0] != 0xFF or packet[1] & 0xFC != 0xF8:
        return 0
    code = packet[2] >> 4
    if code == 1:
        return 192
    if 2 <= code <= 5:
        return 576 << code - 2
    if code >= 8:
        return 256 << code - 8
    if not code:
        return 0
    first = packet[4]  # the frame's or sample's number is coded like a UTF-8 character
    at = 5 + (0 if first < 0x80 else 7 - (first ^ 0xFF).bit_length())
    raw = packet[at : at + code - 5]
    return int.from_bytes(raw, "big") + 1 if len(raw) == code - 5 else 0


def vorbis_modes(setup: bytes) -> list[bool]:
    """Whether each mode has long blocks, read from the end of the setup header: modes of 41 bits behind their number, before the framing bit."""
    v = int.from_bytes(setup, "little")
    top, found, best = v.bit_length() - 1, [], []
    for n in range(1, 65):
        low = top - 41 * n
        if low < 6:
            break
        mode = v >> low & (1 << 41) - 1
        if mode >> 1 & 0xFFFFFFFF or mode >> 33 > 63:
            break
        found.insert(0, bool(mode & 1))
        if v >> low - 6 & 63 == n - 1:
            best = list(found)
    return best


@dataclass(slots=True)
class _Stream:
    link: int = 0
    codec: str = "unknown"
    rate: float = 0
    skip: int = 0
    shift: int = 0
    headers: int = 0
    part: bytearray = field(default_factory=bytearray)
    open: bool = False
    expect: int | None = None
    number: int = 0
    began: tuple[int, bytes] | None = None
    pages: int = 0
    frame: int = 0
    blocks: tuple[int, int] = (0, 0)
    modes: list[bool] = field(default_factory=list)
    last: int = 0

    def begin(self, p: bytes) -> None:
        """Codec and clock from the first packet of the stream."""
        try:
            if p.startswith(b"OpusHead"):
                self.codec, self.rate, self.skip, self.headers = "opus", 48000, struct.unpack_from("<H", p, 10)[0], 2
            elif p.startswith(b"\x01vorbis"):
                self.codec, self.rate, self.headers = "vorbis", struct.unpack_from("<I", p, 12)[0], 3
                self.blocks = (1 << (p[28] & 15), 1 << (p[28] >> 4))
            elif p.startswith(b"\x7fFLAC"):
                self.codec, self.rate = "flac", int.from_bytes(p[27:30], "big") >> 4
                self.headers = 1 + struct.unpack_from(">H", p, 7)[0]
            elif p.startswith(b"Speex   "):
                self.codec, self.rate, self.headers = "speex", struct.unpack_from("<I", p, 36)[0], 2
                self.frame = struct.unpack_from("<I", p, 56)[0] * max(1, struct.unpack_from("<I", p, 64)[0])
            elif p.startswith(b"\x80theora"):
                num, den = struct.unpack_from(">II", p, 22)
                self.codec, self.rate, self.headers = "theora", num / den if den else 0, 3
                self.shift = (p[40] & 3) << 3 | p[41] >> 5
            elif p.startswith(b"fishead\0"):
                self.codec = "skeleton"
        except (struct.error, IndexError):
            self.codec = "unknown"

    def samples(self, p: bytes) -> int:
        """How much later than the packet before it a packet ends, in order of the stream; 0 if its codec doesn't say."""
        if self.codec == "opus":
            return opus_samples(p)
        if self.codec == "flac":
            return flac_samples(p)
        if self.codec == "vorbis" and self.modes and p and not p[0] & 1:
            mode = p[0] >> 1 & (1 << (len(self.modes) - 1).bit_length()) - 1
            now = self.blocks[self.modes[mode]] if mode < len(self.modes) else 0
            before, self.last = self.last, now
            return (before + now) // 4 if before else 0
        return self.frame

    def frames(self, granule: int) -> int:
        return (granule >> self.shift) + (granule & (1 << self.shift) - 1) if self.shift else granule

    def seconds(self, granule: int | None) -> float | None:
        if granule is None or granule < 0 or not self.rate:
            return None
        return max(0, self.frames(granule) - self.skip) / self.rate


def packets(data: bytes) -> tuple[list[Packet], dict[int | None, list[int]]]:
    """(packets, {serial: [good pages, lost pages, lost packets, late pages]}); bad pages count under None, as their serial can't be trusted.

    A packet is the run of lacing values to the first below 255 and may span
    pages of its stream. Where a page is missing the packet in the making is
    lost, and a continued page's first part with it. A page behind the one
    expected is a repetition or comes late; it counts as such and gives no
    packets. A first page in the middle begins the stream anew: its packets have
    the next link and are numbered from 0. The granule position of a
    page is that of the last packet that ends on it; those before it are placed
    by the lengths of Opus, FLAC, Vorbis and Speex packets, and Theora's, which
    are a frame each, have only their seconds. Headers are at zero.
    """
    streams: dict[int, _Stream] = {}
    count: dict[int | None, list[int]] = {}
    out: list[Packet] = []
    for page in pages(data):
        if isinstance(page, int):
            count.setdefault(None, [0, 0, 0, 0])[1] += 1
            continue
        s = streams.get(page.serial)
        tally = count.setdefault(page.serial, [0, 0, 0, 0])
        tally[0] += 1
        if s is not None and page.flags & FIRST:
            if s.pages == 1 and s.began == (page.sequence, bytes(page.body)):
                tally[3] += 1
                continue
            tally[2] += s.open
        if s is None or page.flags & FIRST:
            s = streams[page.serial] = _Stream(0 if s is None else s.link + 1)
            s.began = page.sequence, bytes(page.body)
        ahead = 0 if s.expect is None else page.sequence - s.expect & 0xFFFFFFFF
        if ahead >= 1 << 31:
            tally[3] += 1
            continue
        s.pages += 1
        if ahead:
            tally[1] += ahead
            tally[2] += s.open
            s.part, s.open = bytearray(), False
        s.expect = page.sequence + 1 & 0xFFFFFFFF
        skip = bool(page.flags & CONTINUED) and not s.open
        if s.open and not page.flags & CONTINUED:
            tally[2] += 1
            s.part, s.open = bytearray(), False
        done: list[Packet] = []
        long: list[int] = []
        at = run = 0
        for value in page.lacing:
            run += value
            if value < 255:
                if skip:
                    skip = False
                else:
                    p = bytes(page.body[at : at + run]) if not s.open else bytes(s.part + page.body[at : at + run])
                    if s.number == 0 and page.flags & FIRST:
                        s.begin(p)
                    if s.codec == "vorbis" and s.number == 2:
                        s.modes = vorbis_modes(p)
                    done.append(Packet(page.serial, s.codec, s.number, page.sequence, p, None, None, s.link))
                    long.append(s.samples(p) if s.number >= s.headers else 0)
                    s.number += 1
                s.part, s.open = bytearray(), False
                at, run = at + run, 0
        if run or page.lacing and page.lacing[-1] == 255:
            if not skip:
                s.part += page.body[at : at + run]
                s.open = True
        if page.granule >= 0 and done:
            g = page.granule
            done[-1].granule = g
            for k in range(len(done) - 1, 0, -1):
                if not long[k] and done[k].number >= s.headers:
                    break
                g -= long[k]
                done[k - 1].granule = max(0, g)
        for k, p in enumerate(done):
            if p.number < s.headers:
                p.granule = 0
            p.seconds = s.seconds(p.granule)
            if s.codec == "theora" and p.number >= s.headers and page.granule >= 0 and s.rate:
                p.seconds = max(0, s.frames(page.granule) - (len(done) - 1 - k)) / s.rate
        out += done
    for serial, s in streams.items():
        count[serial][2] += s.open
    return out, count


def lace(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def mux(streams: dict[int, list[tuple[bytes, int]]], target: int = 4096) -> bytes:
    """An Ogg file of logical streams {serial: [(packet, granule)]}; pages are closed at about ``target`` bytes and streams take turns.

    The first packet of each stream has a page of its own, before all others.
    """
    made: dict[int, list[bytes]] = {}
    for serial, items in streams.items():
        own = made[serial] = []
        lacing, body, granule, cont = bytearray(), bytearray(), -1, False

        def close(last: bool, own=own, serial=serial) -> None:
            nonlocal lacing, body, granule, cont
            flags = CONTINUED * cont | FIRST * (not own) | LAST * last
            raw = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, serial, len(own), 0, len(lacing)) + lacing + body)
            raw[22:26] = checksum(bytes(raw)).to_bytes(4, "little")
            own.append(bytes(raw))
            cont = bool(lacing) and lacing[-1] == 255
            lacing, body, granule = bytearray(), bytearray(), -1

        for k, (packet, g) in enumerate(items):
            values, at = lace(packet), 0
            for i, v in enumerate(values):
                if len(lacing) == 255:
                    close(False)
                lacing.append(v)
                body += packet[at : at + v]
                at += v
                if i == len(values) - 1:
                    granule = g
            if k == 0 or len(body) >= target:
                close(k == len(items) - 1)
        if lacing:
            close(True)
    turns = [p[0] for p in made.values() if p]
    most = max((len(p) for p in made.values()), default=0)
    return b"".join(turns + [p[i] for i in range(1, most) for p in made.values() if i < len(p)])


#: Bytes of text in a packet of the media made of documents, and its samples at 48 kHz.
PAYLOAD, SAMPLES = 960, 960


def of_document(doc_id: int, t: str, lang: str | None) -> bytes:
    """A media file that carries a document: an Opus-framed stream of its text and a Vorbis-framed one of its language.

    One file in 97 has a byte of its second half changed, so that a checksum fails.
    """
    raw = t.encode()
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 48000, 0, 0)
    audio = [(head, 0), (b"OpusTags" + struct.pack("<II", 0, 0), 0)]
    audio += [(b"\xf8" + raw[i : i + PAYLOAD], SAMPLES * (k + 1)) for k, i in enumerate(range(0, len(raw), PAYLOAD))]
    notes = [(b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 2, 44100, 0, 0, 0, 0xB8, 1), 0), (b"\x03vorbis", 0), (b"\x05vorbis", 0)]
    notes.append(((lang or "").encode(), 44100))
    serial = doc_id * 2 & 0xFFFFFFFE
    data = mux({serial: audio, serial + 1: notes})
    if doc_id % 97 == 13:
        at = len(data) // 2 + doc_id % max(1, len(data) // 2)
        at = min(at, len(data) - 1)
        data = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
    return data


def _made(batches):
    for b in batches:
        rows = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)
        media = [of_document(i, t, lang) if t is not None and i is not None else None for i, t, lang in rows]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])


def media_of(docs: DataFrame) -> DataFrame:
    """(doc_id, media): documents as Ogg files; null where the identifier or text is."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return slim.mapInArrow(util.frugal(_made), "doc_id bigint, media binary")


_PACKETS = "doc_id bigint, serial bigint, link int, codec string, packet bigint, page bigint, size bigint, granule bigint, seconds double, digest bigint, good_pages bigint, lost_pages bigint, lost_packets bigint, late_pages bigint, bad_pages bigint"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.float64(), *[pa.int64()] * 6]


def _demuxed(batches):
    names = [x.split()[0] for x in _PACKETS.split(", ")]
    for b in batches:
        for at in range(0, b.num_rows, 500):
            rows = []
            for i, media in zip(b.column("doc_id").slice(at, 500).to_pylist(), b.column("media").slice(at, 500).to_pylist(), strict=True):
                if media is None:
                    continue
                found, count = packets(media)
                bad = count.get(None, (0, 0, 0, 0))[1]
                for p in found:
                    rows.append((i, p.serial, p.link, p.codec, p.number, p.sequence, len(p.data), p.granule, p.seconds, xxhash.xxh3_64_intdigest(p.data) - (1 << 63), *count[p.serial], bad))
                if not found:
                    rows.append((i, *[None] * 9, 0, 0, 0, 0, bad))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), _KINDS, strict=True)], names)


def demux(media: DataFrame) -> DataFrame:
    """A row for each packet of each file in (doc_id, media): its stream, place, size, time and digest, with the counts of its stream.

    good_pages, lost_pages, lost_packets and late_pages (repeated or out of order,
    see packets) are of the stream; bad_pages, those
    whose checksum fails, of the file. A very long file is read whole, in one row's memory. A file without any packet, be it empty or
    no Ogg at all, has one row of nulls and counts; a null file has none. A null
    identifier stays null, repeated rows are each reported, an empty table gives
    no rows, and other columns, whatever their names, are not looked at. One pass, no shuffle.
    """
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(util.frugal(_demuxed), _PACKETS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux(media_of(util.table(spark, sf_dir, "documents")))
