"""Media columns in Matroska: files written to and parsed from binary columns.

The parser walks EBML elements with variable-length ids and sizes (unknown
sizes of segments and clusters included), reads tracks, clusters, simple
blocks and block groups with Xiph, EBML and fixed-size lacing, and cues, and
gives a packet table: track, timestamp in nanoseconds, cluster, block, frame
within the block, lacing, keyframe, first byte and bytes.

Defined results: texts are stored whole, however long; null is empty; a payload has 64 bytes at least; equal
payloads, repeated rows among them, give equal files; a null file has null
packets; whatever is truncated or malformed raises ValueError and nothing
else, with the format's defaults for what a track may leave out; an empty
table gives no rows; the computed columns n_bytes and media replace input
columns of their name, and all others are carried along.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, release, unpacked

# The format's element ids (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that stand at the segment's level and so end a cluster of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Payload bytes are unsigned 8-bit samples of one channel; a frame is a packet of so many.
RATE, FRAME, LACE, CLUSTER_FRAMES = 8000, 1024, 8, 64
FRAME_MS = FRAME * 1000 // RATE
UNIT = 64


# --- writing


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (1 << 7 * width | n).to_bytes(width, "big")


def _element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(name: int, value: int) -> bytes:
    return _element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], kind: str) -> bytes:
    """The lacing's head: the number of frames less one, and their sizes but the last."""
    sizes, head = [len(f) for f in frames[:-1]], bytes([len(frames) - 1])
    if kind == "xiph":
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    if kind == "ebml":
        out = head + _size(sizes[0])
        for a, b in zip(sizes, sizes[1:], strict=False):
            step = b - a
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1))
            out += (1 << 7 * width | step + (1 << 7 * width - 1) - 1).to_bytes(width, "big")
        return out
    return head


def block(track: int, relative: int, frames: list[bytes], kind: str) -> bytes:
    """A simple block's body.  kind is one of LACINGS."""
    flags = 0x80 | LACINGS.index(kind) << 1
    return _size(track) + struct.pack(">hB", relative, flags) + (b"" if kind == "none" else _laced(frames, kind)) + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A file with one PCM track: blocks of up to eight frames, clusters of 64, a cue for each cluster.

    Blocks of equal frames have fixed-size lacing; where the last frame is
    shorter, even clusters have EBML lacing and odd ones Xiph.
    """
    head = _element(EBML, b"".join([_uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8), _element(DOC_TYPE, b"matroska"), _uint(DOC_VERSION, 4), _uint(DOC_READ_VERSION, 2)]))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"ionsift") + _element(WRITING_APP, b"ionsift"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = b"".join([_uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, 1), _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000), _element(CODEC_ID, b"A_PCM/INT/LIT"), audio])
    parts = [info, _element(TRACKS, _element(TRACK_ENTRY, entry))]
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    at, cues = sum(map(len, parts)), b""
    for c in range(0, len(frames), CLUSTER_FRAMES):
        body, start = [_uint(TIMESTAMP, c * FRAME_MS)], c * FRAME_MS
        for b in range(c, min(c + CLUSTER_FRAMES, len(frames)), LACE):
            own = frames[b : min(b + LACE, c + CLUSTER_FRAMES)]
            kind = "none" if len(own) == 1 else "fixed" if len({*map(len, own)}) == 1 else ("ebml", "xiph")[c // CLUSTER_FRAMES % 2]
            body.append(_element(SIMPLE_BLOCK, block(1, b * FRAME_MS - start, own, kind)))
        cues += _element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at)))
        parts.append(_element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + _element(SEGMENT, b"".join(parts) + _element(CUES, cues))


# --- parsing


@dataclass(frozen=True)
class Packet:
    track: int
    timestamp_ns: int
    cluster: int
    block: int
    frame: int
    lacing: str
    keyframe: bool
    offset: int
    size: int


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)  # where they start, from the segment's body on
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's position


def vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int | None, int]:
    """A variable-length number and where it ends; None if all its value bits are set (unknown).  keep: with its marker, as in ids."""
    if at >= end or not data[at]:
        raise ValueError("malformed variable-length number")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError("the data end within a number")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, where it starts, where its body starts, where it ends).  A cluster or segment of unknown size ends before the next element of its level, or with its parent."""
    while at < end:
        start = at
        name, at = vint(data, at, end, keep=True)
        size, at = vint(data, at, end)
        if size is None:
            if name not in (CLUSTER, SEGMENT):
                raise ValueError("unknown size where the format has none")
            stop = _level_end(data, at, end) if name == CLUSTER else end
        else:
            stop = at + size
            if stop > end:
                raise ValueError("an element exceeds its parent")
        yield name, start, at, stop
        at = stop


def _level_end(data: bytes, at: int, end: int) -> int:
    """Where the first element of the segment's level starts."""
    while at < end:
        start = at
        name, at = vint(data, at, end, keep=True)
        if name in TOP:
            return start
        size, at = vint(data, at, end)
        if size is None or at + size > end:
            raise ValueError("an element exceeds its parent")
        at += size
    return end


def _number(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise ValueError("a number of more than eight bytes")
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise ValueError("a float of neither four nor eight bytes")
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def _byte(data: bytes, at: int, end: int) -> int:
    if at >= end:
        raise ValueError("a block ends within its lace")
    return data[at]


def frame_ranges(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Of a block's body: track, relative time, flags, and the frames' (first byte, bytes)."""
    track, at = vint(data, at, end)
    if track is None or at + 3 > end:
        raise ValueError("a block without its head")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    kind = LACINGS[flags >> 1 & 3]
    if kind == "none":
        return track, relative, flags, [(at, end - at)]
    count, at = _byte(data, at, end) + 1, at + 1
    sizes: list[int] = []
    if kind == "fixed":
        if (end - at) % count:
            raise ValueError("frames of a fixed size don't fill their block")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if kind == "xiph":
                n = 0
                while (more := _byte(data, at, end)) == 255:
                    n, at = n + 255, at + 1
                n, at = n + more, at + 1
            else:
                width = 9 - _byte(data, at, end).bit_length()
                n, at = vint(data, at, end)
                if n is None:
                    raise ValueError("an unknown size in a lace")
                if k:
                    n += sizes[-1] - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames exceed their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, relative, flags, out


def _due(own: dict[int, tuple[int, int]], name: int, what: str) -> tuple[int, int]:
    if name not in own:
        raise ValueError(f"no {what}")
    return own[name]


def _track(data: bytes, a: int, b: int) -> tuple[int, dict]:
    """A track entry's number and settings; a sampling rate left out is the format's 8000."""
    own = {n: (x, y) for n, _, x, y in elements(data, a, b)}
    audio = {n: (x, y) for n, _, x, y in elements(data, *own[AUDIO])} if AUDIO in own else None
    rate = None if audio is None else _real(data, *audio[SAMPLING_FREQUENCY]) if SAMPLING_FREQUENCY in audio else 8000.0
    return _number(data, *_due(own, TRACK_NUMBER, "track number")), {
        "type": _number(data, *_due(own, TRACK_TYPE, "track type")), "codec": data[slice(*_due(own, CODEC_ID, "codec"))].decode("ascii"),
        "default_ns": _number(data, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0, "rate": rate, "bits": _number(data, *audio[BIT_DEPTH]) if audio and BIT_DEPTH in audio else None,
    }


def _cues(data: bytes, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    own = list(elements(data, a, b))
    time = _number(data, *_due({n: (x, y) for n, _, x, y in own}, CUE_TIME, "cue time"))
    for _, _, x, y in (e for e in own if e[0] == CUE_TRACK_POSITIONS):
        pos = {n: (p, q) for n, _, p, q in elements(data, x, y)}
        yield time, _number(data, *_due(pos, CUE_TRACK, "cue track")), _number(data, *_due(pos, CUE_CLUSTER_POSITION, "cue position"))


def parse(data: bytes) -> Media:
    media, blocks = Media(), 0
    tops = list(elements(data, 0, len(data)))
    if not tops or tops[0][0] != EBML:
        raise ValueError("no EBML head")
    for name, _, body, end in tops:
        if name != SEGMENT:
            continue
        for top, start, a, b in elements(data, body, end):
            if top == INFO:
                media.scale = next((_number(data, x, y) for n, _, x, y in elements(data, a, b) if n == TIMESTAMP_SCALE), media.scale)
            elif top == TRACKS:
                media.tracks.update(_track(data, x, y) for n, _, x, y in elements(data, a, b) if n == TRACK_ENTRY)
            elif top == CLUSTER:
                media.clusters.append(start - body)
                base = 0
                for n, _, x, y in elements(data, a, b):
                    if n == TIMESTAMP:
                        base = _number(data, x, y)
                        continue
                    if n == BLOCK_GROUP:
                        n, x, y = next(((BLOCK, p, q) for m, _, p, q in elements(data, x, y) if m == BLOCK), (0, 0, 0))
                    if n not in (SIMPLE_BLOCK, BLOCK):
                        continue
                    track, relative, flags, ranges = frame_ranges(data, x, y)
                    each = media.tracks.get(track, {}).get("default_ns", 0)
                    for k, (at, size) in enumerate(ranges):
                        media.packets.append(Packet(track, (base + relative) * media.scale + k * each, len(media.clusters) - 1, blocks, k, LACINGS[flags >> 1 & 3], n == SIMPLE_BLOCK and flags > 127, at, size))
                    blocks += 1
            elif top == CUES:
                media.cues += [c for n, _, x, y in elements(data, a, b) if n == CUE_POINT for c in _cues(data, x, y)]
    return media


def demux(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


# --- columns


def payload_of(text: str | None) -> bytes:
    """UTF-8, with zeros up to a positive multiple of 64 bytes."""
    own = (text or "").encode("utf-8")
    return own.ljust(max(UNIT, -(-len(own) // UNIT) * UNIT), b"\0")


@F.arrow_udf(T.BinaryType())
def _stored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([mux(payload_of(t.as_py())) for t in batch], pa.binary())
    release()


def stored(text: Column) -> Column:
    """The text's payload as a Matroska file."""
    return _stored(F.coalesce(text.cast("string"), F.lit("")))


PACKETS = T.ArrayType(T.StructType([T.StructField("track", T.LongType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("cluster", T.LongType()), T.StructField("block", T.LongType()), T.StructField("frame", T.LongType()), T.StructField("lacing", T.StringType()), T.StructField("keyframe", T.BooleanType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())]))


@F.arrow_udf(PACKETS)
def _packets(files: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [f.name for f in PACKETS.elementType.fields]
    kind = pa.list_(pa.struct([(n, pa.string() if n == "lacing" else pa.bool_() if n == "keyframe" else pa.int64()) for n in names]))
    for batch in files:
        yield pa.array([None if (x := f.as_py()) is None else [{n: getattr(p, n) for n in names} for p in parse(x).packets] for f in batch], kind)


def packets(media: Column) -> Column:
    """The packet table of a binary column of files; null for null."""
    return _packets(media)


def packet_table(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per packet: the key and the packet's fields."""
    return df.select(F.col(f"`{key}`").alias(key), F.explode(packets(F.col(f"`{media}`"))).alias("p")).select(key, "p.*")


def feature(data: bytes, media: Media) -> str:
    """Counts of the file's parts, the time its packets span, whether the cues meet clusters, and a CRC-32 of the packet table."""
    kinds = [sum(p.lacing == k and p.frame == 0 for p in media.packets) for k in LACINGS]
    table = b"".join(struct.pack("<7q", p.track, p.timestamp_ns, p.cluster, p.block, p.frame, p.offset, p.size) for p in media.packets)
    ends = max((p.timestamp_ns + media.tracks[p.track]["default_ns"] for p in media.packets if p.track in media.tracks), default=0)
    met = sum(pos in media.clusters for _, _, pos in media.cues)
    codecs = ",".join(t["codec"] for _, t in sorted(media.tracks.items()))
    return f"codec={codecs};clusters={len(media.clusters)};packets={len(media.packets)};" + ";".join(f"{k}={n}" for k, n in zip(LACINGS, kinds, strict=True)) + f";end_ms={ends // 1_000_000};cues={met};table={zlib.crc32(table):08x}"


DIGEST = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


@F.arrow_udf(DIGEST)
def _digest(files: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in files:
        rows = []
        for f in batch:
            data = f.as_py()
            media = parse(data)
            own = demux(data, media)
            rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, media)))
        cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=DIGEST.names)


def digests(media: Column) -> Column:
    """Payload read back from the packets, and the file: sizes, checksums, feature."""
    return _digest(media)


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """All input rows with n_bytes and the binary column ``media``.  A map: nothing is shuffled."""
    t = F.col(f"`{text}`")
    return unpacked(packed(docs, F.coalesce(F.octet_length(t.cast("string")), F.lit(0)).cast("long").alias("n_bytes"), stored(t).alias("media")), docs.columns, "n_bytes", "media")
