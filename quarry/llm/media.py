"""Media columns in ISO base media containers.

`write_container` stores bytes as uncompressed video: frames of 8 x 8 pixels of three 8-bit samples
(192 bytes), sample entry `raw `, in a file of ftyp, mdat and moov boxes with full sample tables.
`read_container` walks the nested boxes of any such file, decodes the sample tables (stts, stsc,
stsz/stz2, stco/co64, stss) and gives codec, duration and the byte ranges of samples and keyframes; the
payload is not decoded. Fragmented files, whose samples are listed outside moov, are an error. Files have no times or names of their own, so equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import table, tune, written

SIDE, CHANNELS, RATE, CHUNK_FRAMES = 8, 3, 25, 16
#: In media columns every so many frames one is marked as a keyframe.
SYNC_EVERY = 12
FRAME = SIDE * SIDE * CHANNELS
PAD = b"\x20"
#: Boxes that hold boxes.
NESTED = frozenset((b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return struct.pack(">I4s", n, kind) + body if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes) -> bytes:
    """Up to a positive multiple of a frame."""
    return raw + PAD * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def write_container(payload: bytes, sync_every: int = 1, chunk_frames: int = CHUNK_FRAMES) -> bytes:
    """payload: whole frames. Every sync_every-th frame is a keyframe; at 1 all are, and stss is left out."""
    n = len(payload) // FRAME
    if n * FRAME != len(payload) or not n:
        raise ValueError("a payload is one frame or more")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    mdat = box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    starts = np.arange(first, first + len(payload), chunk_frames * FRAME)
    wide = starts[-1] >= 1 << 32
    offsets = full(b"co64" if wide else b"stco", struct.pack(">I", len(starts)), starts.astype(">u8" if wide else ">u4").tobytes())
    whole, rest = divmod(n, chunk_frames)
    runs = [(1, chunk_frames, 1)] * (whole > 0) + [(whole + 1, rest, 1)] * (rest > 0)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    sync = np.arange(1, n + 1, sync_every)
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        b"" if sync_every == 1 else full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        offsets,
    )
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    times = struct.pack(">QQIQ", 0, 0, RATE, n)
    mvhd = full(b"mvhd", times, struct.pack(">iH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2), version=1)
    tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), unity, struct.pack(">II", SIDE << 16, SIDE << 16), version=1, flags=3)
    mdhd = full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=1)
    hdlr = full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0")
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
    return ftyp + mdat + box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))


def walk(data: memoryview, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, first byte of the body, end) of every box, outer ones first. Sizes 0 (to the
    end) and 1 (64 bits) are known; a box that leaves its parent is an error."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError("a box is cut off")
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1:
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        n = n or end - at
        if n < head or at + n > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield (*path, kind), at + head, at + n
        if kind in NESTED:
            yield from walk(data, at + head, at + n, (*path, kind))
        at += n


def _numbers(data: memoryview, at: int, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _track(data: memoryview, boxes: dict[bytes, tuple[int, int]]) -> dict:
    u4 = lambda kind, at=4: struct.unpack_from(">I", data, boxes[kind][0] + at)[0]
    handler = bytes(data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in boxes else ""
    codec = bytes(data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16]).decode("latin-1")
    at = boxes[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    if b"stsz" in boxes:
        size, n = u4(b"stsz"), u4(b"stsz", 8)
        sizes = np.full(n, size, np.int64) if size else _numbers(data, boxes[b"stsz"][0] + 12, ">u4", n)
    else:  # compact sizes, of 4, 8 or 16 bits
        bits, n = u4(b"stz2") & 255, u4(b"stz2", 8)
        sizes = _numbers(data, boxes[b"stz2"][0] + 12, ">u2" if bits == 16 else ">u1", n if bits > 4 else -(-n // 2))
        if bits == 4:
            sizes = np.stack([sizes >> 4, sizes & 15], axis=1).reshape(-1)[:n]
    wide = b"co64" in boxes
    table_ = b"co64" if wide else b"stco"
    chunks = _numbers(data, boxes[table_][0] + 8, ">u8" if wide else ">u4", u4(table_))
    runs = _numbers(data, boxes[b"stsc"][0] + 8, ">u4", 3 * u4(b"stsc")).reshape(-1, 3)
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if each.sum() != n:
        raise ValueError("stsc and stsz differ")
    chunk_of = np.repeat(np.arange(len(chunks)), each)
    before = np.cumsum(sizes) - sizes
    first_of = np.cumsum(each) - each
    starts = chunks[chunk_of] + before - before[first_of[chunk_of]]
    steps = _numbers(data, boxes[b"stts"][0] + 8, ">u4", 2 * u4(b"stts")).reshape(-1, 2)
    if steps[:, 0].sum() != n:
        raise ValueError("stts and stsz differ")
    sync = _numbers(data, boxes[b"stss"][0] + 8, ">u4", u4(b"stss")) - 1 if b"stss" in boxes else np.arange(n)
    return {"codec": codec, "handler": handler, "timescale": scale, "duration": duration, "decoded": int((steps[:, 0] * steps[:, 1]).sum()), "starts": starts, "sizes": sizes, "keys": sync}


def read_container(media: bytes) -> list[dict]:
    """One dict per track: codec, handler, timescale, duration (both as declared), decoded (the sum of
    sample durations), starts and sizes of samples (bytes), keys (numbers of keyframes). Damaged and
    fragmented files are a ValueError."""
    data, tracks = memoryview(media), []
    for path, at, end in walk(data):
        if path in ((b"moof",), (b"moov", b"mvex")):
            raise ValueError("a fragmented file")
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak"):
            tracks[-1].setdefault(path[-1], (at, end))
    return [_track(data, t) for t in tracks]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """(first byte, end) of samples, those that touch joined."""
    ends = starts + sizes
    cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    return list(zip(starts[np.concatenate(([0], cut))].tolist(), ends[np.append(cut - 1, len(ends) - 1)].tolist(), strict=True)) if len(starts) else []


_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes and media, the container of the text's padded bytes.

    A null text counts as empty; an empty one is one frame of padding. Repeated rows stay repeated;
    other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            media = pa.array([write_container(padded(r), SYNC_EVERY) for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), media], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads a media column back. Per row: id, n_bytes, n_tracks, codec, duration (seconds), n_samples,
    n_keyframes, keyframes (byte ranges), and checksums of the stored form and of the payload found
    through its tables.

    Of several tracks the first one of pictures counts, else the first. Null media have nulls, a file
    without tracks has nulls but for its own size and checksum; a damaged or fragmented file is an error.
    """
    kind = media.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_bytes long, n_tracks long, codec string, duration double, n_samples long, n_keyframes long, keyframes array<struct<first:long,end:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    names = [x.split()[0] for x in shape.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), _RANGES, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def row(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * len(kinds)
        tracks = read_container(raw)
        stored = (len(raw), hashlib.sha256(raw).hexdigest())
        if not tracks:
            return (0, *(None,) * (len(kinds) - 3), *stored)
        t = next((t for t in tracks if t["handler"] == "vide"), tracks[0])
        payload = b"".join(raw[x:y] for x, y in ranges(t["starts"], t["sizes"]))
        keys = [{"first": x, "end": y} for x, y in ranges(t["starts"][t["keys"]], t["sizes"][t["keys"]])]
        return (len(tracks), t["codec"], t["decoded"] / t["timescale"], len(t["sizes"]), len(t["keys"]), keys, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(raw) for raw in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, shape).withColumnRenamed("id", id_col)


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    stored = written(media_column(table(tune(spark), sf_dir, "documents")), "media")
    found = features(stored)
    spans = F.concat_ws(",", F.transform("keyframes", lambda k: F.concat_ws("-", k["first"], k["end"])))
    feature = F.concat_ws("|", "codec", F.round("duration", 6), "n_samples", "n_keyframes", spans)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
