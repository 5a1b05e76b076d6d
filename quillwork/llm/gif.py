"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

`encode_samples` stores bytes losslessly as the pixels of an animation of 24 x 24 frames (8-bit indices into a global palette);
`decode` reads any GIF: variable-width LZW, local and global palettes, interlace, disposal methods, transparency and delays."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, utf8

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
#: Literal codes after a clear code while codes stay 9 bits wide: the decoder's table reaches 512 entries after 255 codes.
RUN = 252
DELAY = 4
#: Rows held at once by a Python worker.
ROWS = 64

_BITS = np.arange(9)


def palette() -> np.ndarray:
    """256 colours by rule: three bits of red, three of green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3], axis=1).astype(np.uint8)


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * ((-len(text)) % FRAME if text else FRAME)


def lzw_literals(frames: np.ndarray) -> list[bytes]:
    """Code streams of many frames of one size at once: every pixel is its own 9-bit code and a clear code comes before the width
    would grow, which is a valid stream and needs no search for repeats."""
    count, n = frames.shape
    parts = []
    for at in range(0, n, RUN):
        parts += [np.full((count, 1), 256), frames[:, at : at + RUN].astype(np.int64)]
    codes = np.concatenate([*parts, np.full((count, 1), 257)], axis=1)
    bits = (codes[:, :, None] >> _BITS & 1).astype(np.uint8).reshape(count, -1)
    packed = np.packbits(bits, axis=1, bitorder="little")
    return [row.tobytes() for row in packed]


def lzw_encode(pixels: bytes, depth: int) -> bytes:
    """The classic stream with growing table, for small pictures of few colours."""
    clear, end = 1 << depth, (1 << depth) + 1
    out, held, filled = bytearray(), 0, 0
    grown: dict[tuple[int, int], int] = {}
    width, following = depth + 1, end + 1

    def emit(code: int) -> None:
        nonlocal held, filled
        held |= code << filled
        filled += width
        while filled >= 8:
            out.append(held & 255)
            held >>= 8
            filled -= 8

    emit(clear)
    prefix = -1
    for p in pixels:
        if prefix < 0:
            prefix = p
        elif (prefix, p) in grown:
            prefix = grown[prefix, p]
        else:
            emit(prefix)
            if following < 4096:
                grown[prefix, p] = following
                if following == 1 << width and width < 12:
                    width += 1
                following += 1
            else:
                emit(clear)
                grown, width, following = {}, depth + 1, end + 1
            prefix = p
    if prefix >= 0:
        emit(prefix)
        if following == 1 << width and width < 12:
            width += 1
    emit(end)
    if filled:
        out.append(held & 255)
    return bytes(out)


def lzw_decode(data: bytes, depth: int, pixels: int) -> bytes:
    """Any stream: codes of growing width, clear codes anywhere, deferred clears, the code that is not yet in the table."""
    clear, end = 1 << depth, (1 << depth) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    entries, width, last = list(base), depth + 1, b""
    out, size, held, filled, at = [], 0, 0, 0, 0
    while size < pixels:
        while filled < width:
            if at >= len(data):
                return b"".join(out)
            held |= data[at] << filled
            filled += 8
            at += 1
        code = held & ((1 << width) - 1)
        held >>= width
        filled -= width
        if code == clear:
            entries, width, last = list(base), depth + 1, b""
            continue
        if code == end:
            break
        if code < len(entries):
            entry = entries[code]
        elif last and code == len(entries):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code outside the table")
        if last and len(entries) < 4096:
            entries.append(last + entry[:1])
            if len(entries) == 1 << width and width < 12:
                width += 1
        out.append(entry)
        size += len(entry)
        last = entry
    return b"".join(out)[:pixels]


def lzw_decode_many(streams: list[bytes], depth: int, pixels: int) -> list[bytes]:
    """Streams of equal length are unpacked at once on the supposition that they hold literals with timely clears; whatever does
    not turn out so, code by code, goes through the general decoder."""
    out: list[bytes | None] = [None] * len(streams)
    if depth == 8:
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(streams):
            by_size.setdefault(len(s), []).append(i)
        for size, at in by_size.items():
            raw = np.frombuffer(b"".join(streams[i] for i in at), np.uint8).reshape(len(at), size)
            n = size * 8 // 9
            bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : n * 9].reshape(len(at), n, 9)
            codes = bits.astype(np.int16) @ (1 << _BITS).astype(np.int16)
            clears = -(-pixels // RUN) if pixels else 0
            if n < pixels + clears + 1:
                continue
            where = np.arange(0, pixels + clears, RUN + 1)
            literal = np.ones(pixels + clears, bool)
            literal[where] = False
            body = codes[:, : pixels + clears]
            fine = (body[:, where] == 256).all(axis=1) & (body[:, literal] < 256).all(axis=1) & (codes[:, pixels + clears] == 257)
            shown = body[:, literal].astype(np.uint8)
            for k in np.flatnonzero(fine).tolist():
                out[at[k]] = shown[k].tobytes()
    return [lzw_decode(s, depth, pixels) if o is None else o for s, o in zip(streams, out, strict=True)]


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)) + b"\0"


_HEAD = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + palette().tobytes() + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
_FRAME_HEAD = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"


def encode_samples(payload: bytes) -> bytes:
    """A payload of a positive multiple of 576 bytes as an animation, a frame for each 576 bytes."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    out = [_HEAD]
    for at in range(0, len(frames), 256):
        out += [_FRAME_HEAD + _blocks(s) for s in lzw_literals(frames[at : at + 256])]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    transparent: int | None
    interlaced: bool
    local: np.ndarray | None
    depth: int
    stream: bytes
    indices: bytes = b""


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    frames: list[Frame]


def parse(data: bytes) -> Gif:
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def colours(flag: int) -> np.ndarray:
        nonlocal at
        size = 3 * (2 << (flag & 7))
        at += size
        return np.frombuffer(data, np.uint8, size, at - size).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    shared = colours(flags) if flags & 0x80 else None
    found, delay, disposal, transparent = [], 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            at += 2
            body = blocks()
            if label == 0xF9:
                control, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = control >> 2 & 7, index if control & 1 else None
        elif kind == 0x2C:
            left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            local = colours(own) if own & 0x80 else None
            depth = data[at]
            at += 1
            found.append(Frame(left, top, w, h, delay, disposal, transparent, bool(own & 0x40), local, depth, blocks()))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown GIF block")
    return Gif(width, height, background, shared, found)


def decode(data: bytes) -> Gif:
    """Parsed GIF with the colour indices of every frame, rows in order."""
    gif = parse(data)
    groups: dict[tuple[int, int], list[Frame]] = {}
    for f in gif.frames:
        groups.setdefault((f.depth, f.width * f.height), []).append(f)
    for (depth, pixels), frames in groups.items():
        for at in range(0, len(frames), 256):
            for f, indices in zip(frames[at : at + 256], lzw_decode_many([f.stream for f in frames[at : at + 256]], depth, pixels), strict=True):
                f.indices = _deinterlaced(indices.ljust(pixels, b"\0"), f) if f.interlaced else indices
    return gif


def _deinterlaced(indices: bytes, f: Frame) -> bytes:
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, f.height, step)]
    rows = {y: indices[i * f.width : (i + 1) * f.width] for i, y in enumerate(order)}
    return b"".join(rows[y] for y in range(f.height))


def canvases(gif: Gif) -> Iterator[np.ndarray]:
    """RGBA picture after each frame, by the palette, transparency and disposal rules."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        colours = f.local if f.local is not None else gif.palette if gif.palette is not None else palette()
        index = np.frombuffer(f.indices.ljust(f.width * f.height, b"\0"), np.uint8).reshape(f.height, f.width)
        shown = np.ones(index.shape, bool) if f.transparent is None else index != f.transparent
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        shown, index = shown[: area.shape[0], : area.shape[1]], index[: area.shape[0], : area.shape[1]]
        area[shown, :3] = colours[np.minimum(index[shown], len(colours) - 1)]
        area[shown, 3] = 255
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> list[int]:
    """64 bins, two bits of each colour, of the visible pixels."""
    seen = canvas[canvas[..., 3] > 0][:, :3] >> 6
    return np.bincount(seen[:, 0] * 16 + seen[:, 1] * 4 + seen[:, 2], minlength=64).tolist()



def whole_histogram(gif: Gif) -> np.ndarray:
    """The histograms of all canvases, summed. Frames that each cover the whole canvas opaquely are counted without drawing."""
    plain = gif.palette is not None and all(f.local is None and f.transparent is None and (f.left, f.top, f.width, f.height) == (0, 0, gif.width, gif.height) for f in gif.frames)
    if plain:
        colours = gif.palette.astype(np.int64) >> 6
        bins = colours[:, 0] * 16 + colours[:, 1] * 4 + colours[:, 2]
        counts = sum((np.bincount(np.frombuffer(f.indices, np.uint8), minlength=256) for f in gif.frames), np.zeros(256, np.int64))
        return np.bincount(bins, counts[: len(bins)], 64).astype(np.int64)
    return sum((np.array(histogram(c)) for c in canvases(gif)), np.zeros(64, np.int64))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a GIF column; null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, ROWS):
            texts = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_samples(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FRAMES = "doc_id long, frame int, at_ms long, delay_ms long, width int, height int, rgba binary, histogram array<int>"


def timed_frames(media: DataFrame) -> DataFrame:
    """media(doc_id, media) -> a row per frame: its start and duration, the drawn RGBA picture and its colour histogram.
    Null or unreadable media have no frames."""
    names = [x.split()[0] for x in _FRAMES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            gif = readable(b.column(1).to_pylist()[0])
            if gif is None:
                continue
            at = 0
            for k, (f, canvas) in enumerate(zip(gif.frames, canvases(gif), strict=True)):
                row = [b.column(0).to_pylist()[0], k, at, f.delay * 10, gif.width, gif.height, canvas.tobytes(), histogram(canvas)]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)
                at += f.delay * 10

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, _FRAMES)


_FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long, frame_starts_ms array<long>, histogram array<long>"


def readable(data: bytes | None) -> Gif | None:
    try:
        return decode(data) if data else None
    except (ValueError, IndexError, struct.error):
        return None


def read_back(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> payload facts from the decoded frames, facts of the stored form, and the feature: frames,
    duration in ms, and the 64-bin colour histogram of all frames, which the last columns hold one by one with each frame's start.

    Null or unreadable media give null payload facts, feature and frame columns; repeated rows give repeated rows."""
    names = [x.split()[0] for x in _FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, ROWS):
            rows = []
            for doc, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                gif = readable(data)
                stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                if gif is None:
                    rows.append((doc, n, None, None, None, *stored, *[None] * 5))
                    continue
                payload = b"".join(f.indices for f in gif.frames)
                starts, colours = list(accumulate((10 * f.delay for f in gif.frames), initial=0)), whole_histogram(gif).tolist()
                feature = f"{len(gif.frames)};{starts[-1]};{','.join(map(str, colours))}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature, len(gif.frames), starts[-1], starts[:-1], colours))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return media.mapInArrow(run, _FACTS)


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts give equal values; null and empty texts are one frame of padding; repeated rows give repeated rows; an empty
    table gives no rows; other columns are ignored."""
    return read_back(store(table(spark, sf_dir, "documents")))
