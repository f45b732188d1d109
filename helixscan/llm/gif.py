"""GIF as a media column: a writer and a reader of LZW code streams, frames and their colours.

``gif_column`` stores binary payloads as GIF files, a canvas of 64 samples by up to 256 rows for
each frame and 8 bits a sample.  ``read_gif`` reads any GIF: it decodes the code streams, applies
global or local palettes, interlacing, transparency and disposal, and gives the timed frames as
shown with a histogram of each colour channel.

The code widths after a clear code depend on the position alone, so that codes are packed and
unpacked with numpy; the writer looks strings up sample by sample, the reader resolves all codes up to a clear code at once.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import as_bytes, documents, restored, set_aside, slices

WIDTH, ROWS, DELAY_MS, BINS = 64, 256, 100, 8
#: A file that asks for a larger canvas, in pixels, is not decoded: its frames would not fit a task.
LARGEST = 1 << 24
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
#: The palette of stored payloads: three bits of a sample are red, three green and two blue.
_n = np.arange(256)
COLOURS = np.stack([(_n >> 5) * 255 // 7, (_n >> 2 & 7) * 255 // 7, (_n & 3) * 85], axis=1).astype(np.uint8)
FULL = 4096


def widths(size: int, n: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear code, for samples of ``size`` bits."""
    entries = (1 << size) + 1 + np.arange(n)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, size + 1, 12)


_schedule: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def schedule(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit positions of the codes between two clear codes."""
    if size not in _schedule:
        w = widths(size, FULL)
        _schedule[size] = w, np.concatenate([[0], np.cumsum(w)])
    return _schedule[size]


SHIFTED = [b << 8 for b in range(256)]


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples."""
    clear, end = 256, 257
    w, at = schedule(8)
    # Codes are held eight bits to the left, so that a sample makes a key of them.
    first, limit, literal = end + 1 << 8, FULL << 8, SHIFTED
    runs, table, free = [array("i")], {}, first
    add = runs[0].append
    if data:
        held = literal[data[0]]
        for b in memoryview(data)[1:]:
            key = held | b
            if key in table:
                held = table[key]
                continue
            add(held)
            table[key] = free
            held = literal[b]
            free += 256
            if free == limit:
                add(clear << 8)
                runs.append(array("i"))
                add = runs[-1].append
                table.clear()
                free = first
        add(held)
    add(end << 8)
    codes, bits, base = [np.array([clear])], [np.array([0])], int(w[0])
    for run in runs:
        codes.append(np.frombuffer(run, np.int32) >> 8)
        bits.append(base + at[: len(run)])
        base += int(at[len(run)])
    code, bit = np.concatenate(codes), np.concatenate(bits)
    shifted, place = code << (bit & 7), bit >> 3
    out = np.zeros((base + 7) // 8 + 3)
    for k in range(3):
        out += np.bincount(place + k, weights=(shifted >> 8 * k) & 255, minlength=len(out))[: len(out)]
    return out[: (base + 7) // 8].astype(np.uint8).tobytes()


class Strings:
    """The strings of a code stream since a clear code, all codes of a piece at once.

    The entry that a code makes is what that code gave and one sample more, so that it lies in the samples given so
    far: its code is resolved by following it to earlier and earlier samples, twice as far in each step."""

    def __init__(self, clear: int):
        self.clear, self.new = clear, clear + 2
        self.given = self.starts = self.lengths = None

    def first(self, code: np.ndarray) -> bytes:
        """Samples of the codes that follow a clear code, at most ``FULL``."""
        number = np.arange(len(code))
        entry = code - self.new
        bad = np.flatnonzero((entry >= number) | (code >= self.clear) & (code < self.new) | (number == 0) & (code >= self.clear))
        if len(bad):
            raise ValueError(f"code {code[bad[0]]} before it is known")
        known = entry >= 0
        before = np.where(known, entry, number)
        lengths, doublings = known.astype(np.int64), 1
        while (more := lengths[before]).any():
            lengths += more
            before = before[before]
            doublings += 1
        lengths += 1
        starts = np.cumsum(lengths) - lengths
        source = np.arange(int(lengths.sum())) + np.repeat(np.where(known, starts[np.maximum(entry, 0)] - starts, 0), lengths)
        # A sample is at most twice as many steps from its literal as its string has samples.
        for _ in range(doublings + 1):
            source = source[source]
        literal = np.zeros(len(source), np.uint8)
        literal[starts[~known]] = code[~known]
        self.given, self.starts, self.lengths = literal[source], starts, lengths
        return self.given.tobytes()

    def later(self, code: np.ndarray) -> bytes:
        """Samples of codes that follow ``FULL`` others: no entry is new."""
        entry = code - self.new
        known = entry >= 0
        if (~known & (code >= self.clear)).any():
            raise ValueError("code before it is known")
        lengths = np.where(known, self.lengths[np.maximum(entry, 0)] + 1, 1)
        ends = np.cumsum(lengths)
        source = np.arange(int(ends[-1])) + np.repeat(np.where(known, self.starts[np.maximum(entry, 0)], 0) - ends + lengths, lengths)
        out = self.given[np.where(np.repeat(known, lengths), source, 0)]
        out[(ends - lengths)[~known]] = code[~known]
        return out.tobytes()


def lzw_decode(stream: bytes, size: int) -> bytes:
    """Samples of a code stream; one that breaks off gives what came before, and an impossible code is an error."""
    if not 2 <= size <= 8:
        raise ValueError(f"codes for samples of {size} bits")
    clear, end = 1 << size, (1 << size) + 1
    data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int64)
    total = 8 * len(stream)
    w, at = schedule(size)
    strings, out = Strings(clear), []
    bit = used = 0  # used: codes since the last clear code
    while bit + size < total:
        if used < FULL:
            width, offset = w, at[:-1]
        else:  # a full table that is not cleared stays as it is
            width, offset = np.full(FULL, 12), np.arange(FULL) * 12
        n = int(np.searchsorted(offset + width, total - bit, "right"))
        if not n:
            break
        pos, width = bit + offset[:n], width[:n]
        first = pos >> 3
        code = ((data[first] | data[first + 1] << 8 | data[first + 2] << 16) >> (pos & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((code == clear) | (code == end))
        k = int(stops[0]) if len(stops) else n
        if k:
            out.append(strings.later(code[:k]) if used else strings.first(code[:k]))
        if k < n:
            bit = int(pos[k]) + int(width[k])
            if code[k] == end:
                break
            used = 0
        elif n < FULL:
            break
        else:
            bit = int(pos[n - 1]) + int(width[n - 1])
            used += n
    return b"".join(out)


def blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(p := stream[i : i + 255])]) + p for i in range(0, len(stream), 255)) + b"\0"


def write_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """``samples`` (a positive multiple of ``width``) as frames of at most ``rows`` rows, a fixed colour for each value."""
    height = min(len(samples) // width, rows)
    size = lambda a, b: a.to_bytes(2, "little") + b.to_bytes(2, "little")
    out = [b"GIF89a", size(width, height), b"\xf7\0\0", COLOURS.tobytes()]
    for i in range(0, len(samples), width * rows):
        part = samples[i : i + width * rows]
        out += [b"!\xf9\x04\x04", (delay_ms // 10).to_bytes(2, "little"), b"\0\0", b",\0\0\0\0", size(width, len(part) // width), b"\0\x08", blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    samples: np.ndarray  # colour numbers as stored, height x width
    shown: np.ndarray  # the canvas, height x width x 3

    def histogram(self, bins: int = BINS) -> list[int]:
        """Pixels of the canvas by level of red, then of green and of blue."""
        level = self.shown.reshape(-1, 3) >> (8 - bins.bit_length() + 1)
        return np.concatenate([np.bincount(level[:, c], minlength=bins) for c in range(3)]).tolist()


def frames_of(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF as shown, one after the other; raises ``ValueError`` if the file is damaged or cut off."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    word = lambda i: int.from_bytes(data[i : i + 2], "little")
    width, height, flags, back = word(6), word(8), data[10], data[11]
    at = 13
    if width * height > LARGEST:
        raise ValueError(f"a canvas of {width} x {height}")

    def colour_table(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        at += 3 * n
        if at > len(data):
            raise ValueError("cut off")
        return np.frombuffer(data, np.uint8, 3 * n, at - 3 * n).reshape(n, 3)

    palette = colour_table(flags & 7) if flags & 0x80 else GREY
    ground = palette[back] if back < len(palette) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = ground
    delay, disposal, clear_colour = 0, 0, -1

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        if at >= len(data):
            raise ValueError("cut off")
        at += 1
        return b"".join(parts)

    while True:
        if at >= len(data):
            raise ValueError("cut off")
        if data[at] == 0x3B:
            return
        kind, label = data[at], data[at + 1] if at + 1 < len(data) else 0
        if kind == 0x21:
            at += 2
            body = sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                clear_colour = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        if at + 11 > len(data):
            raise ValueError("cut off")
        left, top, w, h, local = word(at + 1), word(at + 3), word(at + 5), word(at + 7), data[at + 9]
        if w * h > LARGEST:
            raise ValueError(f"a frame of {w} x {h}")
        at += 10
        colours = colour_table(local & 7) if local & 0x80 else palette
        if at >= len(data):
            raise ValueError("cut off")
        size = data[at]
        at += 1
        found = lzw_decode(sub_blocks(), size)
        if len(found) < w * h:
            raise ValueError("samples are missing")
        samples = np.frombuffer(found[: w * h], np.uint8).reshape(h, w)
        if local & 0x40:  # interlaced: every 8th row, the 8ths from 4 on, the 4ths from 2 on, the rest
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = samples[: area.shape[0], : area.shape[1]]
        new = colours[np.minimum(seen, len(colours) - 1)]
        area[:] = new if clear_colour < 0 else np.where((seen == clear_colour)[..., None], area, new)
        yield Frame(left, top, w, h, delay, disposal, samples, canvas.copy())
        if disposal == 2:
            area[:] = ground
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_colour = 0, 0, -1


def read_gif(data: bytes) -> list[Frame]:
    return list(frames_of(data))


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    return data + bytes(max(1, -(-len(data) // unit)) * unit - len(data))


def gif_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stores each whole text: ``doc_id, n_bytes, media`` (a GIF of its UTF-8, zero bytes at its end
    to a positive multiple of 64).  A null text counts as empty; repeated rows repeat; an empty table
    gives an empty table; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data = as_bytes(batch.column("text"))
                media = [write_gif(padded(x)) for x in data]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


NUMBERS = ("number", "left", "top", "width", "height", "delay_ms", "disposal")
FRAME = StructType([*(StructField(n, IntegerType()) for n in NUMBERS), StructField("histogram", ArrayType(IntegerType()))])
READ = [
    StructField("frames", ArrayType(FRAME)), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()), StructField("media_sha256", StringType()),
]


def frame_columns(media: DataFrame) -> DataFrame:
    """Reads a ``media`` column of GIFs: adds ``frames`` (an array of timed frames with their colour
    histograms) and digests of the stored file and of the samples read back.  A file that is null, damaged, cut off
    or larger than ``LARGEST`` pixels has null in the new columns; repeated files repeat; an empty table gives an empty
    table; columns named like the new ones are replaced."""

    new = [f.name for f in READ]
    df = set_aside(media, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([*((n, pa.int32()) for n in NUMBERS), ("histogram", pa.list_(pa.int32()))])
        for whole in batches:
            for batch in slices(whole, "media"):
                rows: list[tuple] = []
                for x in batch.column("media").to_pylist():
                    listed, stored = [], []
                    try:
                        for i, f in enumerate(frames_of(x or b"")):
                            stored.append(f.samples.tobytes())
                            listed.append({"number": i, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "delay_ms": f.delay_ms, "disposal": f.disposal, "histogram": f.histogram()})
                    except ValueError:
                        rows.append((None,) * 6)
                        continue
                    payload = b"".join(stored)
                    rows.append((listed, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(x), hashlib.sha256(x).hexdigest()))
                types = [pa.list_(kinds), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                kept = [batch.column(c) for c in batch.schema.names if c != "media"]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                    names=[*(c for c in batch.schema.names if c != "media"), *new],
                )

    schema = StructType([*(f for f in df.schema.fields if f.name != "media"), *READ])
    return restored(df.mapInArrow(run, schema), [c for c in media.columns if c != "media"], *new)


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature``: frames, total time and the histogram summed over the frames."""
    return frame_columns(gif_column(documents(spark, sf_dir))).selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "concat(size(frames), ':', aggregate(frames, 0L, (s, f) -> s + f.delay_ms), ':', array_join(aggregate(frames, array_repeat(0L, 24), (s, f) -> zip_with(s, f.histogram, (a, b) -> a + b)), ',')) as feature",
    )
