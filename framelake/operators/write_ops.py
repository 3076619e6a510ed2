"""FLC pictures as a table of write operations, and their replay by a window.

A table function gives a row an operation: where it writes, how much, and what. Operations lie in segments, which begin
with a write of the whole picture; ``until`` is the last frame that a write still matters for, so that a range of frames
needs the rows with ``frame_index <= last`` and ``until >= first`` only, which a Parquet scan is told by its filters.
Replay paints a file's operations in their order, in a stream that holds one picture.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from framelake.operators.chunks import flc_chunks_of, map_files
from framelake.operators.frame_index import flc_frames_of

OPS = "frame_index int, seq int, y int, x int, op string, count int, data binary, until int"


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def get(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("chunk cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.get(struct.calcsize(form)))[0]


Write = tuple[int, int, str, int, bytes]  # y, x, op, count, data


def _put(y: int, x: int, width: int, run: bytes, count: int) -> Write:
    """A run of bytes, or ``count`` times one or two of them."""
    size = len(run) if count == 1 else len(run) * count
    if x + size > width:
        raise ValueError("run past the row")
    if count == 1:
        return y, x, "copy", size, run
    return y, x, "fill" if len(set(run)) == 1 else "fill_words", count * (len(run) if len(set(run)) == 1 else 1), run[:1] if len(set(run)) == 1 else run


def _byte_runs(data: bytes, width: int, height: int) -> Iterator[Write]:
    c = _Bytes(data)
    for y in range(height):
        c.get(1)
        x = 0
        while x < width:
            n = c.number("<b")
            run, times = (c.get(1), n) if n >= 0 else (c.get(-n), 1)
            if times:
                yield _put(y, x, width, run, times)
            x += len(run) * times


def _lines(data: bytes, width: int, height: int) -> Iterator[Write]:
    c = _Bytes(data)
    first, n_lines = c.number("<H"), c.number("<H")
    if first + n_lines > height:
        raise ValueError("rows past the picture")
    for y in range(first, first + n_lines):
        x = 0
        for _ in range(c.number("<B")):
            x += c.number("<B")
            n = c.number("<b")
            run, times = (c.get(n), 1) if n >= 0 else (c.get(1), -n)
            if run:
                yield _put(y, x, width, run, times)
            x += len(run) * times


def _words(data: bytes, width: int, height: int) -> Iterator[Write]:
    c, y = _Bytes(data), 0
    for _ in range(c.number("<H")):
        packets = c.number("<H")
        while packets >= 0x4000:
            if packets >= 0xC000:
                y += 0x10000 - packets
            elif packets >= 0x8000 and y < height:
                yield y, width - 1, "fill", 1, bytes([packets & 255])
            else:
                raise ValueError("undefined row word")
            packets = c.number("<H")
        if y >= height:
            raise ValueError("rows past the picture")
        x = 0
        for _ in range(packets):
            x += c.number("<B")
            n = c.number("<b")
            run, times = (c.get(2 * n), 1) if n >= 0 else (c.get(2), -n)
            if run:
                yield _put(y, x, width, run, times)
            x += len(run) * times
        y += 1


def _whole(data: bytes, width: int, height: int) -> Iterator[Write]:
    if len(data) < width * height:
        raise ValueError("picture cut short")
    for y in range(height):
        yield y, 0, "copy", width, data[y * width : (y + 1) * width]


def _black(data: bytes, width: int, height: int) -> Iterator[Write]:
    for y in range(height):
        yield y, 0, "fill", width, b"\0"


# The chunks that write pixels, and those of them that write all.
WRITERS = {7: _words, 12: _lines, 13: _black, 15: _byte_runs, 16: _whole}
RESTARTS = (13, 15, 16)


def flc_ops_of(data: bytes) -> Iterator[tuple]:
    """A file's operations, segment by segment; then a row ``size`` with its width (x), height (y) and number of frames that can be shown, and one ``error`` if a chunk is broken."""
    if len(data) < 12:
        return
    width, height = struct.unpack_from("<HH", data, 8)
    chunks: dict[int, list[tuple[int, bytes]]] = {}
    for frame, _, kind, at, size in flc_chunks_of(data):
        chunks.setdefault(frame, []).append((kind, data[at : at + size]))
    held, shown, error = [], 0, None
    for frame, *_ in flc_frames_of(data):
        writes = [(kind, body) for kind, body in chunks.get(frame, ()) if kind in WRITERS]
        if any(kind in RESTARTS for kind, _ in writes):
            yield from ((*op, frame - 1) for op in held)
            held = []
        try:
            made = [w for kind, body in writes for w in WRITERS[kind](body, width, height)]
        except ValueError as e:
            error = (frame, 0, 0, 0, "error", 0, str(e).encode(), frame)
            break
        held += [(frame, seq, *w) for seq, w in enumerate(made)]
        shown = frame + 1
    yield from ((*op, max(shown - 1, 0)) for op in held)
    yield shown, 0, height, width, "size", shown, b"", max(shown - 1, 0)
    if error:
        yield error


@udtf(returnType=OPS)
class FlcOps:
    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from flc_ops_of(bytes(content) if content is not None else b"")


def write_ops(media: DataFrame) -> DataFrame:
    """``path`` and the operations of its FLC content: the rows of ``FlcOps``, in Arrow batches rather than one by one."""
    return map_files(media, flc_ops_of, f"path string, {OPS}")


def store_ops(ops: DataFrame, folder: str) -> None:
    """Writes operations so that the rows of a file, and within it of a range of frames, lie together."""
    ops.repartitionByRange("path", "until").sortWithinPartitions("path", "until", "frame_index", "seq").write.parquet(folder)


PICTURES = "path string, frame_index int, width int, height int, pixels binary"
#: Of pictures that a task holds as Python objects.
BATCH_BYTES = 4 << 20


def _painter(first: int, last: int | None):
    """Rows in order of file, frame and sequence, a file's size before its writes, to pictures: a task holds one picture and a batch."""

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        path, picture, width, height, at, end = None, None, 0, 0, 0, 0

        def packed() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in PICTURES.split(", ")])
            rows.clear()
            return out

        def show(until: int) -> Iterator[pa.RecordBatch]:
            """The pictures before frame ``until``."""
            nonlocal at
            while picture is not None and at < until:
                rows.append((path, at, width, height, bytes(picture)))
                at += 1
                if len(rows) * (len(picture) + 200) > BATCH_BYTES:
                    yield packed()

        for batch in batches:
            for file, frame, y, x, op, count, data in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if file != path:
                    yield from show(end)
                    path, picture = file, None
                if op == "size":
                    width, height, picture, at = x, y, bytearray(x * y), first
                    end = count if last is None else min(count, last + 1)
                elif picture is not None and y < height:
                    yield from show(min(frame, end))
                    run = data if op == "copy" else data * count
                    begin = y * width + x
                    run = run[: max(0, width - x)]
                    picture[begin : begin + len(run)] = run
        yield from show(end)
        yield packed()

    return paint


def replay(ops: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """The pictures (``path``, ``frame_index``, ``width``, ``height``, ``pixels``) of all frames, or of those from ``first`` to ``last``; a frame that can't be shown has none.

    Operations are read once, dealt by path and sorted; a task then paints them one after the other, a row a write and not a row a pixel.
    """
    rows = ops.where(F.col("op").isin("size", "copy", "fill", "fill_words") & (F.col("count") > 0))
    if first is not None:
        rows = rows.where(F.col("until") >= first)
    if last is not None:
        rows = rows.where((F.col("frame_index") <= last) | (F.col("op") == "size"))
    order = F.when(F.col("op") == "size", -1).otherwise(F.col("frame_index"))
    dealt = rows.select("path", order.alias("frame_index"), "seq", "y", "x", "op", "count", "data").repartition("path").sortWithinPartitions("path", "frame_index", "seq")
    return dealt.drop("seq").mapInArrow(_painter(first or 0, last), PICTURES)
