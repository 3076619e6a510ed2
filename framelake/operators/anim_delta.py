"""ANIM pictures with byte-vertical deltas (operation 5), over two buffers.

A delta changes the picture two frames before its own, as frames are drawn to two buffers in turn; a whole picture fills
both. So the state of a place is carried forward within a buffer and since the last whole picture, and the two buffers'
rows never meet. ``anim_shown`` paints the runs in order where a file lies, a row a frame and nothing shuffled.
``anim_screens`` makes a row for each place that a frame touches, with its bytes of all planes, and shuffles these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.chunks import iff_chunks_of, map_files
from framelake.operators.folds import double_buffer, with_pixels, words_to_chunky
from framelake.operators.frames import byte_run

RUNS = "path string, frame_index int, kind string, swaps boolean, segment int, plane int, column int, y int, data binary, error string"
SHOWN = "path string, frame_index int, segment int, buffer int, columns int, places array<int>, pixels binary"
PLANES = 8


def column_runs(delta: bytes, columns: int, planes: int, height: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(plane, column, first row, bytes downwards) of a delta: counts below 0x80 skip rows, above copy bytes, and 0 repeats one."""

    if len(delta) < 64:
        raise ValueError("delta without its table")
    for plane in range(planes):
        at = int.from_bytes(delta[4 * plane : 4 * plane + 4], "big")
        if not at:
            continue
        if at >= len(delta):
            raise ValueError("plane beyond the delta")
        try:
            for column in range(columns):
                y, count, at = 0, delta[at], at + 1
                for _ in range(count):
                    op = delta[at]
                    at += 1
                    if op == 0:
                        n, run, at = delta[at], delta[at + 1 : at + 2] * delta[at], at + 2
                        delta[at - 1]  # must be there, also if it is repeated no times
                    elif op < 0x80:
                        y += op
                        continue
                    else:
                        n = op & 0x7F
                        run, at = delta[at : at + n], at + n
                        if len(run) < n:
                            raise IndexError
                    if n and y < height:
                        yield plane, column, y, run[: height - y]
                    y = min(height, y + n)
        except IndexError:
            raise ValueError("delta cut short") from None


def shape_of(data: bytes) -> tuple[int, int, int] | None:
    """Columns, planes and height, of a file's first picture header."""
    heads = (head for _, kind, _, size, head in iff_chunks_of(data) if kind == "BMHD" and size >= 20)
    return next((((int.from_bytes(x[:2], "big") + 7) // 8, x[8], int.from_bytes(x[2:4], "big")) for x in heads), None)


def runs_of(data: bytes) -> Iterator[tuple]:
    """For each frame a row ``frame``, with what it draws to the next buffer or not, and its runs; a whole picture is a run a row and column."""
    frame, filled, shape, cleared, packed, operation, bits = -1, True, None, 0, 0, 0, 0
    for _, kind, at, size, head in iff_chunks_of(data):
        if kind in ("BMHD", "ANHD") and filled:
            frame, filled, operation, bits = frame + 1, False, 0, 0
        if kind == "BMHD" and size >= 20:
            packed = head[10]
            shape = shape or ((int.from_bytes(head[:2], "big") + 7) // 8, head[8], int.from_bytes(head[2:4], "big"))
        elif kind == "ANHD" and size >= 24:
            operation, bits = head[0], int.from_bytes(head[20:24], "big")
        elif kind in ("BODY", "DLTA") and frame >= 0:
            filled, body = True, data[at : at + size]
            try:
                if shape is None or not 0 < shape[1] <= PLANES:
                    raise ValueError("no picture header, or too many planes")
                columns, planes, height = shape
                if kind == "BODY":
                    cleared, whole = cleared + 1, columns * planes * height
                    body = byte_run(body, whole) if packed == 1 else body[:whole].ljust(whole, b"\0")
                    yield frame, "frame", False, cleared, None, None, None, None, None
                    for k in range(columns * planes):
                        yield frame, "body", False, cleared, k // columns, k % columns, 0, body[k :: columns * planes]
                        # one row a plane and column: the bytes of all picture rows, downwards
                elif operation != 5:
                    raise ValueError(f"operation {operation}")
                elif body:
                    runs = list(column_runs(body, columns, planes, height))
                    yield frame, "frame", bits != 2, cleared, None, None, None, None, None
                    for run in runs:
                        yield frame, "delta", bits != 2, cleared, *run
            except ValueError as error:
                yield frame, "error", False, cleared, None, None, None, None, str(error)
                return
        elif kind == "SBDY":
            filled = frame >= 0 or filled


def anim_runs(media: DataFrame) -> DataFrame:
    """``frame``, ``body``, ``delta`` and ``error`` rows of ANIM files; a file's rows end at its first error."""

    def walker(data: bytes) -> Iterator[tuple]:
        for row in runs_of(data):
            yield row if len(row) == 9 else (*row, None)

    return map_files(media, walker, RUNS)


def anim_screens(runs: DataFrame) -> DataFrame:
    """What the touched places hold when their frame is shown: ``y``, ``column`` (of 8 pixels), the bytes of the planes and the ``pixels``.

    A whole picture is drawn to both buffers, and shown from one. Places without a row since the last whole picture, in
    the frame's buffer, are 0.
    """
    frames = double_buffer(runs.where("kind = 'frame'").select("path", "frame_index", "swaps"), ["path"], ["frame_index"], "swaps")
    frames = frames.select("path", "frame_index", F.col("buffer").cast("int").alias("shown"))
    rows = runs.where("kind IN ('body', 'delta')").join(frames, ["path", "frame_index"])
    rows = rows.withColumn("buffer", F.explode(F.when(F.col("kind") == "body", F.array(F.lit(0), F.lit(1))).otherwise(F.array("shown"))))
    values = F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.ascii(F.decode(F.substring(F.col("data"), i, F.lit(1)), "iso-8859-1")))
    down = rows.where(F.length("data") > 0).select("path", "segment", "buffer", "shown", "frame_index", "column", "plane", F.col("y").alias("top"), F.posexplode(values).alias("i", "byte"))
    # grouped and carried within one exchange: dealt by file, picture and buffer
    dealt = down.repartition("path", "segment", "buffer")
    places = dealt.groupBy("path", "segment", "buffer", "frame_index", "shown", (F.col("top") + F.col("i")).alias("y"), "column").agg(
        *[F.max(F.when(F.col("plane") == k, F.col("byte"))).cast("bigint").alias(f"plane{k}") for k in range(PLANES)])
    run = Window.partitionBy("path", "segment", "buffer", "y", "column").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    carried = places.withColumns({f"plane{k}": F.coalesce(F.last(f"plane{k}", ignorenulls=True).over(run), F.lit(0).cast("bigint")) for k in range(PLANES)})
    pixels = words_to_chunky([F.col(f"plane{k}") for k in range(PLANES)], 8)
    return carried.where("buffer = shown").select("path", "segment", "buffer", "frame_index", "y", "column", *[f"plane{k}" for k in range(PLANES)], pixels.alias("pixels"))


def shown_of(data: bytes) -> Iterator[tuple]:
    """A row for each frame that draws: its segment, buffer, columns, the places touched, and the bytes of their planes."""
    columns, _, height = shape_of(data) or (0, 0, 0)
    buffers, views, swapped, last = [], [], 0, None

    def row(frame: int, swaps: bool, segment: int) -> Iterator[tuple]:
        nonlocal swapped
        shown, swapped = swapped % 2, swapped + swaps
        places = np.flatnonzero(views[2][0, order]).astype(np.int32) if views else ()
        if len(places):
            yield frame, segment, shown, columns, places, views[shown].take(order[places], axis=1)
            buffers[2][:] = bytes(columns * height)

    for frame, kind, swaps, segment, plane, column, y, run, *_ in runs_of(data):
        if kind in ("frame", "error"):
            if last:
                yield from row(*last)
            last = (frame, swaps, segment) if kind == "frame" else None
            continue
        if not views:  # two buffers and the touched places, column after column, so that a run is a slice
            buffers = [bytearray(n * columns * height) for n in (PLANES, PLANES, 1)]
            views = [np.frombuffer(x, np.uint8).reshape(-1, columns * height) for x in buffers]
            order = np.arange(columns * height).reshape(columns, height).T.ravel()
        at, n = column * height + y, len(run)
        buffers[2][at : at + n] = b"\1" * n
        at += plane * columns * height
        if kind == "body":
            buffers[0][at : at + n] = buffers[1][at : at + n] = run
        else:
            buffers[swapped & 1][at : at + n] = run
    if last:
        yield from row(*last)


def anim_shown(media: DataFrame) -> DataFrame:
    """What ``anim_screens`` tells, a row a frame: the touched ``places`` (y * columns + column) in order and 8 ``pixels`` for each. A frame that touches none has no row.

    A file is painted in its task, with two buffers of it in memory.
    """
    return map_files(media, lambda data: with_pixels(shown_of(data)), SHOWN)
