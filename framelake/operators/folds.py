"""State that runs from frame to frame, as window functions over rows: one row a changed pixel, word or sample.

These are views for small frames and checks of the decoders; they partition by file and place, so they spread as wide
as the pixels do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry(ops: DataFrame, place: list[str], order: list[str], value: str) -> DataFrame:
    """Copy deltas: each place has, from a row on, its last value that isn't null (``pixel``)."""
    w = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ops.withColumn("pixel", F.last(value, ignorenulls=True).over(w))


def xor_fold(ops: DataFrame, place: list[str], order: list[str], word: str, clear: str) -> DataFrame:
    """XOR deltas: a row with ``clear`` begins anew (``segment``); ``folded`` is the XOR of the words since."""
    run = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    segments = ops.withColumn("segment", F.sum(F.col(clear).cast("bigint")).over(run))
    within = Window.partitionBy(*place, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("folded", F.bit_xor(word).over(within))


def running_sum(samples: DataFrame, place: list[str], order: list[str], delta: str, bits: int) -> DataFrame:
    """DPCM: samples are sums of deltas, modulo 2 to the ``bits`` (``sample``)."""
    w = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("sample", F.pmod(F.sum(F.col(delta).cast("bigint")).over(w), F.lit(1 << bits)))


def double_buffer(frames: DataFrame, place: list[str], order: list[str], swaps: str) -> DataFrame:
    """Which of two buffers a frame is drawn to (``buffer``): buffers swap after each frame with ``swaps``."""
    w = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("buffer", F.coalesce(F.sum(F.col(swaps).cast("bigint")).over(w), F.lit(0)) % 2)


def ham(pixels: DataFrame, row: list[str], x: str, op: str, value: Column, held: dict[str, Column], first: dict[str, int]) -> DataFrame:
    """Hold-and-modify as three carries: an operation 0 sets all channels to a palette entry, 1 blue, 2 red, 3 green."""
    w = Window.partitionBy(*row).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    out = pixels
    for channel, code in (("b", 1), ("r", 2), ("g", 3)):
        new = F.when(F.col(op) == 0, held[channel]).when(F.col(op) == code, value)
        out = out.withColumn(channel, F.coalesce(F.last(new, ignorenulls=True).over(w), F.lit(first[channel])))
    return out


def planes_to_pixels(bits: DataFrame, pixel: list[str], plane: str, bit: str) -> DataFrame:
    """Bit planes, one row a bit, gathered to pixels (``value``)."""
    return bits.groupBy(*pixel).agg(F.bit_or(F.call_function("shiftleft", F.col(bit).cast("bigint"), F.col(plane).cast("int"))).alias("value"))


def xor_planes(ops: DataFrame, screen: list[str], order: list[str], word: str, plane: str, planes: int) -> DataFrame:
    """XOR deltas over a screen's planes: after each row the word of every plane (``plane0`` and so on)."""
    run = Window.partitionBy(*screen).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    word_of = lambda k: F.bit_xor(F.when(F.col(plane) == k, F.col(word)).otherwise(0).cast("bigint")).over(run)
    return ops.withColumns({f"plane{k}": word_of(k) for k in range(planes)})


def words_to_chunky(planes: list[Column], width: int = 16) -> Column:
    """The pixels (an array) of ``width`` bits of each plane, the highest bit first; a plane's bit has the plane's number in a pixel."""
    bit = lambda k, x: F.shiftleft(F.shiftright(planes[k], width - 1 - x).bitwiseAND(F.lit(1).cast("bigint")), k)

    def pixel(x: int) -> Column:
        value = bit(0, x)
        for k in range(1, len(planes)):
            value = value.bitwiseOR(bit(k, x))
        return value

    # spelled out, as Spark compiles no lambdas
    return F.array(*[pixel(x) for x in range(width)])


def chunky(planes: np.ndarray) -> np.ndarray:
    """The pixels of planes' bytes, a row a plane, in order of their bits: as ``words_to_chunky``, of up to 8 planes at once."""
    bits = np.unpackbits(planes, axis=1)
    return np.bitwise_or.reduce(bits << np.arange(len(bits), dtype=np.uint8)[:, None], axis=0)


def with_pixels(rows: Iterable[tuple], block: int = 1 << 16) -> Iterator[tuple]:
    """Rows that end in the bytes of planes, with their pixels in the place of these: those of ``block`` bytes or more at once."""

    def turned() -> Iterator[tuple]:
        pixels, at = chunky(np.concatenate([row[-1] for row in held], axis=1)), 0
        for *row, planes in held:
            n = 8 * planes.shape[1]
            yield *row, pixels[at : at + n].tobytes()
            at += n

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[-1].size
        if size > block:
            yield from turned()
            held, size = [], 0
    if held:
        yield from turned()
