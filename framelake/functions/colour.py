"""Colour arithmetic: scaling of palette entries, YUV to RGB, and conversion of whole pixel buffers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def scale_6_to_8(v: Column) -> Column:
    return F.shiftleft(v, 2).bitwiseOR(F.shiftright(v, 4)).bitwiseAND(F.lit(255))


def scale_3_to_8(v: Column) -> Column:
    """Three bits of an Atari ST colour, the pattern repeated."""
    c = v.bitwiseAND(F.lit(7))
    return F.shiftleft(c, 5).bitwiseOR(F.shiftleft(c, 2)).bitwiseOR(F.shiftright(c, 1)).bitwiseAND(F.lit(255))


def rgb12(v: Column) -> Column:
    """A 12-bit colour as a struct of 8-bit r, g, b: each nibble twice."""
    nibble = lambda shift: F.shiftright(v, shift).bitwiseAND(F.lit(15)) * 17
    return F.struct(nibble(8).alias("r"), nibble(4).alias("g"), nibble(0).alias("b"))


def st_rgb(v: Column) -> Column:
    """An Atari ST palette word as a struct of 8-bit r, g, b."""
    return F.struct(*[scale_3_to_8(F.shiftright(v, s)).alias(c) for c, s in (("r", 8), ("g", 4), ("b", 0))])


def st_palette(words: Column, n_colours: int | Column) -> Column:
    """16 palette words as an array of r, g, b; entries from ``n_colours`` on are black."""
    black = F.struct(*[F.lit(0).alias(c) for c in "rgb"])
    return F.transform(words, lambda w, i: F.when(i < n_colours, st_rgb(w)).otherwise(black))


def half_bright(palette: Column) -> Column:
    """The extra half-brite palette: of up to 32 entries, each once more at half its brightness; more entries stay."""
    half = F.transform(palette, lambda p: F.struct(*[F.shiftright(p[c], 1).alias(c) for c in "rgb"]))
    return F.when(F.size(palette) <= 32, F.concat(palette, half)).otherwise(palette)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    """BT.601 limited range, in integers: a struct of r, g, b."""
    a, d, e = 298 * (y - 16) + 128, u - 128, v - 128
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(x, 8)))
    return F.struct(clamp(a + 409 * e).alias("r"), clamp(a - 100 * d - 208 * e).alias("g"), clamp(a + 516 * d).alias("b"))


def bitplane_pitch(width: Column) -> Column:
    """Bytes of a row of one plane: whole 16-bit words."""
    return F.shiftleft(F.shiftright(width + 15, 4), 1)


def convertible(source: Column, target: Column) -> Column:
    """Whether pixels of one format can become another: same, or towards more channels."""
    rank = lambda f: F.when(f == "indexed8", 0).when(f == "rgb888", 1).when(f == "rgba8888", 2)
    return F.coalesce(rank(source) <= rank(target), F.lit(False))


def _numpy_udf(step: Callable[..., bytes]) -> Callable[..., Column]:
    """A binary column of ``step`` over the bytes of a row's columns, null as empty ones: a row's pixels by one numpy operation."""

    @F.arrow_udf("binary")
    def convert(*columns: pa.Array) -> pa.Array:
        return pa.array([step(*(x.as_py() or b"" for x in row)) for row in zip(*columns, strict=True)], pa.binary())

    return convert


def _entries(palette: bytes, alpha: bool) -> np.ndarray:
    """256 entries of 3 or 4 bytes; those that the palette doesn't have are black."""
    table = np.full((256, 4 if alpha else 3), 255, np.uint8)
    table[:, :3] = np.frombuffer(palette[:768].ljust(768, b"\0"), np.uint8).reshape(256, 3)
    return table


def indexed_to_rgb(pixels: Column, palette: Column, alpha: bool = False) -> Column:
    """indexed8 pixels as rgb888 or rgba8888; an index past the palette is black."""
    known: dict[bytes, np.ndarray] = {}

    def step(p: bytes, colours: bytes) -> bytes:
        if colours not in known:
            known.clear()
            known[colours] = _entries(colours, alpha)
        return known[colours][np.frombuffer(p, np.uint8)].tobytes()

    return _numpy_udf(step)(pixels, palette)


def pixels_to_bits(pixels: Column) -> Column:
    """Pixels of one plane, eight a byte, the first one in the highest bit."""
    return _numpy_udf(lambda p: np.packbits(np.frombuffer(p, np.uint8)).tobytes())(pixels)


def rgb_to_rgba(pixels: Column) -> Column:
    def widen(p: bytes) -> bytes:
        out = np.full((len(p) // 3, 4), 255, np.uint8)
        out[:, :3] = np.frombuffer(p, np.uint8, len(p) // 3 * 3).reshape(-1, 3)
        return out.tobytes()

    return _numpy_udf(widen)(pixels)


def convert_pixels(pixels: Column, palette: Column, source: Column, target: str) -> Column:
    """A pixel buffer in another format; null where that can't be: towards fewer channels, or indexed without a palette."""
    same = F.when(source == target, pixels)
    if target == "rgb888":
        return F.coalesce(same, F.when((source == "indexed8") & palette.isNotNull(), indexed_to_rgb(pixels, palette)))
    if target == "rgba8888":
        return F.coalesce(same, F.when((source == "indexed8") & palette.isNotNull(), indexed_to_rgb(pixels, palette, alpha=True)), F.when(source == "rgb888", rgb_to_rgba(pixels)))
    return same
