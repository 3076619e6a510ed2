"""Unsigned integers in BINARY columns. What lies past the end reads as 0, as in a cursor that has failed.

``uint`` and ``bits`` read one place, by expressions; ``words_folded`` and ``codes_folded`` read a column's bytes from end to end, by numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Head:
    """The first ``size`` bytes of files in a column, of which numbers at fixed places are read all at once by numpy, into the column ``numbers``.

    ``uint`` and what is made of it takes one in the place of a column, and tells it which places are wanted.
    """

    def __init__(self, column: str, numbers: str, size: int) -> None:
        self.bytes, self.numbers, self.size, self.places = F.col(column), numbers, size, {}

    def number(self, at: int, size: int, little: bool) -> Column:
        if at + size > self.size:
            raise ValueError("beyond the head")
        return F.get(F.col(self.numbers), F.lit(self.places.setdefault((at, size, little), len(self.places))))

    def read(self) -> Column:
        """The numbers, of the places wanted by now."""
        places, most = list(self.places), self.size

        @F.arrow_udf("array<bigint>")
        def numbers(column: pa.Array) -> pa.Array:
            parts = [(x or b"")[:most] for x in column.to_pylist()]
            lengths = np.array([len(x) for x in parts], np.int64)
            rows = np.frombuffer(b"".join(x.ljust(most, b"\0") for x in parts), np.uint8).reshape(-1, most)
            found = np.zeros((len(rows), len(places)), np.int64)
            for k, (at, size, little) in enumerate(places):
                for i in range(size):
                    found[:, k] |= rows[:, at + i].astype(np.int64) << 8 * (i if little else size - 1 - i)
                found[lengths < at + size, k] = 0
            return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(places), found.ravel())

        return numbers(self.bytes)


def _at(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def swapped(digits: Column, size: int) -> Column:
    """``size`` bytes as hexadecimal digits, last byte first."""
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def uint(data: Column | Head, at: int | Column, size: int, little: bool = True) -> Column:
    """The ``size``-byte unsigned integer at byte offset ``at``, as BIGINT (size up to 7)."""
    if isinstance(data, Head):
        return data.number(at, size, little)
    part = F.substring(data, _at(at).cast("int") + 1, F.lit(size))
    digits = F.hex(part)
    value = F.conv(swapped(digits, size) if little and size > 1 else digits, 16, 10).cast("bigint")
    return F.when((_at(at) >= 0) & (F.length(data) >= _at(at) + size), value).otherwise(F.lit(0).cast("bigint"))


def bits(data: Column, at: int | Column, n: int) -> Column:
    """``n`` bits (32 at most) from bit ``at`` on, the lowest bit of a byte first, as BIGINT; what lies past the end is 0."""
    at = _at(at).cast("int")
    digits = F.rpad(F.hex(F.substring(data, F.shiftright(at, 3) + 1, F.lit(5))), 10, "0")
    value = F.conv(once(digits, lambda x: swapped(x, 5)), 16, 10).cast("bigint")
    return F.call_function("shiftright", value, at % 8).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def u8(data: Column, at: int | Column) -> Column:
    return uint(data, at, 1)


def u16le(data: Column, at: int | Column) -> Column:
    return uint(data, at, 2)


def u32le(data: Column, at: int | Column) -> Column:
    return uint(data, at, 4)


def u16be(data: Column, at: int | Column) -> Column:
    return uint(data, at, 2, little=False)


def u32be(data: Column, at: int | Column) -> Column:
    return uint(data, at, 4, little=False)


#: What a polynomial of 31 over values read is taken modulo of, and values that are folded at once.
PRIME, BLOCK = 2**31 - 1, 4096


def _folded(data: Column, read: Callable[[bytes], tuple[Iterator[np.ndarray], int]]) -> Column:
    """Over the values that ``read`` gives of a row's bytes, in blocks of ``BLOCK`` at most, and as many zeros after them, acc * 31 + value modulo ``PRIME``."""
    powers = np.array([pow(31, BLOCK - 1 - k, PRIME) for k in range(BLOCK)], np.int64)

    @F.arrow_udf("bigint")
    def fold(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            acc, (blocks, zeros) = 0, read(x.as_py() or b"")
            for values in blocks:
                weighted = values.astype(np.int64) % PRIME * powers[BLOCK - len(values) :] % PRIME
                acc = (acc * pow(31, len(values), PRIME) + int(weighted.sum())) % PRIME
            out.append(acc * pow(31, zeros, PRIME) % PRIME)
        return pa.array(out, pa.int64())

    return fold(data)


def words_folded(data: Column, size: int, little: bool = True) -> Column:
    """All integers of 1, 2 or 4 bytes from end to end, and once past the end, folded; a word cut short reads as 0."""
    kind = f"{'<' if little else '>'}u{size}"

    def read(x: bytes) -> tuple[Iterator[np.ndarray], int]:
        n = len(x) // size
        return (np.frombuffer(x, kind, min(BLOCK, n - k), k * size) for k in range(0, n, BLOCK)), -(-len(x) // size) + 1 - n

    return _folded(data, read)


def codes_folded(data: Column, width: int) -> Column:
    """All codes of ``width`` bits, the lowest bit of a byte first, the last one filled with zeros, folded."""
    step = BLOCK // 8 * width  # bytes of BLOCK codes

    def read(x: bytes) -> tuple[Iterator[np.ndarray], int]:
        def codes(part: bytes) -> np.ndarray:
            found = np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")
            found = np.pad(found, (0, -len(found) % width)).reshape(-1, width)
            return found.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))

        return (codes(x[k : k + step]) for k in range(0, len(x), step)), 0

    return _folded(data, read)


def placed(places: str, pixels: str, each: int) -> Column:
    """The sum of pixels times where they stand, counted from 1 on; ``pixels`` holds ``each`` for one of the ``places``."""

    @F.arrow_udf("bigint")
    def weigh(at: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(at), 512):
            part = at[k : k + 512]
            ends = np.cumsum([0, *(len(x) for x in part)])
            rows = np.frombuffer(b"".join(values[k : k + 512].to_pylist()), np.uint8).reshape(-1, each).astype(np.int32)
            sums = part.flatten().to_numpy() * rows.sum(1) * each + rows @ np.arange(1, each + 1, dtype=np.int32)
            out.append(np.diff(np.concatenate([[0], np.cumsum(sums)])[ends]))
        return pa.array(np.concatenate(out) if out else [], pa.int64())

    return weigh(places, pixels)


def s16(value: Column) -> Column:
    """A 16-bit pattern read as signed."""
    return F.when(value >= 1 << 15, value - (1 << 16)).otherwise(value)


def s32(value: Column) -> Column:
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def hex_uint(value: Column, size: int, little: bool = True) -> Column:
    """An integer as ``2 * size`` hexadecimal digits in byte order: for building containers."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return swapped(digits, size) if little else digits


def text_prefix(data: Column | Head, at: int, size: int) -> Column:
    """``size`` bytes as hexadecimal digits, for comparing magic numbers."""
    return F.hex(F.substring(data.bytes if isinstance(data, Head) else data, at + 1, size))
