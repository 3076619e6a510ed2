"""Atari SEQ cels to pixels: a cel's runs are expanded where the file lies, and screens are folded from words there too, or by a window.

A screen is planes of 16-bit words. A cel writes a rectangle of them, plane by plane and column by column, and either
clears the screen first or is XOR with it. Every bit is written at most once by a cel, so a place is the XOR of all words
since the screen was cleared. ``seq_shown`` folds the words of a file in order, a row a cel and nothing shuffled; what
``seq_screens`` shuffles is a row for each place that a cel touches, with its words of all planes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.binary import once, u16be
from framelake.functions.colour import st_palette
from framelake.operators.chunks import map_files
from framelake.operators.folds import with_pixels, words_to_chunky
from framelake.operators.frame_index import seq_frames_of

# Width, height and planes of the three resolutions.
SCREENS = {0: (320, 200, 4), 1: (640, 200, 2), 2: (640, 400, 1)}
CELS = "path string, frame_index int, resolution int, palette binary, x int, y int, w int, h int, op int, storage int, size bigint, segment int, words array<int>, error string"
SHOWN = "path string, frame_index int, segment int, columns int, places array<int>, pixels binary"


def expand_runs(data: bytes, room: int) -> tuple[bytes, str | None]:
    """The words of a run-length stream, ``room`` at most and filled with zeros, and what is wrong with it.

    A count with its high bit set is followed by as many words, any other by one word to be repeated.
    """
    out, at, room = bytearray(), 0, 2 * room
    while at < len(data) and len(out) < room:
        if at + 2 > len(data):
            return bytes(out.ljust(room, b"\0")), "cut short at a count"
        n = int.from_bytes(data[at : at + 2], "big")
        at += 2
        if n & 0x8000:
            run = data[at : at + 2 * min(n & 0x7FFF, (room - len(out)) // 2)]
            wanted = 2 * min(n & 0x7FFF, (room - len(out)) // 2)
            at += 2 * (n & 0x7FFF)
        else:
            run, wanted = data[at : at + 2], 2
            at += 2
        if len(run) < wanted:
            return bytes((out + run[: len(run) // 2 * 2] * (n >= 0x8000)).ljust(room, b"\0")), "cut short in a run"
        out += run if n & 0x8000 else run * min(n, (room - len(out)) // 2)
    return bytes(out.ljust(room, b"\0")), None


def cels_of(data: bytes) -> Iterator[tuple]:
    """The rows of ``seq_cels`` of a file."""
    cleared, base = 0, None
    for n, at, size, *_ in seq_frames_of(data):
        resolution, x, y, w, h, op, storage = (*struct.unpack_from(">H", data, at + 2), *struct.unpack_from(">4H2B", data, at + 54))
        base, words, error = resolution if base is None else base, b"", None
        screen = SCREENS.get(base)
        body = data[at + 128 : at + size]
        if screen is None or resolution > 2 or op > 1 or storage > 1:
            error = "unknown resolution, operation or storage"
        elif len(body) < size - 128:
            error = "cel cut short"
        elif body and (x + w > screen[0] or y + h > screen[1]):
            error = "cel outside its screen"
        elif body and storage == 1:
            cleared += op == 0
            words, error = expand_runs(body, (w + 15) // 16 * h * screen[2])
        yield n, base, data[at + 4 : at + 36], x, y, w, h, op, storage, size - 128, cleared, np.frombuffer(words, ">u2").astype(np.int32), error
        if error:
            return


def seq_cels(media: DataFrame) -> DataFrame:
    """A row a cel: its header, the resolution of the file's first one, its palette of 16 words, its expanded ``words``, the number of times the screen was cleared up to it (``segment``), or its error.

    Empty and uncompressed cels change nothing and clear nothing. A cel that doesn't lie within its screen, or is cut short, has an
    ``error``; frames after it can't be shown, and have no rows.
    """
    return map_files(media, cels_of, CELS)


def shown_of(data: bytes) -> Iterator[tuple]:
    """A row for each cel that draws: its segment, the screen's columns, the places touched, and the bytes of their planes."""
    screen, segment, known = None, 0, {}
    for n, base, _, x, y, w, h, _, _, _, cleared, words, _ in cels_of(data):
        if not len(words):
            continue
        width, height, planes = SCREENS[base]
        wide, groups, first, shift = width // 16, (w + 15) // 16, x // 16, x % 16
        if screen is None or cleared != segment:
            screen, segment = np.zeros((planes, wide, height), np.uint16), cleared
        # words of a column, and what is shifted out of those of the column before
        cut, words = min(groups + (shift > 0), wide - first), words.reshape(planes, groups, h)
        screen[:, first : first + groups, y : y + h] ^= (words >> shift).astype(np.uint16)
        if shift:
            screen[:, first + 1 : first + cut, y : y + h] ^= (words[:, : cut - 1] << (16 - shift)).astype(np.uint16)
        if (cut, h) not in known:
            known = {(cut, h): (np.arange(h) * wide + np.arange(cut)[:, None]).ravel().astype(np.int32)}
        yield n, cleared, wide, known[cut, h] + np.int32(y * wide + first), screen[:, first : first + cut, y : y + h].astype(">u2").view(np.uint8).reshape(planes, -1)


def seq_shown(media: DataFrame) -> DataFrame:
    """What ``seq_screens`` tells of the cels of files, a row a cel: the touched ``places`` (y * columns + column) and 16 ``pixels`` for each. A cel that touches none has no row.

    A file is folded in its task, with one screen of it in memory.
    """
    return map_files(media, lambda data: with_pixels(shown_of(data)), SHOWN)


def seq_palettes(cels: DataFrame) -> DataFrame:
    """``path``, ``frame_index`` and ``palette``, the colours of the cel's 16 words; those that the resolution has no use for are black."""
    colours = F.when(F.col("resolution") == 0, 16).when(F.col("resolution") == 1, 4).otherwise(2)
    words = once(F.col("palette"), lambda p: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: u16be(p, i * 2).cast("int")))
    return cels.select("path", "frame_index", st_palette(words, colours).alias("palette"))


def seq_words(cels: DataFrame) -> DataFrame:
    """A row for each 16 pixels that a cel touches: ``y``, ``column`` (of 16 pixels), and the words written to the planes in one number, the first plane's lowest (``planes``).

    A rectangle that doesn't begin at a column writes each of its words to two of them; what lies beyond the right edge is lost.
    """
    columns = F.when(F.col("resolution") == 0, 20).otherwise(40)
    planes = F.when(F.col("resolution") == 0, 4).when(F.col("resolution") == 1, 2).otherwise(1)
    div16 = lambda v: F.shiftright(v, 4)
    rows = cels.select("path", "frame_index", "segment", "words", "y", "h", div16(F.col("w") + 15).alias("groups"), F.col("x").bitwiseAND(F.lit(15)).alias("shift"), div16(F.col("x")).alias("first"), columns.alias("wide"), planes.alias("planes"))
    rows = rows.withColumn("plane", F.col("groups") * F.col("h")).withColumn("cut", F.least(F.col("groups") + F.when(F.col("shift") > 0, 1).otherwise(0), F.col("wide") - F.col("first")) * F.col("h"))

    def place(at: Column) -> Column:
        # a place's own words, and those of the column before it, ``h`` words earlier
        own = lambda k: F.when((at < F.col("plane")) & (F.col("planes") > k), F.get("words", F.col("plane") * k + at)).otherwise(0)
        before = lambda k: F.when((at >= F.col("h")) & (F.col("planes") > k), F.get("words", F.col("plane") * k + at - F.col("h"))).otherwise(0)
        return F.struct(at.alias("at"), *[own(k).alias(f"own{k}") for k in range(4)], *[before(k).alias(f"before{k}") for k in range(4)])

    places = F.when((F.col("cut") > 0) & (F.size("words") > 0), F.transform(F.sequence(F.lit(0), F.col("cut") - 1), place))
    # outer, as otherwise Spark filters on the places first and so makes them twice
    out = rows.select("path", "frame_index", "segment", "y", "h", "shift", "first", F.explode_outer(places).alias("p")).where("p IS NOT NULL")
    shifted = lambda k: F.call_function("shiftright", F.col(f"p.own{k}"), F.col("shift")).bitwiseOR(
        F.call_function("shiftleft", F.col(f"p.before{k}"), F.lit(16) - F.col("shift")).bitwiseAND(F.lit(0xFFFF)))
    packed = shifted(0).cast("bigint")
    for k in range(1, 4):
        packed = packed.bitwiseOR(F.shiftleft(shifted(k).cast("bigint"), 16 * k))
    column = F.col("first") + F.call_function("div", F.col("p.at"), F.col("h")).cast("int")
    return out.select("path", "frame_index", "segment", (F.col("y") + F.col("p.at") % F.col("h")).alias("y"), column.alias("column"), packed.alias("planes"))


def seq_screens(words: DataFrame) -> DataFrame:
    """What the touched places hold after each cel: the folded ``planes`` and the 16 ``pixels``. Places without a row since the screen was cleared are 0.

    Rows are dealt by path and segment, which serves what groups them by frame as well: give ``segment`` as a key too.
    """
    run = Window.partitionBy("path", "segment", "y", "column").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    folded = words.repartition("path", "segment").withColumn("planes", F.bit_xor("planes").over(run))
    plane = lambda k: F.shiftright("planes", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    return folded.withColumn("pixels", words_to_chunky([plane(k) for k in range(4)]))


def seq_pictures(cels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole pictures of the ``wanted`` frames (``path``, ``frame_index``), as bytes: for each place the last row since the screen was cleared."""
    asked = wanted.select("path", "frame_index").distinct().join(cels.select("path", "frame_index", "segment", "resolution"), ["path", "frame_index"])
    screens = seq_screens(seq_words(cels)).select("path", "segment", F.col("frame_index").alias("drawn"), "y", "column", "pixels")
    seen = asked.join(screens, ["path", "segment"]).where(F.col("drawn") <= F.col("frame_index"))
    last = seen.groupBy("path", "frame_index", "y", "column").agg(F.max_by("pixels", "drawn").alias("pixels"))
    size = lambda part: F.when(F.col("resolution") == 0, SCREENS[0][part]).when(F.col("resolution") == 1, SCREENS[1][part]).otherwise(SCREENS[2][part])
    grid = asked.select("path", "frame_index", size(0).alias("width"), F.explode(F.sequence(F.lit(0), size(1) - 1)).alias("y"))
    grid = grid.select("path", "frame_index", "y", F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("width"), F.lit(16)).cast("int") - 1)).alias("column"))
    digits = F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), "")
    rows = grid.join(last, ["path", "frame_index", "y", "column"], "left").select("path", "frame_index", "y", "column", F.coalesce(digits, F.lit("00" * 16)).alias("digits"))
    whole = F.array_sort(F.collect_list(F.struct("y", "column", "digits")))
    return rows.groupBy("path", "frame_index").agg(F.unhex(F.array_join(F.transform(whole, lambda r: r["digits"]), "")).alias("pixels"))
