"""Smacker frames taken apart, their raw sound, and their palettes by composition of index maps.

A frame's flags say which of a palette, seven tracks of sound and the picture follow each other, each but the last with
its own size. A palette block changes the palette before it: entries stay, are copied from it, or are new. As a map from
entries to entries before or to colours such blocks compose, and composition is associative; so the palettes of a file of
any length are a prefix over its blocks, taken in groups of ``GROUP`` and then over the groups, and not frame by frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.binary import once
from framelake.operators.chunks import map_files

PARTS = "path string, frame_index int, kind string, track int, offset bigint, size bigint, rate int, channels int, bits int, packed boolean, payload binary, changes array<int>, error string"
GROUP = 64


def palette_changes(block: bytes) -> list[int]:
    """For each of 256 entries the number of the entry before that it takes, or a colour as -1 - rgb."""
    out, at, n = list(range(256)), 1, 0
    wide = lambda v: ((v & 63) << 2 | (v & 63) >> 4) & 255
    while n < 256 and at < len(block):
        b = block[at]
        if b & 0x80:
            n, at = n + (b & 0x7F) + 1, at + 1
        elif b & 0x40:
            if at + 1 >= len(block):
                raise ValueError("palette copy cut short")
            source, count = block[at + 1], (b & 0x3F) + 1
            if source + count > 256:
                raise ValueError("palette copy out of range")
            for k in range(min(count, 256 - n)):
                out[n + k] = source + k
            n, at = n + count, at + 2
        else:
            if at + 2 >= len(block):
                raise ValueError("palette colour cut short")
            out[n] = -1 - (wide(b) << 16 | wide(block[at + 1]) << 8 | wide(block[at + 2]))
            n, at = n + 1, at + 3
    return out


def parts_of(data: bytes) -> Iterator[tuple]:
    """The parts of each frame, palettes with what they change and sound with its payload; a file's rows end at the first part that is broken, which has an error."""
    if len(data) < 104:
        return
    n = struct.unpack_from("<I", data, 12)[0] + (struct.unpack_from("<I", data, 20)[0] & 1)
    at = 104 + 5 * n + struct.unpack_from("<I", data, 52)[0]
    tracks = [struct.unpack_from("<I", data, 72 + 4 * k)[0] for k in range(7)]
    none = (None,) * 7  # form, payload, changes, error
    for frame in range(n):
        if 104 + 4 * n + frame >= len(data):
            return
        size, flags = struct.unpack_from("<I", data, 104 + 4 * frame)[0] & ~3, data[104 + 4 * n + frame]
        end = at + size
        if end > len(data):
            return
        pos = at
        try:
            if flags & 1:
                length = 4 * data[pos] if pos < end else 0
                if not 0 < length <= end - pos:
                    raise ValueError("palette block out of range")
                yield frame, "palette", None, pos, length, None, None, None, None, None, palette_changes(data[pos : pos + length]), None
                pos += length
            for track in range(7):
                if flags >> (track + 1) & 1:
                    length = struct.unpack_from("<I", data, pos)[0] if pos + 4 <= end else 0
                    if not 4 <= length <= end - pos:
                        raise ValueError("sound out of range")
                    told = tracks[track]
                    yield frame, "audio", track, pos + 4, length - 4, told & 0xFFFFFF, 2 if told >> 28 & 1 else 1, 16 if told >> 29 & 1 else 8, bool(told >> 31), data[pos + 4 : pos + length], None, None
                    pos += length
            yield frame, "video", None, pos, end - pos, *none
        except ValueError as error:
            yield frame, "error", None, pos, end - pos, *none[:6], str(error)
            return
        at = end


def smk_parts(media: DataFrame) -> DataFrame:
    """A row a part of a frame: ``kind`` (palette, audio, video or error), where it lies, and of sound its form and payload."""
    return map_files(media, parts_of, PARTS)


def smk_pcm(parts: DataFrame) -> DataFrame:
    """Raw sound by frame and track (``rate``, ``channels``, ``pcm``), as signed bytes: unsigned ones less 128, and of 16-bit samples the upper byte. Packed sound is not given."""
    rows = parts.where((F.col("kind") == "audio") & ~F.col("packed"))
    byte = lambda data, at: F.substring(data, at + 1, F.lit(1))
    signed = lambda b: F.lpad(F.hex(F.conv(F.hex(b), 16, 10).cast("int").bitwiseXOR(F.lit(0x80))), 2, "0")
    n = F.call_function("div", F.length("payload"), F.when(F.col("bits") == 16, 2).otherwise(1)).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    sample = lambda data, i: F.when(F.col("bits") == 16, F.hex(byte(data, i * 2 + 1))).otherwise(signed(byte(data, i)))
    digits = once(F.col("payload"), lambda data: F.array_join(F.transform(numbers, lambda i: sample(data, i)), ""))
    return rows.select("path", "frame_index", "track", "rate", "channels", F.unhex(digits).alias("pcm"))


def _after(first: Column, then: Column) -> Column:
    """The map that does ``first`` and then ``then``."""
    return F.transform(then, lambda x: F.when(x < 0, x).otherwise(F.get(first, x)))


def _prefix(maps: DataFrame, group: int) -> DataFrame:
    """``path``, ``i`` (from 0, without gaps) and ``map`` to the composition of all maps up to each."""
    step = lambda acc, r: F.concat(acc, F.array(F.struct(r["i"].alias("i"), F.when(F.size(acc) > 0, _after(F.element_at(acc, -1)["map"], r["map"])).otherwise(r["map"]).alias("map"))))
    none = F.array().cast("array<struct<i: bigint, map: array<int>>>")
    within = maps.groupBy("path", F.call_function("div", F.col("i"), F.lit(group)).alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "map"))).alias("rows"))
    within = within.select("path", "g", F.aggregate("rows", none, step).alias("rows"))
    rows = within.select("path", "g", F.inline("rows"))
    if (maps.agg(F.max("i")).first()[0] or 0) < group:
        return rows.select("path", "i", "map")
    before = _prefix(within.select("path", F.col("g").alias("i"), F.element_at("rows", -1)["map"].alias("map")), group)
    before = before.select("path", (F.col("i") + 1).alias("g"), F.col("map").alias("before"))
    joined = rows.join(before, ["path", "g"], "left")
    return joined.select("path", "i", F.when(F.col("before").isNotNull(), _after(F.col("before"), F.col("map"))).otherwise(F.col("map")).alias("map"))


def smk_palettes(parts: DataFrame, group: int = GROUP) -> DataFrame:
    """``path``, ``frame_index`` of each frame that changes its palette, and the 256 colours (rgb) from then on; they begin black."""
    blocks = parts.where("kind = 'palette'").select("path", "frame_index", "changes")
    # numbered in order, by the files' own frames: a window over rows without payloads
    place = (F.row_number().over(Window.partitionBy("path").orderBy("frame_index")) - 1).cast("bigint")
    numbered = blocks.select("path", "frame_index", place.alias("i"), F.col("changes").alias("map"))
    done = _prefix(numbered.select("path", "i", "map"), group)
    colours = F.transform("map", lambda x: F.when(x < 0, -1 - x).otherwise(0))
    return numbered.select("path", "frame_index", "i").join(done, ["path", "i"]).select("path", "frame_index", colours.alias("palette"))
