"""Where the frames of a file lie. Tables are read by expressions; chains of chunks are walked by a small helper."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.binary import once, u8, u16le, u32be, u32le
from framelake.functions.timing import div

#: Of rows that a task holds as Python objects.
BATCH_ROWS = 10_000
INDEX = "path string, frame_index int, offset bigint, size bigint, raw_flags int, keyframe_flag boolean, delay_ms int"


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _before(part: list[str], order: str) -> Column:
    """For each row the sum of the sizes before it: a window over small rows, never over contents."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("size").over(w), F.lit(0).cast("bigint"))


def _explode(rows: DataFrame, entries: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    # outer, as otherwise Spark filters on the entries first and so makes them twice
    return rows.select("path", *keep, F.explode_outer(entries).alias("e")).where("e IS NOT NULL").select("path", *keep, F.col("e.i").cast("int").alias("frame_index"), *[F.col(f"e.{c}").alias(c) for c in ("offset", "size")],
        F.col("e.flags").cast("int").alias("raw_flags"), F.col("e.key").alias("keyframe_flag"), F.lit(None).cast("int").alias("delay_ms"))


def smk_index(media: DataFrame) -> DataFrame:
    """From the size and flag tables; frames that the file ends before are left out."""
    def table(data: Column) -> Column:
        n = u32le(data, 12) + u32le(data, 20).bitwiseAND(F.lit(1).cast("bigint"))
        fits = F.least(n, div(F.greatest(F.length(data) - 104, F.lit(0)), F.lit(4)))  # of the table, what the file has
        base = 104 + n * 5 + u32le(data, 52)
        return once(F.struct(n.alias("n"), base.alias("base")), lambda h: F.transform(_upto(fits), lambda i: F.struct(
            i.alias("i"), u32le(data, 104 + i * 4).alias("raw"), u8(data, 104 + h["n"] * 4 + i).alias("flags"), h["base"].alias("base"), F.length(data).alias("length"))))

    rows = media.select("path", F.explode_outer(once(F.col("content"), table)).alias("e")).where("e IS NOT NULL").select("path", "e.*")
    rows = rows.withColumn("size", F.shiftleft(F.shiftright("raw", 2), 2)).withColumn("offset", F.col("base") + _before(["path"], "i"))
    key = (F.col("raw").bitwiseAND(F.lit(1).cast("bigint")) != 0) | (F.col("i") == 0)
    return rows.where(F.col("offset") + F.col("size") <= F.col("length")).select(
        "path", F.col("i").cast("int").alias("frame_index"), "offset", "size", F.col("flags").cast("int").alias("raw_flags"), key.alias("keyframe_flag"), F.lit(None).cast("int").alias("delay_ms"))


def bink_index(media: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """From the offset table, whose low bits mark keyframes; a table that doesn't ascend gives no rows. Columns to ``keep`` of a file are given with each frame."""
    even = lambda x: F.shiftleft(F.shiftright(x, 1), 1)

    def table(data: Column) -> Column:
        extra = F.when(F.substring(data, 4, F.lit(1)).cast("string") == "k", F.lit(4)).otherwise(F.lit(0))
        begin = 44 + extra + 12 * u32le(data, 40)
        words = once(begin, lambda at: F.transform(_upto(u32le(data, 8) + 1), lambda i: u32le(data, at + i * 4)))
        return once(words, lambda raw: once(F.transform(_upto(u32le(data, 8)), lambda i: entry(raw, i.cast("int"))), rising))

    def entry(raw: Column, i: Column) -> Column:
        this, after = F.get(raw, i), F.get(raw, i + 1)
        return F.struct(i.alias("i"), even(this).alias("offset"), (even(after) - even(this)).alias("size"), F.lit(0).alias("flags"), (this.bitwiseAND(F.lit(1).cast("bigint")) != 0).alias("key"))

    rising = lambda es: F.when(~F.exists(es, lambda e: e["size"] <= 0), es)
    return _explode(media, once(F.col("content"), table), keep)


def cdxl_index(media: DataFrame) -> DataFrame:
    """Equal strides of the first chunk's size; every chunk is a whole picture."""
    entry = lambda size, i: F.struct(i.alias("i"), (i * size).alias("offset"), size.alias("size"), F.lit(0).alias("flags"), F.lit(True).alias("key"))
    chunks = lambda data: once(u32be(data, 2), lambda size: F.transform(_upto(F.coalesce(div(F.length(data), size), F.lit(0))), lambda i: entry(size, i)))
    return _explode(media, once(F.col("content"), chunks))


def dpan_index(media: DataFrame) -> DataFrame:
    """From the page table: records of all pages sorted by frame, which must be dense; the loop-back record is left out."""
    def page(data: Column, p: Column) -> Column:
        entry, at = 1280 + p * 6, 2816 + p.cast("bigint") * 65536
        n = F.when(at < F.length(data), u16le(data, entry + 2).bitwiseAND(F.lit(0x3FFF).cast("bigint"))).otherwise(0)
        sizes = once(n, lambda held: F.transform(_upto(held), lambda r: u16le(data, at + 8 + r * 2)))
        return F.struct(p.alias("page"), u16le(data, entry).alias("base"), sizes.alias("sizes"), at.alias("at"))

    def table(data: Column) -> Column:
        drop = F.when(u8(data, 26) > 0, F.greatest(u32le(data, 8), F.lit(1)) - 1).otherwise(u32le(data, 8))
        pages = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda p: page(data, p))
        return F.struct(drop.alias("total"), F.filter(pages, lambda p: F.size(p["sizes"]) > 0).alias("pages"))

    total = F.col("total")
    pages = media.select("path", F.explode_outer(F.array(once(F.col("content"), table))).alias("t")).select("path", "t.total", F.explode("t.pages").alias("p")).select("path", "total", "p.*")
    pages = pages.withColumn("n", F.size("sizes"))
    records = pages.select("path", "total", "page", "base", (F.col("at") + 8 + F.col("n") * 2).alias("first"), F.posexplode("sizes").alias("r", "size"))
    records = records.withColumns({"frame": F.col("base") + F.col("r"), "offset": F.col("first") + _before(["path", "page"], "r")})
    return dense_records(records.where(F.col("frame") < total).select("path", "frame", "offset", "size", "total"))


def dense_records(records: DataFrame) -> DataFrame:
    """Records in order of their frame; those from a gap on are left out."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("frame", "offset"))
    dense = records.withColumn("place", place).where(F.col("place") == F.col("frame") + 1)
    return dense.select("path", F.col("frame").cast("int").alias("frame_index"), "offset", "size", F.lit(0).alias("raw_flags"), (F.col("frame") == 0).alias("keyframe_flag"), F.lit(None).cast("int").alias("delay_ms"))


def _walked(walker):
    """``walker(content)`` gives (frame, offset, size, flags, key, delay) for each frame of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32()]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in INDEX.split(", ")])
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0), batch.column(1), strict=True):  # one file at a time
                path, data = path.as_py(), data.as_py() or b""
                for x in walker(data):
                    rows.append((path, *x))
                    if len(rows) == BATCH_ROWS:
                        yield packed(rows)
                        rows = []
            yield packed(rows)

    return run


def flc_frames_of(data: bytes) -> Iterator[tuple]:
    """Frame chunks from byte 128 on; chunks of other kinds are stepped over by their size."""
    wanted = struct.unpack_from("<H", data, 6)[0] if len(data) >= 8 else 0
    at, n = 128, 0
    while n < wanted and at + 6 <= len(data):
        size, kind = struct.unpack_from("<IH", data, at)
        if size < 6:
            return
        if kind in (0xF1FA, 0xF5FA):
            delay = struct.unpack_from("<H", data, at + 8)[0] if at + 10 <= len(data) else 0
            yield n, at, size, 0, n == 0, delay
            n += 1
        at += size


def seq_frames_of(data: bytes) -> Iterator[tuple]:
    """Cel headers one after the other; the offset table on disk, which can be wrong, is stepped over."""
    count = struct.unpack_from(">I", data, 4)[0] if len(data) >= 8 else 0
    at = 128 + 4 * count
    for n in range(count):
        if at + 128 > len(data) or data[at : at + 2] != b"\xff\xff":
            return
        size = struct.unpack_from(">I", data, at + 64)[0]
        yield n, at, 128 + size, data[at + 62], data[at + 62] == 0, None
        at += 128 + size


def flc_index(media: DataFrame) -> DataFrame:
    return media.select("path", "content").mapInArrow(_walked(flc_frames_of), INDEX)


def seq_index(media: DataFrame) -> DataFrame:
    return media.select("path", "content").mapInArrow(_walked(seq_frames_of), INDEX)


INDEXERS = {"flc": flc_index, "smk": smk_index, "atari_seq": seq_index, "cdxl": cdxl_index, "dpan": dpan_index, "bink": bink_index}


def with_times(index: DataFrame, containers: DataFrame) -> DataFrame:
    """Frames with ``pts_us`` (period times index, whatever the frame's own delay) and ``duration_us`` (which honours it)."""
    return timed(index.join(containers.select("path", "frame_period_us"), "path")).select(*index.columns, "pts_us", "duration_us")


def timed(rows: DataFrame) -> DataFrame:
    """``with_times`` for frames that have their file's ``frame_period_us`` already: no join, and files are made once."""
    own = F.when(F.col("delay_ms") > 0, F.col("delay_ms").cast("bigint") * 1000).otherwise(F.col("frame_period_us"))
    return rows.select("*", (F.col("frame_period_us") * F.col("frame_index")).alias("pts_us"), own.alias("duration_us"))
