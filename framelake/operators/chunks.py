"""Sub-chunks of FLC frames as rows, their census, and the IFF chunks of ANIM and YAFA files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.binary import u8, u16be, u32be
from framelake.functions.timing import anim_period, yafa_period
from framelake.operators.frame_index import flc_frames_of

# Chunk types.
CHUNK_NAMES = {4: "COLOR_256", 7: "SS2", 11: "COLOR_64", 12: "LC", 13: "BLACK", 15: "BRUN", 16: "COPY", 18: "PSTAMP"}
#: Of rows that a task holds as Python objects.
BATCH_BYTES = 4 << 20
CHUNKS = "path string, frame_index int, seq int, type_code int, payload_offset bigint, payload_size bigint"


def chunk_name(code: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in CHUNK_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(named, code), F.concat(F.lit("type_"), code.cast("string")))


def flc_chunks_of(data: bytes) -> Iterator[tuple]:
    """(frame, seq, type, payload offset, payload size); a frame's rows end at its first broken chunk."""
    for frame, at, size, *_ in flc_frames_of(data):
        end, count, pos = min(at + size, len(data)), struct.unpack_from("<H", data, at + 6)[0], at + 16
        for seq in range(count):
            if pos + 6 > end:
                break
            n, kind = struct.unpack_from("<IH", data, pos)
            # a raw picture that comes last may state less than is there
            last_copy = kind == 16 and seq == count - 1
            if n < 6 or pos + n > end:
                break
            yield frame, seq, kind, pos + 6, (end - pos - 6 if last_copy else n - 6)
            pos += n


def _rows(walker, schema: str):
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])
        for batch in batches:
            rows, held = [], 0
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                for x in walker(data.as_py() or b""):
                    rows.append((path.as_py(), *x))
                    held += 64 + sum(4 * len(v) for v in x if hasattr(v, "__len__"))
                    if held > BATCH_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
            yield packed(rows)

    return run


def map_files(media: DataFrame, walker, schema: str) -> DataFrame:
    """``walker(content)`` gives the rows of a file, without its path; ``schema`` begins with the path."""
    return media.select("path", "content").mapInArrow(_rows(walker, schema), schema)


def flc_chunks(media: DataFrame) -> DataFrame:
    """A row a sub-chunk, with its name."""
    rows = map_files(media, flc_chunks_of, CHUNKS)
    return rows.select("path", "frame_index", "seq", "type_code", chunk_name(F.col("type_code")).alias("type_name"), "payload_offset", "payload_size")


def chunk_census(chunks: DataFrame) -> DataFrame:
    """Per file and type: chunks and payload bytes."""
    return chunks.groupBy("path", "type_name").agg(F.count("*").alias("n_chunks"), F.sum("payload_size").alias("n_bytes"))


def top_chunks(census: DataFrame, k: int = 4) -> DataFrame:
    """The k types of each file with the most bytes, then the most chunks, then by name."""
    order = Window.partitionBy("path").orderBy(F.desc("n_bytes"), F.desc("n_chunks"), "type_name")
    return census.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def payloads(media: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """The sub-chunks of some types with their payloads, cut out where the content lies."""
    codes = {name: code for code, name in CHUNK_NAMES.items()}
    wanted = {codes.get(t, int(t.removeprefix("type_")) if t.startswith("type_") else -1) for t in types}

    def walker(data: bytes) -> Iterator[tuple]:
        for *place, at, size in flc_chunks_of(data):
            if place[2] in wanted:
                yield *place, at, size, data[at : at + size]

    schema = f"{CHUNKS}, payload binary"
    rows = map_files(media, walker, schema)
    return rows.select("path", "frame_index", "seq", "type_code", chunk_name(F.col("type_code")).alias("type_name"), "payload_offset", "payload_size", "payload")


#: ``head``: the first bytes of a payload, which hold the fields of all header chunks.
IFF_CHUNKS = "path string, seq int, id string, payload_offset bigint, payload_size bigint, head binary"
HEAD = 40
#: Chunks that hold other chunks after a four-byte type.
GROUPS = (b"FORM", b"LIST", b"CAT ")


def iff_chunks_of(data: bytes) -> Iterator[tuple]:
    """(seq, id, payload offset, payload size, head) of all chunks, groups before what they hold; chunks lie on even bytes."""
    at, seq = 0, 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        size = min(size, len(data) - at - 8)
        yield seq, kind.decode("latin-1"), at + 8, size, data[at + 8 : at + 8 + min(size, HEAD)]
        seq += 1
        at += 12 if kind in GROUPS else 8 + size + size % 2


def iff_chunks(media: DataFrame) -> DataFrame:
    return map_files(media, iff_chunks_of, IFF_CHUNKS)


def iff_headers(media: DataFrame) -> DataFrame:
    """``path``, width, height, frames, planes and period of ANIM (BMHD, ANHD) and YAFA (INFO) files.

    An ANIM frame begins at a BMHD or ANHD once the one before has a picture; its period is that of the first
    relative time that isn't 0.
    """
    heads = iff_chunks(media).where(F.col("id").isin("BMHD", "ANHD", "INFO", "BODY", "DLTA"))
    at, data = 0, F.col("head")
    rows = heads.select(
        "path", "seq", "id", u16be(data, at).alias("a"), u16be(data, at + 2).alias("b"), u16be(data, at + 4).alias("depth"), u16be(data, at + 6).alias("speed"),
        u16be(data, at + 8).alias("frames"), u8(data, at + 8).alias("planes"), u32be(data, at + 14).alias("reltime"))
    first = lambda c, *ids: F.min_by(c, F.when(F.col("id").isin(*ids), F.col("seq")))
    got = rows.groupBy("path").agg(
        F.count_if(F.col("id") == "INFO").alias("infos"), first("a", "BMHD", "INFO").alias("width"), first("b", "BMHD", "INFO").alias("height"),
        first("depth", "INFO").alias("depth"), first("speed", "INFO").alias("speed"), first("frames", "INFO").alias("yafa_frames"),
        first("planes", "BMHD").alias("planes"), F.count_if(F.col("id").isin("BODY", "DLTA")).alias("pictures"),
        F.min_by("reltime", F.when((F.col("id") == "ANHD") & (F.col("reltime") > 0), F.col("seq"))).alias("reltime"))
    yafa = F.col("infos") > 0
    return got.select(
        "path", F.when(yafa, "yafa").otherwise("amiga_anim").alias("codec"), F.col("width").cast("int"), F.col("height").cast("int"), F.when(yafa, F.col("yafa_frames")).otherwise(F.col("pictures")).cast("int").alias("frame_count"),
        F.when(yafa, F.col("depth")).otherwise(F.col("planes")).cast("int").alias("planes"), F.when(yafa, yafa_period(F.col("speed"))).otherwise(anim_period(F.col("reltime"))).alias("frame_period_us"))
