"""Containers as rows: which format a file is, and what its header says, from ``binaryFile`` content by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import timing as t
from framelake.functions.binary import Head, once, s32, text_prefix, u8, u16be, u16le, u32be, u32le

#: Formats in the order in which they are tried, with their usual file extensions.
CODECS = {
    "flc": ("flc", "fli"), "smk": ("smk",), "atari_seq": ("seq",), "amiga_anim": ("anim",), "cdxl": ("cdxl", "xl"),
    "yafa": ("yafa",), "dpan": ("anm", "gam"), "bink": ("bik", "bk"),
}
MAX_SIDE = 16384
#: What is cut from a file for its header fields, and for a table of 256 sound tracks. Spark copies a binary column whole at every use.
HEAD, TRACKS_HEAD = 128, 48 + 256 * 12


def read_media(spark: SparkSession, path: str, codecs: list[str] | None = None) -> DataFrame:
    """``path``, ``modificationTime``, ``length``, ``content`` of the files under a path; with ``codecs``, those with their extensions."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if codecs:
        known = ",".join(e for c in codecs for x in CODECS[c] for e in (x, x.upper()))
        reader = reader.option("pathGlobFilter", f"*.{{{known}}}")
    return reader.load(path)


def _ascii(data: Column, at: int, text: str) -> Column:
    return text_prefix(data, at, len(text)) == text.encode().hex().upper()


def cdxl_chunk(data: Column, at: int | Column = 0) -> Column:
    """The fields of a CDXL chunk header."""
    base = at
    info = u8(data, base + 1)
    return F.struct(
        u8(data, base).alias("type"), info.bitwiseAND(F.lit(3).cast("bigint")).alias("encoding"), info.bitwiseAND(F.lit(0xE0).cast("bigint")).alias("orientation"),
        (info.bitwiseAND(F.lit(0x10).cast("bigint")) != 0).alias("stereo"), u32be(data, base + 2).alias("size"), u32be(data, base + 10).alias("number"),
        u16be(data, base + 14).alias("width"), u16be(data, base + 16).alias("height"), u8(data, base + 19).alias("planes"),
        u16be(data, base + 20).alias("cmap_bytes"), u16be(data, base + 22).alias("audio_bytes"))


def _is_cdxl(data: Column, length: Column) -> Column:
    """No magic: a chunk header that makes sense, and a file that holds its chunk."""
    c = cdxl_chunk(data)
    side = lambda x: (x >= 1) & (x <= 4096)
    least = 32 + c["cmap_bytes"] + F.shiftleft(F.shiftright(c["width"] + 15, 4), 1) * c["planes"] * c["height"] + c["audio_bytes"]
    sound = (c["type"] <= 2) & c["orientation"].isin(0, 0x20, 0x40, 0x80, 0xC0)
    return (length >= 32) & sound & side(c["width"]) & side(c["height"]) & (c["planes"] >= 1) & (c["planes"] <= 24) & (c["size"] >= least) & (length >= c["size"])


def sniffs(data: Column, length: Column) -> dict[str, Column]:
    """For each format, whether content begins like it."""
    return {
        "flc": (length >= 6) & u16le(data, 4).isin(0xAF11, 0xAF12),
        "smk": _ascii(data, 0, "SMK2") | _ascii(data, 0, "SMK4"),
        "atari_seq": (length >= 2) & u16be(data, 0).isin(0xFEDB, 0xFEDC),
        "amiga_anim": _ascii(data, 0, "FORM") & _ascii(data, 8, "ANIM"),
        "cdxl": _is_cdxl(data, length),
        "yafa": _ascii(data, 0, "FORM") & _ascii(data, 8, "YAFA"),
        "dpan": _ascii(data, 0, "LPF ") & _ascii(data, 16, "ANIM") & (u16le(data, 20) > 0) & (u16le(data, 22) > 0),
        "bink": _ascii(data, 0, "BIK") & text_prefix(data, 3, 1).isin(*(x.encode().hex().upper() for x in "bfghik")),
    }


def codec_of(data: Column, length: Column, codecs: list[str] | None = None) -> Column:
    """The first format that content begins like, null if none; ``codecs`` narrows the formats tried."""
    known, found = sniffs(data, length), F.lit(None).cast("string")
    for name in reversed([c for c in CODECS if codecs is None or c in codecs]):
        found = F.when(known[name], F.lit(name)).otherwise(found)
    return found


def _seq_resolution(data: Column) -> Column:
    """Of an Atari SEQ file's first cel, which lies behind the table of all."""
    return F.when(sniffs(data, F.length(data))["atari_seq"], u16be(data, 128 + 4 * u32be(data, 4) + 2))


def _fields(data: Column, length: Column, resolution: Column) -> dict[str, dict[str, Column | int | str]]:
    """Header fields by format; those of ANIM and YAFA are IFF chunks: operators.iff and operators.chunks."""
    one = lambda x: F.lit(x).cast("bigint")
    by_resolution = lambda a, b, c: F.when(resolution == 0, one(a)).when(resolution == 1, one(b)).when(resolution == 2, one(c))
    c = cdxl_chunk(data)
    cdxl_frames = t.div(length, c["size"])
    channels = F.when(c["stereo"], one(2)).otherwise(one(1))
    heard = lambda x: F.when(c["audio_bytes"] > 0, x).otherwise(one(0))
    drop_last = F.when(u8(data, 26) > 0, F.greatest(u32le(data, 8), one(1)) - 1).otherwise(u32le(data, 8))
    return {
        "flc": {"width": u16le(data, 8), "height": u16le(data, 10), "frame_count": u16le(data, 6), "format": "indexed8",
                "period": F.when(u16le(data, 4) == 0xAF11, t.fli_period(u32le(data, 16))).otherwise(t.flc_period(u32le(data, 16)))},
        "smk": {"width": u32le(data, 4), "height": u32le(data, 8), "frame_count": u32le(data, 12) + u32le(data, 20).bitwiseAND(one(1)), "format": "indexed8", "period": t.smk_period(s32(u32le(data, 16)))},
        "atari_seq": {"width": by_resolution(320, 640, 640), "height": by_resolution(200, 200, 400), "frame_count": u32be(data, 4), "format": "indexed8", "period": t.seq_period(u16be(data, 8))},
        "cdxl": {"width": c["width"], "height": c["height"], "frame_count": cdxl_frames, "format": F.when(c["encoding"] == 1, "rgb888").otherwise("indexed8"), "period": t.cdxl_period(),
                 "audio_rate": heard(t.div(c["audio_bytes"] * t.CDXL_FPS, channels)), "audio_channels": heard(channels), "audio_bits": heard(one(8))},
        "dpan": {"width": u16le(data, 20), "height": u16le(data, 22), "frame_count": drop_last, "format": "indexed8", "period": t.dpan_period(u16le(data, 68))},
        "bink": {"width": u32le(data, 20), "height": u32le(data, 24), "frame_count": u32le(data, 8), "format": "rgb888", "period": t.bink_period(u32le(data, 28), u32le(data, 32))},
    }


# The least header that each format needs.
HEADER_BYTES = {"flc": 24, "smk": 104, "atari_seq": 128, "cdxl": 32, "dpan": 2816, "bink": 44}


def _error(data: Column, length: Column, codec: Column) -> Column:
    """Why a header can't be used, null if it can."""
    short = F.lit(None).cast("string")
    for name, n in HEADER_BYTES.items():
        short = F.when((codec == name) & (length < n), F.lit(f"{name}: header cut short")).otherwise(short)
    flc = F.when((codec == "flc") & (u16le(data, 4) == 0xAF12) & (length < 88), F.lit("flc: extended header cut short"))
    dpan = F.when((codec == "dpan") & ((u16le(data, 4) != 256) | (u16le(data, 14) != 1280) | (u8(data, 24) != 0) | (u8(data, 28) != 0) | (u8(data, 29) > 1) | (u8(data, 31) != 1)), F.lit("dpan: unsupported variant"))
    seq = F.when((codec == "atari_seq") & (u16be(data, 2) != 0), F.lit("atari_seq: unsupported version"))
    c = cdxl_chunk(data)
    cdxl = F.when((codec == "cdxl") & ((c["orientation"] != 0) | (c["encoding"] > 1) | (c["planes"] > 8)), F.lit("cdxl: only bit planes of RGB or HAM, 8 at most"))
    frames, tracks = u32le(data, 8), u32le(data, 40)
    bink = F.when((codec == "bink") & (u32le(data, 36).bitwiseAND(F.lit(0x100000).cast("bigint")) != 0), F.lit("bink: alpha plane"))
    bink = F.when((codec == "bink") & ((frames == 0) | (frames > 1_000_000) | (tracks > 256) | (u32le(data, 28) == 0) | (u32le(data, 32) == 0)), F.lit("bink: implausible header")).otherwise(bink)
    none = F.when(codec.isNull(), F.lit("unknown format"))
    return F.coalesce(none, short, flc, dpan, seq, cdxl, bink)


def containers(media: DataFrame, codecs: list[str] | None = None, max_width: int = MAX_SIDE, max_height: int = MAX_SIDE, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """A row a file: format, size, frames, pixel format, duration, audio, or the error that stands against it.

    ``media`` has ``path`` and ``content``. Files are parsed where they lie: no shuffle, and but their first bytes reach Python.
    """
    data, length = Head("_head", "_numbers", HEAD), F.col("_length")
    rows = media.select(*keep, F.substring("content", 1, HEAD).alias("_head"), F.length("content").cast("bigint").alias("_length"), _seq_resolution(F.col("content")).alias("_resolution"))
    codec, fields, error = codec_of(data, length, codecs), _fields(data, length, F.col("_resolution")), _error(data, length, F.col("codec"))
    rows = rows.withColumn("_numbers", data.read()).withColumn("codec", codec)
    kinds = {"width": "int", "height": "int", "frame_count": "int", "format": "string", "period": "bigint", "audio_rate": "int", "audio_channels": "int", "audio_bits": "int"}
    out = {}
    for field, kind in kinds.items():
        value = F.lit(0 if field.startswith("audio") else None).cast(kind)
        for name, own in fields.items():
            if field in own:
                x = own[field] if isinstance(own[field], Column) else F.lit(own[field])
                value = F.when(F.col("codec") == name, x.cast(kind)).otherwise(value)
        out[field] = value
    rows = rows.select(*keep, "codec", *[v.alias(k) for k, v in out.items()], error.alias("error"))
    large = (F.col("width") > max_width) | (F.col("height") > max_height)
    error = F.coalesce("error", F.when(large, F.lit("larger than allowed")), F.when((F.col("width") == 0) | (F.col("height") == 0), F.lit("zero dimensions")))
    return rows.select(
        *keep, "codec", "width", "height", "frame_count", "format", (F.col("period") * F.col("frame_count")).alias("duration_us"), F.col("period").alias("frame_period_us"),
        F.when(F.col("audio_rate") > 0, 1).otherwise(0).alias("audio_track_count"), "audio_rate", "audio_channels", "audio_bits", error.alias("error"))


def with_tracks(rows: DataFrame, name: str, content: str = "content") -> DataFrame:
    """``rows`` with a struct of ``codec`` and the sound ``tracks`` of Smacker and Bink headers; null ``tracks`` for others."""
    head = Head("_tracks_head", "_tracks_numbers", HEAD)
    tracks = _tracks_of(head, F.col("_tracks_head"))
    rows = rows.withColumn("_tracks_head", F.substring(content, 1, TRACKS_HEAD)).withColumn("_tracks_numbers", head.read())
    return rows.withColumn(name, tracks).drop("_tracks_head", "_tracks_numbers")


def _tracks_of(data: Head, content: Column) -> Column:
    one = lambda x: F.lit(x).cast("bigint")
    flag = lambda flags, bit: flags.bitwiseAND(one(1 << bit)) != 0

    def entry(i, rate, stereo, wide, packed, track_id, most):
        return F.struct((i if isinstance(i, Column) else F.lit(i)).cast("int").alias("track"), rate.alias("rate"), F.when(stereo, 2).otherwise(1).alias("channels"), F.when(wide, 16).otherwise(8).alias("bits"), packed.alias("packed"), track_id.alias("track_id"), most.alias("max_bytes"))

    def smk(i):
        flags = u8(data, 75 + i * 4)
        return F.when(flag(flags, 6), entry(i, u32le(data, 72 + i * 4).bitwiseAND(one(0xFFFFFF)), flag(flags, 4), flag(flags, 5), flag(flags, 7), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))

    def bink(table, i):
        n = F.call_function("div", F.length(table), F.lit(12))
        flags = u16le(table, n * 4 + i * 4 + 2)
        return entry(i, u16le(table, n * 4 + i * 4), flag(flags, 13), flag(flags, 14), F.lit(True), u32le(table, n * 8 + i * 4), u32le(table, i * 4))

    n, at = u32le(data, 40), 44 + F.when(text_prefix(data, 3, 1) == "6B", 4).otherwise(0)
    # only the table is read by interpreted lambdas
    table = F.substring(content, at + 1, (n * 12).cast("int"))
    listed = once(table, lambda x: F.transform(F.sequence(one(0), F.call_function("div", F.length(x), F.lit(12)) - 1), lambda i: bink(x, i)))
    length = F.length(content).cast("bigint")
    codec = codec_of(data, length, ["smk", "bink"])
    tracks = F.when(codec == "smk", F.array(*[smk(i) for i in range(7)])).when((codec == "bink") & (n > 0) & (n <= 256) & (length >= at + n * 12), listed)
    return F.struct(codec.alias("codec"), F.array_compact(F.coalesce(tracks, F.when(codec == "bink", F.slice(F.array(smk(0)), 1, 0)))).alias("tracks"))


def audio_tracks(media: DataFrame) -> DataFrame:
    """A row an audio track of Smacker and Bink files: ``track``, ``rate``, ``channels``, ``bits``, ``packed``, and Bink's ``track_id`` and ``max_bytes``.

    Smacker has seven places for tracks, of which those present are given; Bink has a table of up to 256.
    """
    found = with_tracks(media.select("path", "content"), "x")
    return found.select("path", F.col("x.codec").alias("codec"), F.explode("x.tracks").alias("t")).select("path", "codec", "t.*")


def named(rows: DataFrame, pattern: str, kind: str, codec: str = "codec", path: str = "path") -> DataFrame:
    """The rows whose name, kind/codec/file, a regular expression is found in; ``name`` is added."""
    name = F.concat_ws("/", F.lit(kind), F.col(codec), F.element_at(F.split(F.col(path), "/"), -1))
    return rows.withColumn("name", name).where(F.col("name").rlike(pattern))
