"""Frames, sound and headers of the IFF formats, ANIM and YAFA, as groups over their chunks' rows.

A walker gives the chunks of a file in order, with their form and frame and the payloads of the kinds asked for; what
belongs together is then found by groups over these rows. Pictures are never asked for, so what is shuffled is heads. A
frame's sound is put together where its file lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.binary import once, u8, u16be, u32be
from framelake.functions.timing import SECOND, anim_period, div, yafa_period
from framelake.operators.chunks import IFF_CHUNKS, iff_chunks_of, map_files


def iff_rows(media: DataFrame, *ids: str) -> DataFrame:
    """The chunks of files with ``form``, the type of the FORM that a chunk lies in, and the ``payload`` of those of some ids."""
    wanted = frozenset(ids)

    def walker(data: bytes) -> Iterator[tuple]:
        form = None
        for seq, kind, at, size, head in iff_chunks_of(data):
            form = head[:4].decode("latin-1") if kind == "FORM" else form
            yield seq, kind, at, size, head, data[at : at + size] if kind in wanted else None, form

    return map_files(media, walker, f"{IFF_CHUNKS}, payload binary, form string")


def anim_chunks_of(data: bytes) -> Iterator[tuple]:
    """The chunks within the pictures of an ANIM file, with their frame last.

    A frame begins at a BMHD or ANHD once the one before has a picture or sound.
    """
    form, frame, filled = b"", 0, False
    for seq, kind, at, size, head in iff_chunks_of(data):
        if kind == "FORM":
            form = head[:4]
        elif form == b"ILBM":
            if kind in ("BMHD", "ANHD") and filled:
                frame, filled = frame + 1, False
            filled = filled or kind in ("BODY", "DLTA", "SBDY")
            yield seq, kind, at, size, head, frame


def anim_rows(media: DataFrame, *ids: str) -> DataFrame:
    """The chunks within the pictures of ANIM files, with their ``frame_index``, and the ``payload`` of those of some ids."""
    wanted = frozenset(ids)

    def walker(data: bytes) -> Iterator[tuple]:
        for seq, kind, at, size, head, frame in anim_chunks_of(data):
            yield seq, kind, at, size, head, data[at : at + size] if kind in wanted else None, frame

    return map_files(media, walker, f"{IFF_CHUNKS}, payload binary, frame_index int")


def _first(value: Column | str, *ids: str) -> Column:
    return F.min_by(value, F.when(F.col("id").isin(*ids), F.col("seq")))


def anim_index(media: DataFrame) -> DataFrame:
    """A row a frame: where its picture lies, whether that is whole or a delta, its sound, its time and how long it is shown.

    ``pts_us`` takes every frame to last as long as the first time given; ``duration_us`` honours each frame's own.
    """
    rows = anim_rows(media)
    time = F.when((F.col("id") == "ANHD") & (F.col("payload_size") >= 24), u32be(F.col("head"), 14))
    frames = rows.groupBy("path", "frame_index").agg(
        _first("payload_offset", "BODY", "DLTA").alias("offset"), _first("payload_size", "BODY", "DLTA").alias("size"), _first(F.col("id") == "BODY", "BODY", "DLTA").alias("keyframe_flag"),
        F.sum(F.when(F.col("id") == "SBDY", F.col("payload_size")).otherwise(0)).alias("sound_bytes"), F.max(time).alias("reltime"))
    given = F.first(F.when(F.col("reltime") > 0, F.col("reltime")), ignorenulls=True).over(Window.partitionBy("path").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    period = anim_period(given)
    own = F.when(F.col("reltime") > 0, div(F.col("reltime") * SECOND, F.lit(60))).otherwise(period)
    return frames.select("path", "frame_index", "offset", "size", "keyframe_flag", "sound_bytes", (period * F.col("frame_index")).alias("pts_us"), own.alias("duration_us"))


def anim_headers(media: DataFrame) -> DataFrame:
    """A row an ANIM file: size, planes, colours (``cmap``), display mode, and its sound's width, rate and channels (null without SXHD)."""
    h = F.col("head")
    rows = anim_rows(media, "CMAP")
    long = lambda n: F.col("payload_size") >= n
    got = rows.groupBy("path").agg(
        _first(F.when(long(20), u16be(h, 0)), "BMHD").alias("width"), _first(F.when(long(20), u16be(h, 2)), "BMHD").alias("height"), _first(F.when(long(20), u8(h, 8)), "BMHD").alias("planes"),
        _first("payload", "CMAP").alias("cmap"), _first(F.when(long(4), u32be(h, 0)), "CAMG").alias("camg"), F.max_by("head", F.when((F.col("id") == "SXHD") & long(20), F.col("seq"))).alias("sxhd"))
    x = F.col("sxhd")
    entries = F.least(div(F.length("cmap"), F.lit(3)), F.lit(256))
    return got.select("path", "width", "height", "planes", F.substring("cmap", F.lit(1), (entries * 3).cast("int")).alias("cmap"), "camg",
        F.when(x.isNotNull(), u8(x, 0)).alias("audio_bits"), F.when(x.isNotNull(), u32be(x, 16)).alias("audio_rate"), F.when(x.isNotNull(), u8(x, 15)).alias("audio_channels"))


def anim_controls(media: DataFrame) -> DataFrame:
    """Sound controls (SCTL) by frame, as ``audio.sound_events`` takes them; one cut short is all zero and names no sound."""
    rows = anim_rows(media).where(F.col("id") == "SCTL")
    field = lambda f, at: F.when(F.col("payload_size") >= 12, f(F.col("head"), at)).otherwise(0)
    return rows.select("path", "frame_index", "seq", field(u16be, 2).alias("sound"), field(u8, 1).alias("volume"), field(u16be, 4).alias("repeats"), field(u16be, 6).alias("channel"), field(u16be, 8).alias("frequency"))


def sound_bank(media: DataFrame) -> DataFrame:
    """The 8SVX sounds of ANIM files before their first picture: ``path``, ``slot`` from 1 on, and ``sound_bytes``, the whole FORM."""

    def walker(data: bytes) -> Iterator[tuple]:
        slot, end = 0, 0
        for _, kind, at, size, head in iff_chunks_of(data):
            if kind != "FORM" or at == 8 or at < end:
                continue
            if head[:4] == b"ILBM" or at + int.from_bytes(data[at - 4 : at], "big") > len(data):
                return
            if head[:4] == b"8SVX":
                slot, end = slot + 1, at + size
                yield slot, data[at - 8 : end]

    return map_files(media, walker, "path string, slot int, sound_bytes binary")


def pcm_of(data: bytes) -> Iterator[tuple]:
    """(frame, rate, channels, sound) of an ANIM file, by the last SXHD in it."""
    sounds, sxhd = {}, None
    for _, kind, at, size, head, frame in anim_chunks_of(data):
        if kind == "SBDY":
            sounds.setdefault(frame, []).append((at, size))
        elif kind == "SXHD" and size >= 20:
            sxhd = head
    if sxhd is None or sxhd[0] != 8 or any(sxhd[10:14]) or sxhd[15] not in (1, 2) or not any(sxhd[16:20]):
        return
    rate, channels = int.from_bytes(sxhd[16:20], "big"), sxhd[15]
    for frame, parts in sounds.items():
        pcm = b"".join(data[at : at + size] for at, size in parts)
        half = len(pcm) // 2  # bytes of a channel
        yield frame, rate, channels, pcm if channels == 1 else np.frombuffer(pcm, np.uint8, 2 * half).reshape(2, half).T.tobytes()


def anim_pcm(media: DataFrame) -> DataFrame:
    """The sound of a frame (``rate``, ``channels``, ``pcm``): its SBDY chunks in order, and of stereo ones both halves interleaved.

    Only uncompressed 8-bit sound of one or two channels at a known rate is given. Nothing is shuffled.
    """
    return map_files(media, pcm_of, "path string, frame_index int, rate bigint, channels bigint, pcm binary")


def yafa_index(media: DataFrame) -> DataFrame:
    """A row a frame of a YAFA file, from the ends in PROF, or of one size each if frames are neither packed nor deltas.

    A file whose ends are not as many as its frames has no rows.
    """
    rows = iff_rows(media, "PROF").where("form = 'YAFA'")
    info = F.when(F.col("payload_size") >= 14, F.col("head"))
    got = rows.groupBy("path").agg(_first(info, "INFO").alias("i"), _first("payload", "PROF").alias("prof"), _first("payload_offset", "BODY").alias("body"))
    i = F.col("i")
    got = got.where("i IS NOT NULL AND body IS NOT NULL").select("path", "prof", "body", u16be(i, 0).alias("w"), u16be(i, 2).alias("h"), u16be(i, 4).alias("depth"), u16be(i, 6).alias("speed"), u16be(i, 8).alias("n"), u16be(i, 10).alias("type"), u16be(i, 12).alias("flags"))
    fixed = F.when(F.col("flags").bitwiseAND(F.lit(4).cast("bigint")) == 0, F.when(F.col("type") == 4, F.col("w") * F.col("h")).when(F.col("type") == 0, div(F.col("w") + 7, F.lit(8)) * F.col("h") * F.col("depth")))
    got = got.withColumn("n_prof", F.coalesce(F.length("prof"), F.lit(0)))
    told = F.col("n_prof") > 0
    end = lambda prof, k: F.when(told, u32be(prof, k * 4)).otherwise(fixed * (k + 1))
    frame = lambda prof, k: F.struct(k.cast("int").alias("frame_index"), F.when(k > 0, end(prof, k - 1)).otherwise(0).alias("start"), end(prof, k).alias("end"))
    frames = once(F.col("prof"), lambda prof: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda k: frame(prof, k)))
    fits = (F.col("n") > 0) & F.when(told, F.col("n_prof") == F.col("n") * 4).otherwise(fixed.isNotNull())
    out = got.where(fits).select("path", "body", yafa_period(F.col("speed")).alias("period"), F.explode(frames).alias("f"))
    return out.select("path", "f.frame_index", (F.col("body") + F.col("f.start")).alias("offset"), (F.col("f.end") - F.col("f.start")).alias("size"), (F.col("period") * F.col("f.frame_index")).alias("pts_us"), F.col("period").alias("duration_us"))
