"""A row a file of any of the eight formats: containers by expressions, IFF headers and sound tracks where the file lies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.timing import anim_period, yafa_period
from framelake.operators.chunks import iff_chunks_of
from framelake.sources.media import MAX_SIDE, containers, with_tracks

IFF = "width int, height int, frames int, planes int, ham boolean, reltime bigint, speed int, rate int, channels int, bits int, error string"


def anim_head(data: bytes) -> tuple:
    """What an ANIM file's chunks say: a frame begins at a BMHD or ANHD once the one before has a picture or sound."""
    frames, filled, heads, reltime, camg, sound, sxhd = 0, True, None, None, 0, 0, None
    for _, kind, _, size, head in iff_chunks_of(data):
        if kind in ("BMHD", "ANHD") and filled:
            frames, filled = frames + 1, False
        filled = filled or (frames > 0 and kind in ("BODY", "DLTA", "SBDY"))
        if kind == "BMHD" and size >= 20 and heads is None:
            heads = int.from_bytes(head[0:2], "big"), int.from_bytes(head[2:4], "big"), head[8], head[10]
        elif kind == "ANHD" and size >= 24 and not reltime:
            reltime = int.from_bytes(head[14:18], "big")
        elif kind == "CAMG" and size >= 4 and frames == 1:
            camg = int.from_bytes(head[:4], "big")
        elif kind == "SXHD" and size >= 20:
            sxhd = head
        elif kind == "SBDY":
            sound += size
    if heads is None:
        return (None,) * 10 + ("amiga_anim: no picture header",)
    width, height, planes, packing = heads
    heard = sxhd is not None and sound > 0 and sxhd[0] == 8 and not any(sxhd[10:14]) and sxhd[15] in (1, 2)
    rate = int.from_bytes(sxhd[16:20], "big") if heard else 0
    error = "amiga_anim: unsupported packing of pictures" if packing > 1 else "amiga_anim: unsupported number of planes" if not 0 < planes <= 8 else None
    return width, height, frames, planes, bool(camg & 0x800) and planes in (6, 8), reltime, None, rate, sxhd[15] if rate else 0, 8 if rate else 0, error


def yafa_head(data: bytes) -> tuple:
    info, listed, body = None, 0, False
    for _, kind, _, size, head in iff_chunks_of(data):
        if kind == "INFO" and size >= 14 and info is None:
            info = [int.from_bytes(head[k : k + 2], "big") for k in range(0, 14, 2)]
        listed, body = size // 4 if kind == "PROF" else listed, body or kind == "BODY"
    if info is None or not body:
        return (None,) * 10 + ("yafa: no header or no pictures",)
    width, height, planes, speed, frames, kind, flags = info
    fixed = not flags & 4 and kind in (0, 4)
    error = "yafa: packed frames without their ends" if not listed and not fixed else "yafa: ends of other frames" if listed and listed != frames else None
    return width, height, frames, planes, bool(flags & 1), None, speed, 0, 0, 0, error


def _iff_head(data: bytes) -> tuple | None:
    if data is None:
        return None
    return yafa_head(bytes(data)) if data[8:12] == b"YAFA" else anim_head(bytes(data))


def probe(media: DataFrame, max_width: int = MAX_SIDE, max_height: int = MAX_SIDE) -> DataFrame:
    """``containers`` with the headers of ANIM and YAFA files and the sound tracks of all: their number, and the first one's rate, channels and bits.

    No shuffle; only the contents of ANIM and YAFA files, and the first bytes of the others, reach Python.
    """
    rows = with_tracks(media.select("path", "content"), "_sound")
    rows = containers(rows, max_width=max_width, max_height=max_height, keep=("path", "content", "_sound"))
    iff = F.col("codec").isin("amiga_anim", "yafa")
    rows = rows.withColumns({"_tracks": F.col("_sound.tracks"), "_iff": F.udf(_iff_head, IFF, useArrow=True)(F.when(iff, F.col("content")))}).drop("content", "_sound")
    h = lambda c: F.col(f"_iff.{c}")
    period = F.when(F.col("codec") == "yafa", yafa_period(h("speed"))).otherwise(anim_period(h("reltime")))
    large = (h("width") > max_width) | (h("height") > max_height)
    problem = F.coalesce(h("error"), F.when(large, F.lit("larger than allowed")), F.when((h("width") == 0) | (h("height") == 0), F.lit("zero dimensions")))
    pick = lambda c, own: F.when(iff, own).otherwise(F.col(c)).alias(c)
    first = F.get("_tracks", F.lit(0))
    heard = F.coalesce(F.size("_tracks"), F.lit(0)) > 0
    sound = lambda c, key: F.when(iff, F.coalesce(h(key), F.lit(0))).when(heard, first[key].cast("int")).otherwise(F.col(c)).alias(c)
    count = F.when(iff, (F.coalesce(h("rate"), F.lit(0)) > 0).cast("int")).when(heard, F.size("_tracks")).otherwise(F.col("audio_track_count"))
    return rows.select(
        "path", "codec", pick("width", h("width")), pick("height", h("height")), pick("frame_count", h("frames")), pick("format", F.when(h("width").isNotNull(), F.when(h("ham"), "rgb888").otherwise("indexed8"))),
        pick("duration_us", period * h("frames")), pick("frame_period_us", F.when(h("width").isNotNull(), period)), count.alias("audio_track_count"),
        sound("audio_rate", "rate"), sound("audio_channels", "channels"), sound("audio_bits", "bits"), F.when(iff, problem).otherwise(F.col("error")).alias("error"))
