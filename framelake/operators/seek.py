"""Random access: where the replay for a frame has to begin, as an as-of lookup of keyframes without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a file that one window looks at; what lies before is carried in by a row a block.
BLOCK = 4096
#: How formats go back: to the frame itself, to the keyframe before it, or to the first frame.
DIRECT, KEYFRAME = ("cdxl", "yafa"), ("bink",)


def keyframes_asof(targets: DataFrame, keyframes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``path``, ``frame_index`` of each distinct target, and ``keyframe``: the last keyframe at or before it, 0 if there is none.

    Targets and keyframes are one table, in which the last keyframe is carried forward within a block of frames; the last
    one of the blocks before comes from a table of a row a block. However many requests one file has, its blocks lie in
    different tasks, and requests for one frame are one row.
    """
    where = lambda df, key: df.select("path", F.col("frame_index").cast("bigint").alias("frame_index"), F.lit(key).alias("is_key")).distinct()
    marks = where(targets, False).unionByName(where(keyframes, True)).withColumn("block", F.call_function("div", F.col("frame_index"), F.lit(block)))
    key = F.when(F.col("is_key"), F.col("frame_index"))
    blocks = marks.groupBy("path", "block").agg(F.max(key).alias("last"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("path", "block").orderBy("frame_index", F.desc("is_key")).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("own", F.last(key, ignorenulls=True).over(within)).where(~F.col("is_key")).join(blocks, ["path", "block"])
    return found.select("path", "frame_index", F.coalesce("own", "carried", F.lit(0)).alias("keyframe"))


def replay_ranges(requests: DataFrame, keyframes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``requests`` (``path``, ``codec``, ``frame_count``, ``cursor``, ``frame_index``) with ``can_seek``, ``replay_from`` and ``replay_frames``.

    A seek goes on from the cursor if that isn't past the frame, and else from where its format can begin anew; frames
    from there up to the one before the target are decoded and not shown. A seek to the count is one to the end.
    """
    asked = requests.where(F.col("codec").isin(*KEYFRAME) & (F.col("frame_index") < F.col("cursor")))
    found = keyframes_asof(asked, keyframes, block).select("path", F.col("frame_index").alias("_target"), "keyframe")
    rows = requests.join(found, (requests["path"] == found["path"]) & (requests["frame_index"] == found["_target"]), "left").drop(found["path"]).drop("_target")
    target, cursor = F.col("frame_index").cast("bigint"), F.col("cursor").cast("bigint")
    anew = F.when(F.col("codec").isin(*DIRECT), target).when(F.col("codec").isin(*KEYFRAME), F.coalesce("keyframe", F.lit(0))).otherwise(0)
    can = (target >= 0) & (target <= F.col("frame_count")) & (F.col("frame_count") > 0)
    begin = F.when(F.col("codec").isin(*DIRECT), target).when(target >= cursor, cursor).otherwise(anew)
    rows = rows.withColumns({"can_seek": can, "replay_from": F.when(can, begin)}).drop("keyframe")
    return rows.withColumn("replay_frames", target - F.col("replay_from"))
