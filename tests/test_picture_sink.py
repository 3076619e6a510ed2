"""Pictures are written all or not at all."""

import pytest
from pyspark.sql import functions as F

from framelake.sources.picture_sink import PictureSink


def frames(spark, n, bad=None):
    rows = spark.range(n, numPartitions=4).select(
        F.concat(F.lit("a/"), (F.col("id") % 3).cast("string")).alias("path"), F.col("id").cast("int").alias("frame_index"), F.lit(2).alias("width"), F.lit(1).alias("height"), F.lit("rgb888").alias("format"),
        F.when(F.col("id") == (-1 if bad is None else bad), F.unhex(F.lit("0102"))).otherwise(F.unhex(F.lit("010203040506"))).alias("pixels"), F.lit(None).cast("binary").alias("palette"), F.lit("x").alias("more"))
    return rows


def pictures(folder):
    return sorted(p.name for p in folder.rglob("*.ppm"))


def test_all_or_none(spark, tmp_path):
    spark.dataSource.register(PictureSink)
    out = tmp_path / "pictures"
    save = lambda df, mode="append": df.write.format("framelake_pictures").mode(mode).save(str(out))
    save(frames(spark, 20))
    assert pictures(out) == [f"frame_{k:04d}.ppm" for k in range(20)] and not list((out / "_attempts").glob("*"))
    assert next(out.rglob("*.ppm")).read_bytes() == b"P6\n2 1\n255\n\1\2\3\4\5\6"
    with pytest.raises(Exception, match="the pixels are not 2 by 1"):
        save(frames(spark, 60, bad=41))
    assert len(pictures(out)) == 20 and not list((out / "_attempts").glob("*"))  # nothing of the failed job
    save(frames(spark, 5))
    assert len(pictures(out)) == 25
    save(frames(spark, 7), "overwrite")
    assert len(pictures(out)) == 7
    save(frames(spark, 0))
    assert len(pictures(out)) == 7
    with pytest.raises(Exception, match="pictures need the columns pixels"):
        save(frames(spark, 3).drop("pixels"))
