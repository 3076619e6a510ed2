"""Work in proportion to a file: four times the bytes may not cost much over four times the time."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.functions import binary, colour
from framelake.operators import audio, frame_index, iff
from framelake.plans import derived, queries
from framelake.sources import media

MB = 1 << 20


def docs(spark, n_bytes):
    return spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("framelake 123 "), n_bytes // 14 + 1).alias("text"))


def lines(spark, n):
    return spark.range(n).select(F.lit(1).cast("bigint").alias("l_orderkey"), F.col("id").cast("int").alias("l_linenumber"), (F.col("id") * 7).alias("l_partkey"))


CASES = {
    "cdxl_audio": lambda s, n: audio.cdxl_audio(derived.cdxl_files(docs(s, n))),
    "cdxl_index": lambda s, n: frame_index.cdxl_index(derived.cdxl_files(docs(s, n))),
    "dpan_index": lambda s, n: frame_index.dpan_index(derived.dpan_files(docs(s, n))),
    "flc_files": lambda s, n: derived.flc_files(docs(s, n)),
    "flc_words": lambda s, n: derived.flc_files(docs(s, n), words=True),
    "seq_files": lambda s, n: derived.seq_files(docs(s, n)),
    "anim_pcm": lambda s, n: iff.anim_pcm(derived.anim_files(docs(s, n))),
    "yafa_index": lambda s, n: iff.yafa_index(derived.yafa_files(docs(s, n))),
    "smk_index": lambda s, n: frame_index.smk_index(derived.index_files(lines(s, n // 40), "smk")),
    "bink_index": lambda s, n: frame_index.bink_index(derived.index_files(lines(s, n // 40), "bink")),
    "audio_tracks": lambda s, n: media.audio_tracks(derived.index_files(lines(s, n // 40), "bink", tracks=True)),
}


@pytest.mark.parametrize("case", CASES)
def test_cost_is_linear(spark, case):
    took = []
    for n in (MB // 64, MB, 4 * MB):  # the first one compiles
        began = time.time()
        CASES[case](spark, n).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[2] < 6 * took[1] + 1, took


def test_pixels_become_rgba_in_proportion_to_a_picture(spark):
    picture = lambda n: spark.range(n).select(F.unhex(F.repeat(F.lit("07"), 64000)).alias("p"), F.unhex(F.repeat(F.lit("102030"), 256)).alias("c"))
    rows = lambda n: picture(n).select(colour.convert_pixels(F.col("p"), F.col("c"), F.lit("indexed8"), "rgba8888").alias("x"))
    assert rows(1).first().x == bytes((16, 32, 48, 255)) * 64000
    began = time.time()
    rows(20).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 5  # of 0.1 MB each, hexadecimal digits were made again for every pixel


def test_whole_columns_are_read_like_one_place_after_the_other(spark):
    some = spark.range(60).select(F.expr("substring(sha2(cast(id AS string), 512) || sha2(cast(id + 1 AS string), 512), 1, cast(id * 3 AS int))").alias("t")).select(F.unhex(F.expr("substring(t, 1, length(t) div 2 * 2)")).alias("d"))
    steps = lambda last, f: F.aggregate(F.sequence(F.lit(0), last.cast("int")), F.lit(0).cast("bigint"), lambda acc, i: (acc * 31 + f(F.col("d"), i)) % binary.PRIME)
    for size, little in ((1, True), (2, True), (2, False), (4, True), (4, False)):
        want = steps(F.ceil(F.length("d") / size), lambda d, i: binary.uint(d, i * size, size, little))
        assert some.where(binary.words_folded(F.col("d"), size, little) != want).count() == 0
    codes = F.when(F.length("d") > 0, steps(F.call_function("div", F.length("d") * 8 - 1, F.lit(11)), lambda d, i: binary.bits(d, i * 11, 11))).otherwise(0)
    assert some.where(binary.codes_folded(F.col("d"), 11) != codes).count() == 0


@pytest.mark.parametrize("name", ["byte_readers", "bit_reader"])
def test_texts_are_read_at_a_good_rate(spark, tmp_path, name):
    docs(spark, 8 * MB).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    assert queries.queries()[name](spark, str(tmp_path)).count() == 1
    queries.queries()[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 8  # at microseconds a byte, as by interpreted lambdas, it took over that


def test_indexes_come_in_bounded_batches():
    walker = lambda data: ((n, n, 1, 0, n == 0, None) for n in range(25_000 if data else 0))
    files = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([b"x", None, b"y"], pa.binary())], ["path", "content"])
    sizes = [batch.num_rows for batch in frame_index._walked(walker)(iter([files]))]
    assert sum(sizes) == 50_000 and max(sizes) <= frame_index.BATCH_ROWS


def test_orders_become_bink_files_once(spark, sf_dir):
    plan = queries.queries()["bink_index"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") + plan.count("Relation [") <= 1 and "Join" not in plan


def test_sound_of_frames_is_not_shuffled(spark, sf_dir):
    plan = queries.queries()["anim_pcm"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # a task sorted the chunks of all files of a partition


def test_orders_become_files_of_both_formats_by_one_shuffle(spark, sf_dir):
    for name in ("audio_tracks", "probe_files"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan, name  # two, each behind a window and a group


def test_numbers_of_heads_are_read_at_once(spark, sf_dir):
    rows = spark.range(60).select(F.when(F.col("id") > 0, F.expr("substring(unhex(sha2(cast(id AS string), 512)), 1, cast(id - 1 AS int))")).alias("d")).repartition(3)
    places = [(0, 1, True), (3, 2, True), (3, 2, False), (10, 4, True), (16, 4, False), (31, 3, True)]
    head = binary.Head("d", "numbers", 40)
    got = [binary.uint(head, *x) for x in places]
    want = [F.coalesce(binary.uint(F.col("d"), *x), F.lit(0)) for x in places]
    assert rows.withColumn("numbers", head.read()).where(F.array(*got) != F.array(*want)).count() == 0
    with pytest.raises(ValueError, match="beyond the head"):
        head.number(38, 4, True)
    plan = queries.queries()["files_by_codec"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") < 20  # 91 before, for the headers alone
