import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, target, percent, min_words, run, buckets):
    """id, number of features, weight, score; ranks by id and score."""
    runs = lambda ws: [" ".join(ws[i : i + n]) for n in range(1, run + 1) for i in range(len(ws) - n + 1)]
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for x in texts for f in runs(words(x))) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(at(f)) for f in runs(words(x)))
        rows.append((i, len(runs(words(x))), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x))))
    apt = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(r[0], r[3], k + 1) for k, r in enumerate(apt[: percent * len(apt) // 100])]
    return sorted((r[:4] for r in rows), key=repr), sorted(ranks, key=repr)


@pytest.mark.parametrize(("percent", "run"), [(10, 1), (50, 2), (100, 1), (0, 1)])
def test_draw_matches_brute_force(spark, documents, percent, run):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    target = ["The stone and the river!", None, "", "winter MUSIC paper 42"]
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = R.resample(documents, goal, percent=percent, run=run, buckets=997).select("doc_id", "_draw.*").collect()
    rows, ranks = brute(docs, target, percent, 20, run, 997)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == rows
    assert sorted(((r.doc_id, r.score, r["rank"]) for r in got if r["rank"]), key=repr) == ranks


def test_ties_go_to_small_ids_then_to_any_row(spark):
    one = F.struct(F.lit(9).cast("bigint").alias("n_features"), F.lit(30).cast("bigint").alias("n_words"), F.lit(5).cast("bigint").alias("weight"), F.lit(7).cast("bigint").alias("score"))
    rows = spark.createDataFrame([(i,) for i in [*range(40), *[40] * 30, *[None] * 30]], "doc_id bigint").repartition(4).withColumn("_draw", one)
    for percent, drawn in ((20, {*range(20)}), (50, {*range(41)}), (90, {*range(41), None})):
        got = [r for r in R.draw(rows, percent=percent).select("doc_id", "_draw.rank").collect() if r["rank"]]
        assert {r.doc_id for r in got} == drawn and sorted(r["rank"] for r in got) == list(range(1, percent + 1))
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.doc_id for r in got), key=lambda x: (x is None, x or 0))


def test_columns_are_kept_and_empty_tables_pass(spark, documents):
    clash = documents.withColumn("row", F.lit("x")).withColumn("place", F.lit("y")).withColumn("_p", F.lit(1)).withColumn("_before", F.lit(2))
    goal = documents.select("text").limit(3)
    got = R.resample(clash, goal)
    assert got.columns == [*clash.columns, "_draw"] and got.count() == documents.count() and got.where("_draw.rank IS NOT NULL").select("row", "place", "_p", "_before").distinct().count() == 1
    assert R.resample(documents.limit(0), goal).count() == 0
    assert R.resample(documents, goal.limit(0)).where("_draw.rank IS NOT NULL").count() > 0
    with pytest.raises(TypeError):
        R.resample(documents.withColumn("doc_id", F.col("key")), goal)


def test_halving_reads_few_counts():
    values = np.sort(np.random.default_rng(1).integers(-(10**9), 10**9, 500))
    jobs = []

    def count(cuts):
        jobs.append(len(cuts))
        return [int((values <= c).sum()) for c in cuts]

    for wanted in (1, 17, 500):
        jobs.clear()
        assert R.smallest_reaching(count, int(values[0]), int(values[-1]), wanted) == values[wanted - 1] and len(jobs) <= 9
