"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over the source's size, the same for all documents of the
source. Within a source the documents stand in order of size; their expected copies are summed up from the left, one
random offset is added to the sum, and a document is taken once for each whole number that its share crosses. As
neighbours are of like size, the words taken come within about one document of the target.

The order is made by range partitioning and a sort, so a source of a third of all rows is spread over many tasks; a
row's rank is its place in its partition plus the rows of the source in earlier ones. Only a row a source reaches the
driver; ``MAX_SOURCES`` bounds them.

Defined results: a null or empty text has size 0; a null source is a source of its own, last in order; a source of
size 0 has target 0 and is never taken; repeated rows and null ids are rows like any other; an empty table gives no
rows; the result depends on the rows and ``seed`` alone, not on partitions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import fresh, materialize, own_columns, split_words

WEIGHTS, MAX_REPEATS, SEED = (5.0, 2.0, 1.0), 3, 20240
MAX_SOURCES = 1_000_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Each source's words: ``share`` of all, by weight, at most ``most`` times its size; what is cut goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    found, left, open_ = {}, share * sum(sizes.values()), order
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not over:
            return found | {s: left * weight[s] / whole for s in open_}
        found |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in found]
    return found


def _size(text: Column) -> Column:
    return F.size(split_words(text)).cast("bigint")


def systematic_sample(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target`` and ``copies`` for each row."""
    spark = docs.sparkSession
    sized = docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), _size(F.col(text)).alias("size"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = materialize(sized)
    placed = sized.repartitionByRange(n, F.col("source").asc_nulls_last(), "size", "id").sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "id")
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()))  # partition number, then place in it
    part = F.shiftright("at", 33)
    runs = placed.groupBy("source", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))))
    rows = runs.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    sizes = {r["source"]: r["words"] for r in rows}
    goal = targets(sizes, weights, share)
    rows = [(s, sizes[s], goal[s], goal[s] / sizes[s] if sizes[s] else 0.0) for s in sizes]
    kinds = {"source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "rate": pa.float64()}
    # as Arrow: rows of Python objects would be turned into Spark's by further Python processes on the executors
    wanted = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())}))
    runs = runs.alias("r").join(wanted.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source"))).select("r.source", "part", "first", "before", "source_size", "target", "rate")
    rank = F.col("before") + F.col("at") - F.col("first")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("p.source", F.lit("")))), 1, 13)
    offset = F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))
    crossed = F.floor(offset + F.col("rate") * (rank + 1)) - F.floor(offset + F.col("rate") * rank)
    joined = placed.alias("p").join(runs.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")) & (F.shiftright("p.at", 33) == F.col("part")))
    return joined.select("id", F.col("p.source").alias("source"), "size", "source_size", "target", F.least(crossed, F.lit(MAX_REPEATS)).cast("int").alias("copies"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it, with its own columns.

    Rows equal in id, source and size share their copies out in the order of their texts.
    """
    name = fresh(docs.columns, "_mix")
    taken = systematic_sample(docs, id, text, source, **options).groupBy("id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = taken.where("copies > 0").select(*[F.col(c).alias(f"{name}{c}") for c in taken.columns])
    keys = {"id": F.col(f"`{id}`"), "source": F.col(f"`{source}`").cast("string"), "size": _size(F.col(f"`{text}`"))}
    on = [F.col(f"{name}{c}").eqNullSafe(F.col(f"{name}own_{c}")) for c in keys]
    rows = docs.withColumns({f"{name}own_{c}": k for c, k in keys.items()}).join(taken, on)
    alike = Window.partitionBy(*[f"{name}own_{c}" for c in keys]).orderBy(F.col(f"`{text}`"))
    place = F.row_number().over(alike)
    share = F.floor(F.col(f"{name}copies") * F.col(f"{name}n") / F.col(f"{name}rows")) - F.floor(F.col(f"{name}copies") * (F.col(f"{name}n") - 1) / F.col(f"{name}rows"))
    rows = rows.withColumn(f"{name}n", place).withColumn(f"{name}n", share.cast("int")).where(f"{name}n > 0")
    return own_columns(rows.withColumn(f"{name}n", F.explode(F.sequence(F.lit(1), F.col(f"{name}n")))), docs)
