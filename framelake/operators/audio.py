"""Sound: samples out of CDXL chunks, durations, and events against a bank of sounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.binary import once, u8, u16be, u32be
from framelake.functions.timing import CDXL_FPS, div, pcm_offset


def cdxl_audio(media: DataFrame) -> DataFrame:
    """``path``, ``frame_index``, ``rate``, ``channels`` and ``pcm``, the last bytes of each chunk, as they are. Chunks are read where the content lies."""

    def chunks(data: Column) -> Column:
        stride = u32be(data, 2)
        n = F.coalesce(div(F.length(data), stride), F.lit(0))
        numbers = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
        return once(stride, lambda step: F.transform(numbers, lambda i: sound(data, i * step, i)))

    def sound(data: Column, at: Column, i: Column) -> Column:
        channels = F.when(u8(data, at + 1).bitwiseAND(F.lit(0x10).cast("bigint")) != 0, 2).otherwise(1)
        held = u16be(data, at + 22)
        pcm = F.substring(data, (at + u32be(data, at + 2) - held + 1).cast("int"), held.cast("int"))
        return F.struct(i.cast("int").alias("frame_index"), div(held * CDXL_FPS, channels).alias("rate"), channels.alias("channels"), F.when(held > 0, pcm).alias("pcm"))

    # outer, as otherwise Spark filters on the chunks first and so makes them twice
    return media.select("path", F.explode_outer(once(F.col("content"), chunks)).alias("c")).where("c.pcm IS NOT NULL").select("path", "c.*")


def sound_events(controls: DataFrame, bank: DataFrame) -> DataFrame:
    """Controls (``path``, ``frame_index``, ``seq``, ``sound``, ``volume``, ``repeats``) with the sounds they name.

    Sounds count from 1; 0 and numbers beyond the bank name none and are dropped. Volume is in 64ths, at most 1.
    """
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("volume") / F.lit(64.0)))
    slots = bank.select("path", F.col("slot").alias("sound"), "sound_bytes")
    return controls.where(F.col("sound") > 0).join(slots, ["path", "sound"]).select("path", "frame_index", "seq", F.col("sound").alias("slot"), "sound_bytes", level.alias("volume"), "repeats")


def cap_events(events: DataFrame, tick: list[str], order: list[str], most: int = 16) -> DataFrame:
    """The events that fire when at most ``most`` may sound at a tick."""
    return events.withColumn("voice", F.row_number().over(Window.partitionBy(*tick).orderBy(*order))).where(F.col("voice") <= most)


#: Bytes of sound that meet under one key.
BUCKET = 1 << 16


def pcm_between(chunks: DataFrame, requests: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``requests`` (``path``, ``begin_us``, ``end_us`` and others) with the exact bytes of sound of that time (``pcm``), across the borders of chunks.

    ``chunks``: ``path``, ``frame_index``, ``rate``, ``channels``, ``pcm``, of one rate and number of channels a file. A
    chunk's place is the sum of the bytes before it. Requests meet chunks by file and bucket of bytes, and a pair once: in
    the first bucket that both lie in. What is gathered for a request is the sound that it asks for.
    """
    before = Window.partitionBy("path").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("pcm").cast("bigint")
    cut = lambda at: F.call_function("div", at, F.lit(bucket))
    spread = lambda a, b: F.explode(F.sequence(cut(a), cut(b)))
    placed = chunks.where(n > 0).withColumn("start", F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn("stop", F.col("start") + n)
    placed = placed.select("path", "start", "stop", "pcm", spread(F.col("start"), F.col("stop") - 1).alias("bucket"))
    form = chunks.groupBy("path").agg(F.first("rate").alias("rate"), F.first("channels").alias("channels"), F.sum(n).alias("held"))
    asked = requests.join(form, "path", "left")
    at = lambda c: pcm_offset(F.greatest(F.col(c), F.lit(0)), F.col("rate"), F.col("channels"))
    asked = asked.withColumns({"low": F.coalesce(at("begin_us"), F.lit(0)), "high": F.least(F.coalesce(at("end_us"), F.lit(0)), F.coalesce("held", F.lit(0)))}).drop("rate", "channels", "held")
    # equal requests are answered once
    wanted = asked.where("low < high").select("path", "low", "high").distinct().select("path", "low", "high", spread(F.col("low"), F.col("high") - 1).alias("bucket"))
    met = wanted.join(placed, ["path", "bucket"]).where((F.col("start") < F.col("high")) & (F.col("stop") > F.col("low")) & (F.col("bucket") == F.greatest(cut(F.col("low")), cut(F.col("start")))))
    first, last = F.greatest("low", "start"), F.least("high", "stop")
    piece = F.substring(F.col("pcm"), (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
    parts = met.select("path", "low", "high", F.struct(first.alias("at"), F.hex(piece).alias("digits")).alias("part")).groupBy("path", "low", "high").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = F.unhex(F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<at: bigint, digits: string>>")), lambda p: p["digits"]), ""))
    return asked.join(parts, ["path", "low", "high"], "left").select(*requests.columns, whole.alias("pcm"))


def voices(events: DataFrame, session: str, order: list[str], start: str, length: str, clear: str | None = None, most: int = 16) -> DataFrame:
    """The sounds that get one of ``most`` voices (``voice``, from 1 on: those sounding then, with this one).

    A sound holds its voice from ``start`` for ``length`` microseconds, without end if that is null; a sound of no length is
    none. One that finds no free voice is dropped and never sounds. A row with ``clear`` sounds not, and frees all voices, as a seek does.

    Sounds that begin when none before them can still sound make a part of their own; a running maximum finds these parts,
    so that a long session is spread over tasks. Each part is swept in order, with the ends of the active sounds in hand.
    """
    silence = F.col(clear) if clear else F.lit(False)
    clears = F.coalesce(F.sum(silence.cast("bigint")).over(Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    end = F.when(silence, F.lit(0)).otherwise(F.col(start) + F.coalesce(F.col(length), F.lit((1 << 62) - 1) - F.col(start)))
    rows = events.withColumns({"_end": end.cast("bigint"), "_cleared": clears, "_silent": silence})
    since = Window.partitionBy(session, "_cleared").orderBy(*order)
    before = F.max("_end").over(since.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_idle", (F.coalesce(before, F.lit(0)) <= F.col(start)).cast("bigint"))
    rows = rows.withColumn("_part", F.sum("_idle").over(since.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = rows.where(~F.col("_silent") & (F.col("_end") > F.col(start))).repartition(session, "_cleared", "_part").sortWithinPartitions(session, "_cleared", "_part", *order)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sounding = None, []
        for batch in batches:
            names, taken = batch.schema.names, []
            keys = zip(*(batch.column(names.index(c)).to_pylist() for c in (session, "_cleared", "_part", start, "_end")), strict=True)
            for *key, begin, stop in keys:
                if key != part:
                    part, sounding = key, []
                while sounding and sounding[0] <= begin:
                    heapq.heappop(sounding)
                if len(sounding) < most:
                    heapq.heappush(sounding, stop)
                    taken.append(len(sounding))
                else:
                    taken.append(None)
            kept = batch.append_column("voice", pa.array(taken, pa.int32()))
            yield kept.filter(pa.array([v is not None for v in taken], pa.bool_()))

    found = dealt.mapInArrow(sweep, dealt.withColumn("voice", F.lit(None).cast("int")).schema)
    return found.select(*events.columns, "voice")


def interleave(halves: DataFrame, n: str = "n") -> DataFrame:
    """Stereo chunks that hold all left samples, then all right ones: the place of each sample (``at``) once interleaved."""
    half = F.call_function("div", F.col(n), F.lit(2))
    return halves.withColumn("at", F.when(F.col("i") < half, F.col("i") * 2).otherwise((F.col("i") - half) * 2 + 1))
