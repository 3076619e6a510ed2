"""From media time to frames: what a player shows at each tick, as an as-of lookup without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.timing import div, loop_time


def present_asof(ticks: DataFrame, session: list[str], order: list[str], time: str, period: Column, count: Column, loop: bool = False) -> DataFrame:
    """``ticks`` with ``frame_index``, ``rendered`` and ``eos``.

    The frame of a time is the time over the period. A frame is rendered when it differs from the one shown before.
    Past the last frame a session is at its end, which is told once (``eos``), or begins again with ``loop``.
    """
    t = F.greatest(F.col(time).cast("bigint"), F.lit(0).cast("bigint"))
    at = loop_time(t, period * count) if loop else t
    rows = ticks.withColumn("frame_index", div(at, period)).withColumn("_over", F.col("frame_index") >= count)
    w = Window.partitionBy(*session).orderBy(*order)
    changed = ~F.col("frame_index").eqNullSafe(F.lag("frame_index").over(w))
    return rows.withColumns({
        "rendered": ~F.col("_over") & changed,
        "eos": F.col("_over") & ~F.coalesce(F.lag("_over").over(w), F.lit(False)),
    }).drop("_over")


def player_parity(ticks: DataFrame, session: list[str], order: list[str], time: str, period: Column, count: Column) -> DataFrame:
    """As present_asof, but the first tick of a session shows frame 0 whatever its time, as a fresh player does."""
    rows = present_asof(ticks, session, order, time, period, count)
    first = F.row_number().over(Window.partitionBy(*session).orderBy(*order)) == 1
    shown = rows.withColumn("_first", first).withColumn("frame_index", F.when(F.col("_first"), F.lit(0).cast("bigint")).otherwise(F.col("frame_index")))
    before = F.lag("frame_index").over(Window.partitionBy(*session).orderBy(*order))
    return shown.withColumn("rendered", (F.col("frame_index") < count) & ~F.col("frame_index").eqNullSafe(before)).drop("_first")


def realtime_clock(ticks: DataFrame, session: list[str], order: list[str], delta: str, paused: Column) -> DataFrame:
    """A clock that adds up ticks (``media_time_us``): none while paused, and no negative ones."""
    step = F.when(~paused & (F.col(delta) >= 0), F.col(delta)).otherwise(0).cast("bigint")
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumn("media_time_us", F.sum(step).over(w))


def transport_clock(ticks: DataFrame, session: list[str], order: list[str], delta: str, control: str, value: str) -> DataFrame:
    """A clock under control (``media_time_us``, ``paused``): a tick's row adds its delta, or does what its ``control`` says.

    ``pause`` and ``resume`` hold and go on, ``seek`` sets the time to ``value``, ``rewind`` to 0, ``external`` too sets it,
    as a clock from outside does; null is a tick. Controls add no time themselves, ticks none while paused or if negative.
    """
    upto = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(control)
    to = F.when(c == "rewind", 0).when(c.isin("seek", "external"), F.col(value)).cast("bigint")
    held = F.coalesce(F.last(F.when(c == "pause", True).when(c == "resume", False), ignorenulls=True).over(upto), F.lit(False))
    rows = ticks.withColumns({"paused": held, "_to": to}).withColumn("_part", F.count("_to").over(upto))
    step = F.when(c.isNull() & ~F.col("paused") & (F.col(delta) >= 0), F.col(delta)).otherwise(0).cast("bigint")
    within = Window.partitionBy(*session, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce(F.first("_to", ignorenulls=True).over(within), F.lit(0))
    return rows.withColumn("media_time_us", base + F.sum(step).over(within)).drop("_to", "_part")


def frame_checksum(pixels: Column) -> Column:
    """The sum of a buffer's first, middle and last byte."""
    byte = lambda at: F.conv(F.hex(F.substring(pixels, at + 1, F.lit(1))), 16, 10).cast("bigint")
    n = F.length(pixels)
    return F.when(n > 0, byte(F.lit(0)) + byte(F.shiftright(n, 1)) + byte(n - 1)).otherwise(F.lit(0).cast("bigint"))
