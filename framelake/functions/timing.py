"""Time in whole microseconds: frame periods by format, positions, durations, clocks. Division truncates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
# Defaults where a file gives none.
SMK_PERIOD, CDXL_FPS, DPAN_FPS, YAFA_FPS = 100_000, 12, 18, 12


def div(a: Column | int, b: Column | int) -> Column:
    """Integer division that truncates; null for a zero divisor."""
    wrap = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    return F.call_function("div", wrap(a), F.nullif(wrap(b), F.lit(0).cast("bigint")))


def fli_period(speed: Column) -> Column:
    return div(speed * SECOND, 70)


def flc_period(speed: Column) -> Column:
    return speed.cast("bigint") * 1000


def smk_period(increment: Column) -> Column:
    """Milliseconds if positive, hundredths of milliseconds if negative, ten frames a second if 0."""
    n = increment.cast("bigint")
    return F.when(n > 0, n * 1000).when(n < 0, -n * 10).otherwise(F.lit(SMK_PERIOD))


def seq_period(speed: Column) -> Column:
    return div(speed.cast("bigint") * 10_000, 60)


def anim_period(first_reltime: Column) -> Column:
    """From the first frame time that isn't 0, in sixtieths of a second; one of them where there is none."""
    return div(F.coalesce(F.nullif(first_reltime.cast("bigint"), F.lit(0)), F.lit(1)) * SECOND, 60)


def cdxl_period() -> Column:
    return F.lit(SECOND // CDXL_FPS).cast("bigint")


def yafa_period(speed: Column) -> Column:
    fps = F.when(speed == 0, F.lit(float(YAFA_FPS))).otherwise(50.0 / speed)
    return F.floor(SECOND / fps).cast("bigint")


def dpan_period(fps: Column) -> Column:
    return div(SECOND, F.when(fps == 0, DPAN_FPS).otherwise(fps))


def bink_period(fps_num: Column, fps_den: Column) -> Column:
    return div(fps_den.cast("bigint") * SECOND, fps_num)


def frame_at(pts: Column, period: Column, count: Column) -> Column:
    """Where a seek to a time lands: frames before 0 are frame 0, and the count itself is the end."""
    return F.least(div(F.greatest(pts, F.lit(0)), period), count.cast("bigint"))


def can_seek(frame: Column, count: Column) -> Column:
    """A seek to the count is a seek to the end; beyond it fails."""
    return (frame >= 0) & (frame <= count)


def loop_time(t: Column, duration: Column) -> Column:
    """A media time past the end, taken round."""
    return F.when((duration > 0) & (t >= duration), F.pmod(t, duration)).otherwise(t)


def pcm_duration(n_bytes: Column, rate: Column, channels: Column) -> Column:
    """Of interleaved 8-bit samples."""
    return div(div(n_bytes, channels) * SECOND, rate)


def pcm_offset(t: Column, rate: Column, channels: Column) -> Column:
    """The byte at which a time begins, in 8-bit samples."""
    return div(t * rate, SECOND) * channels


def audio_clock(n_bytes: Column, rate: Column, channels: Column, bits: Column) -> Column:
    """Media time of what an audio device has consumed."""
    return div(n_bytes.cast("bigint") * SECOND, rate * channels * div(bits, 8))


def pcm_float(sample: Column) -> Column:
    return sample / F.lit(128.0)


def byte_size(n: Column) -> Column:
    """B, KiB or MiB, rounded down."""
    text = lambda unit, size: F.concat(div(n, size).cast("string"), F.lit(f" {unit}"))
    return F.when(n >= 1 << 20, text("MiB", 1 << 20)).when(n >= 1 << 10, text("KiB", 1 << 10)).otherwise(text("B", 1))
