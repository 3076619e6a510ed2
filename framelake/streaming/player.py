"""A player a session over a stream of ticks: what to show, kept as state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session_id string, media_time_us bigint, frame_index bigint, rendered boolean, eos boolean"
STATE = "last_index bigint, ended boolean, playing boolean"


def present_stream(ticks: DataFrame, period_us: int, count: int, loop: bool = False) -> DataFrame:
    """Ticks (``session_id``, ``seq``, ``media_time_us``, ``control``) to presented frames.

    A session's ticks of a micro-batch are taken in order of ``seq``; an earlier time is a seek back. ``control`` is
    null or one of play, pause, rewind, seek: paused sessions show nothing, and rewind and seek forget the frame shown.
    """
    if period_us <= 0:
        raise ValueError("a frame period must be above 0")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended, playing = state.get if state.exists else (-1, False, True)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for t, control in zip(rows["media_time_us"], rows["control"], strict=True):
            if control in ("play", "pause"):
                playing = control == "play"
            elif control in ("rewind", "seek"):
                last, ended = -1, False
            if not playing:
                continue
            t = 0 if control == "rewind" else max(0, int(t))
            index = (t % (period_us * count) if loop and count else t) // period_us
            over = index >= count
            out.append((key[0], t, index, not over and index != last, over and not ended))
            last, ended = (last, True) if over else (index, False)
        state.update((int(last), bool(ended), bool(playing)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return ticks.groupBy("session_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def new_media(spark, path: str, max_files: int | None = None) -> DataFrame:
    """Files as they arrive under a path, as a stream of ``path``, ``modificationTime``, ``length`` and ``content``."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
