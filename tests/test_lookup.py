"""Lookups in time and place against plain loops: keyframes, sound by time, voices."""

import random

from pyspark.sql import functions as F

from framelake.operators import audio, seek


def test_keyframes_asof_over_blocks(spark):
    rng = random.Random(1)
    keys = {(f"f{rng.randint(0, 3)}", rng.randint(0, 300)) for _ in range(40)} - {("f3", 0)}
    targets = [(rng.choice(["f0", "f1", "f2", "f3", "none"]), rng.randint(0, 400)) for _ in range(500)] + [("f0", 77)] * 300
    frame = lambda rows: spark.createDataFrame(rows, "path string, frame_index int")
    want = {(p, t): max([k for q, k in keys if q == p and k <= t], default=0) for p, t in targets}
    for block in (7, 64, 4096):
        got = seek.keyframes_asof(frame(targets), frame(list(keys)), block).collect()
        assert {(r.path, r.frame_index): r.keyframe for r in got} == want and len(got) == len(want)
    assert seek.keyframes_asof(frame([]), frame(list(keys))).count() == 0


def test_replay_ranges_by_format(spark):
    rows = [(c, 10, cursor, target) for c in ("bink", "cdxl", "yafa", "flc", "smk") for cursor in (0, 5, 9) for target in (-1, 0, 4, 5, 7, 10, 11)] + [("bink", 0, 0, 0)]
    requests = spark.createDataFrame([("p", *r) for r in rows], "path string, codec string, frame_count int, cursor int, frame_index int")
    keys = spark.createDataFrame([("p", 0), ("p", 3), ("p", 6)], "path string, frame_index int")
    for r in seek.replay_ranges(requests, keys).collect():
        can = 0 <= r.frame_index <= r.frame_count and r.frame_count > 0
        start = r.frame_index
        if r.codec not in ("cdxl", "yafa"):
            start = r.cursor if r.frame_index >= r.cursor else max(k for k in (0, 3, 6) if k <= max(r.frame_index, 0)) if r.codec == "bink" else 0
        assert (r.can_seek, r.replay_from, r.replay_frames) == ((True, start, r.frame_index - start) if can else (False, None, None)), r


def test_sound_of_a_time_lies_across_chunks(spark):
    rng = random.Random(4)
    files = {f"f{k}": [rng.randbytes(rng.choice([0, 1, 3, 50, 400])) for _ in range(30)] for k in range(3)}
    chunks = spark.createDataFrame([(p, i, 1000 * (1 + int(p[1])), 1 + int(p[1]) % 2, c) for p, cs in files.items() for i, c in enumerate(cs)] + [("f0", 99, 1000, 1, None)], "path string, frame_index int, rate bigint, channels int, pcm binary")
    asked = [(i, rng.choice(["f0", "f1", "f2", "none"]), begin, begin + rng.choice([-5, 0, 1000, 90_000, 10**9])) for i in range(60) for begin in [rng.randint(-100_000, 3_000_000)]]
    requests = spark.createDataFrame(asked, "id int, path string, begin_us bigint, end_us bigint")
    for bucket in (16, 1 << 16):
        got = {r.id: bytes(r.pcm) for r in audio.pcm_between(chunks, requests, bucket).collect()}
        assert len(got) == len(asked)
        for i, path, begin, end in asked:
            sound = b"".join(files.get(path, []))
            k = int(path[1]) if path in files else 0
            at = lambda t, k=k: max(t, 0) * 1000 * (1 + k) // 1_000_000 * (1 + k % 2)
            assert got[i] == (sound[at(begin) : at(end)] if path in files and at(begin) < at(end) else b""), (i, path)


def swept(events, most):
    """The voices of one session's (id, start, length, clear), in order."""
    sounding, out = [], {}
    for i, start, length, clear in events:
        if clear:
            sounding = []
            continue
        sounding = [e for e in sounding if e > start]
        end = start + length if length is not None else float("inf")
        if end > start and len(sounding) < most:
            sounding.append(end)
            out[i] = len(sounding)
    return out


def test_voices_end_and_seeks_clear(spark):
    rng = random.Random(9)
    rows = []
    for session in range(6):
        t = 0
        for k in range(rng.choice([1, 80, 400])):
            t += rng.choice([0, 0, 1, 5, 400])
            rows.append((session, session * 1000 + k, t, rng.choice([0, 3, 10, 60, 60, None] if session % 2 else [0, 3, 10, 60]), rng.random() < 0.02))
    rows.append((None, 9000, 5, 10, False))
    table = spark.createDataFrame(rows, "session bigint, id bigint, start bigint, length bigint, clear boolean").repartition(5)
    for most in (1, 4, 16):
        got = {r.id: r.voice for r in audio.voices(table, "session", ["start", "id"], "start", "length", "clear", most).collect()}
        want = {}
        for session in {r[0] for r in rows}:
            want |= swept([r[1:] for r in rows if r[0] == session], most)
        assert got == want
    assert audio.voices(table.drop("clear").where(F.lit(False)), "session", ["id"], "start", "length").count() == 0
