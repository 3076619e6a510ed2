"""Operations and their replay against the frame decoder, over chunks of every kind."""

import random
import struct

from pyspark.sql import functions as F

from framelake.operators import frames, write_ops


def lc(rng, w, h):
    first, n = rng.randint(0, h - 1), 0
    n = rng.randint(0, h - first)
    out = struct.pack("<HH", first, n)
    for _ in range(n):
        packets, x = b"", 0
        count = 0
        while x < w and rng.random() < 0.8:
            skip = rng.randint(0, min(7, w - x))
            size = rng.randint(0, min(9, w - x - skip))
            if rng.random() < 0.5:
                packets += bytes([skip, size]) + rng.randbytes(size)
            else:
                packets += bytes([skip, (256 - size) & 255]) + (rng.randbytes(1) if size else b"")
            x, count = x + skip + size, count + 1
        out += bytes([count]) + packets
    return out


def ss2(rng, w, h):
    y, lines, out = 0, 0, b""
    while y < h and rng.random() < 0.9:
        if rng.random() < 0.3 and y + 2 < h:
            out, y = out + struct.pack("<H", 0x10000 - 2), y + 2
        if rng.random() < 0.3:
            out += struct.pack("<H", 0x8000 | rng.randint(0, 255))
        packets, x, count = b"", 0, 0
        while x + 2 <= w and rng.random() < 0.7:
            skip = rng.randint(0, min(6, w - x - 2))
            size = rng.randint(1, (w - x - skip) // 2)
            packets += bytes([skip, size]) + rng.randbytes(2 * size) if rng.random() < 0.5 else bytes([skip, 256 - size]) + rng.choice([b"\1\1", b"\2\3"])
            x, count = x + skip + 2 * size, count + 1
        out, y, lines = out + struct.pack("<H", count) + packets, y + 1, lines + 1
    return struct.pack("<H", lines) + out


def brun(rng, w, h):
    out = b""
    for _ in range(h):
        out, x = out + b"\0", 0
        while x < w:
            n = rng.randint(1, min(20, w - x))
            out += bytes([n]) + rng.randbytes(1) if rng.random() < 0.5 else bytes([256 - n]) + rng.randbytes(n)
            x += n
    return out


def flc(rng, w, h, n, bad=None):
    body = b""
    for k in range(n):
        kinds = [rng.choice([16, 15, 13])] if k == 0 or rng.random() < 0.25 else rng.choices([7, 12, 13, 18], [5, 5, 1, 1], k=rng.randint(0, 2))
        made = {7: lambda: ss2(rng, w, h), 12: lambda: lc(rng, w, h), 13: lambda: b"", 15: lambda: brun(rng, w, h), 16: lambda: rng.randbytes(w * h), 18: lambda: b"stamp!"}
        payloads = [(kind, made[kind]()) for kind in kinds]
        if k == bad:
            payloads = [(12, struct.pack("<HH", h, 3))]
        chunks = b"".join(struct.pack("<IH", len(p) + 6, kind) + p for kind, p in payloads)
        body += struct.pack("<IHH8x", len(chunks) + 16, 0xF1FA, len(payloads)) + chunks
    return struct.pack("<IHHHHHHI", len(body) + 128, 0xAF12, n, w, h, 8, 3, 33).ljust(128, b"\0") + body


def files(spark):
    rng = random.Random(6)
    made = [(f"f{k}", flc(rng, *size, 14)) for k, size in enumerate([(20, 6), (16, 4), (33, 5), (1, 3), (50, 2)])]
    made += [("bad", flc(rng, 20, 6, 9, bad=5)), ("bad0", flc(rng, 20, 6, 3, bad=0)), ("empty", b""), ("null", None), ("short", made[0][1][:40])]
    return spark.createDataFrame(made, "path string, content binary")


def test_replay_matches_the_decoder_and_ranges_read_their_segments(spark, tmp_path):
    media = files(spark)
    want = {(r.path, r.frame_index): (r.width, r.height, bytes(r.pixels)) for r in frames.decode_frames(media.select("path", F.lit("flc").alias("codec"), "content")).collect() if r.pixels is not None}
    ops = write_ops.write_ops(media)
    rows = lambda df: {(r.path, r.frame_index): (r.width, r.height, bytes(r.pixels)) for r in df.collect()}
    assert rows(write_ops.replay(ops)) == want and {k for k in want if k[0] == "bad"} == {("bad", k) for k in range(5)}
    assert {r.path for r in ops.where("op = 'error'").collect()} == {"bad", "bad0"}
    write_ops.store_ops(ops, f"{tmp_path}/ops")
    stored = spark.read.parquet(f"{tmp_path}/ops")
    for first, last in ((0, 0), (4, 9), (8, 8), (13, 20), (30, 40)):
        part = write_ops.replay(stored, first, last)
        assert rows(part) == {k: v for k, v in want.items() if first <= k[1] <= last}
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = write_ops.replay(stored.where("path = 'f0'"), 8, 9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(until,8)" in plan and "LessThanOrEqual(frame_index,9)" in plan and "EqualTo(path,f0)" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    needed = stored.where("path = 'f0' AND until >= 8 AND frame_index <= 9 AND op <> 'size'")
    assert 0 < needed.count() < stored.where("path = 'f0' AND frame_index <= 9 AND op <> 'size'").count()


def test_replay_writes_no_row_a_pixel(spark):
    picture = random.Random(3).randbytes(320 * 200)
    chunk = struct.pack("<IH", len(picture) + 6, 16) + picture
    frame = struct.pack("<IHH8x", len(chunk) + 16, 0xF1FA, 1) + chunk
    still = struct.pack("<IHH8x", 16, 0xF1FA, 0)
    content = struct.pack("<IHHHHHHI", 128 + len(frame) + 16 * 199, 0xAF12, 200, 320, 200, 8, 3, 33).ljust(128, b"\0") + frame + still * 199
    media = spark.createDataFrame([("large", content)], "path string, content binary")
    rows = write_ops.replay(write_ops.write_ops(media))
    assert [(r.frame_index, bytes(r.pixels)) for r in rows.orderBy("frame_index").collect()] == [(k, picture) for k in range(200)]
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
