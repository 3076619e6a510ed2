"""Cels against a painter that sets one bit after the other."""

import random
import struct

from framelake.operators import seq
from framelake.plans import queries


def runs(rng, words):
    """A run-length stream of the words: literal and repeated ones in turn."""
    out, at = b"", 0
    while at < len(words):
        n = rng.randint(1, 9)
        same = next((k for k in range(1, len(words) - at) if words[at + k] != words[at]), len(words) - at)
        if same > 1 and rng.random() < 0.7:
            out, at = out + struct.pack(">HH", same, words[at]), at + same
        else:
            part = words[at : at + n]
            out, at = out + struct.pack(f">H{len(part)}H", 0x8000 | len(part), *part), at + len(part)
    return out


def cel(resolution, x, y, w, h, op, storage, body, palette=range(16)):
    return (struct.pack(">HH16H18x4H2BI", 0xFFFF, resolution, *palette, x, y, w, h, op, storage, len(body))).ljust(128, b"\0") + body


def file_of(cels):
    return struct.pack(">HHIH", 0xFEDB, 0, len(cels), 33).ljust(128, b"\0") + b"\xaa" * 4 * len(cels) + b"".join(cels)


def painted(resolution, cels):
    """The picture after each (x, y, w, h, op, storage, words), as pixels by place."""
    width, height, planes = seq.SCREENS[resolution]
    bits, shots = {}, []
    for x, y, w, h, op, storage, words in cels:
        if storage == 1 and words:
            if op == 0:
                bits = {}
            places = [(b, x + g, row) for b in range(planes) for g in range(0, w, 16) for row in range(y, y + h)]
            for (b, left, row), word in zip(places, words, strict=False):
                for i in range(16):
                    if left + i < width and word >> (15 - i) & 1:
                        key = (b, left + i, row)
                        bits[key] = bits.get(key, 0) ^ 1
        shot = {}
        for (b, px, row), bit in bits.items():
            if bit:
                shot[px, row] = shot.get((px, row), 0) | 1 << b
        shots.append(shot)
    return shots


def some_file(rng, resolution, n):
    width, height, planes = seq.SCREENS[resolution]
    told = []
    for k in range(n):
        w, h = rng.randint(1, 60), rng.randint(1, 6)
        x, y = rng.choice([rng.randint(0, width - w), width - w, 0]), rng.choice([rng.randint(0, height - h), 3])
        words = [rng.choice([0, 0, 0xFFFF, rng.randint(0, 0xFFFF)]) for _ in range((w + 15) // 16 * h * planes)]
        words = words[: rng.choice([len(words), len(words) // 2])]  # a stream may end early
        told.append((x, y, w, h, int(k % 5 > 0), 0 if rng.random() < 0.1 else 1, [] if rng.random() < 0.1 else words))
    body = lambda words: runs(rng, words) if words else b""
    return file_of([cel(resolution, *t[:6], body(t[6])) for t in told]), painted(resolution, told)


def test_pictures_match_a_painter(spark):
    rng = random.Random(2)
    made = {f"f{r}{k}": (r, *some_file(rng, r, 9)) for r in seq.SCREENS for k in range(3)}
    media = spark.createDataFrame([(p, x[1]) for p, x in made.items()], "path string, content binary")
    cels = seq.seq_cels(media)
    assert cels.where("error IS NOT NULL").count() == 0
    wanted = [(p, k) for p in made for k in (0, 4, 7, 8)]
    got = {(r.path, r.frame_index): r.pixels for r in seq.seq_pictures(cels, spark.createDataFrame(wanted, "path string, frame_index int")).collect()}
    assert got.keys() == set(wanted)
    for path, k in wanted:
        resolution, _, shots = made[path]
        width, height, _ = seq.SCREENS[resolution]
        assert len(got[path, k]) == width * height
        assert {(i % width, i // width): v for i, v in enumerate(got[path, k]) if v} == shots[k], (path, k)
    for r in seq.seq_screens(seq.seq_words(cels)).collect():
        shot = made[r.path][2][r.frame_index]
        assert list(r.pixels) == [shot.get((r.column * 16 + i, r.y), 0) for i in range(16)]


def test_broken_cels_and_palettes(spark):
    good = cel(1, 0, 0, 16, 1, 0, 1, struct.pack(">HH", 2, 0xF0F0), [0x777, 0x070, 0x007, 0x700, *[0x777] * 12])
    files = {
        "outside": [good, cel(1, 630, 0, 16, 1, 1, 1, b"\0\1\0\1")], "operation": [good, cel(1, 0, 0, 16, 1, 2, 1, b"\0\1\0\1"), good], "count": [good, cel(1, 0, 0, 16, 2, 1, 1, b"\0\1\0\1\x80")],
        "run": [good, cel(1, 0, 0, 16, 2, 1, 1, struct.pack(">HHH", 0x8004, 1, 2))], "resolution": [cel(7, 0, 0, 16, 1, 0, 1, b"\0\1\0\1")],
    }
    data = [(k, file_of(v)) for k, v in files.items()] + [("cut", file_of([good, good])[:-2]), ("empty", b""), ("none", None), ("plain", file_of([good] * 3))]
    cels = seq.seq_cels(spark.createDataFrame(data, "path string, content binary"))
    found = {}
    for r in cels.orderBy("path", "frame_index").collect():
        found.setdefault(r.path, []).append(r.error)
    assert found == {"outside": [None, "cel outside its screen"], "operation": [None, "unknown resolution, operation or storage"], "count": [None, "cut short at a count"], "run": [None, "cut short in a run"],
                     "resolution": ["unknown resolution, operation or storage"], "cut": [None, "cel cut short"], "plain": [None] * 3}
    colours = seq.seq_palettes(cels.where("path = 'plain'")).first().palette
    assert [tuple(c) for c in colours[:5]] == [(255, 255, 255), (0, 255, 0), (0, 0, 255), (255, 0, 0), (0, 0, 0)]
    assert [list(r.pixels) for r in seq.seq_screens(seq.seq_words(cels.where("path = 'plain' AND frame_index = 0"))).collect()] == [[3, 3, 3, 3, 0, 0, 0, 0] * 2]


def test_cels_are_shown_as_their_places_are(spark, sf_dir):
    rng = random.Random(9)
    made = [(f"f{r}{k}", some_file(rng, r, 12)[0]) for r in seq.SCREENS for k in range(3)]
    files = spark.createDataFrame([*made, ("cut", made[0][1][:-3]), ("empty", b""), ("none", None)], "path string, content binary").repartition(3)
    want, got = {}, {}
    for r in seq.seq_screens(seq.seq_words(seq.seq_cels(files).where("error IS NULL"))).collect():
        want.setdefault((r.path, r.frame_index, r.segment), {})[r.y, r.column] = bytes(r.pixels)
    for r in seq.seq_shown(files).collect():
        got[r.path, r.frame_index, r.segment] = {divmod(p, r.columns): bytes(r.pixels[16 * k : 16 * k + 16]) for k, p in enumerate(r.places)}
    assert got == want and len(got) > 60
    plan = queries.queries()["seq_cels"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # a row for 16 pixels was shuffled
