"""Byte-vertical deltas against a player with two buffers."""

import random
import struct

import pytest

from framelake.operators import anim_delta
from framelake.plans import queries


def chunk(kind, body):
    return kind.encode() + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)


def form(kind, *chunks):
    return chunk("FORM", kind.encode() + b"".join(chunks))


def column(rng, height):
    """A column's operations, and what they do: (row, byte) in order."""
    ops, does, y = b"", [], 0
    for n in range(rng.randint(0, 4)):
        kind, k = rng.randint(0, 2), rng.randint(1, height)
        if kind == 0:
            ops, y = ops + bytes([k]), y + k
        elif kind == 1:
            v = rng.randint(0, 255)
            ops += bytes([0, k, v])
            does, y = does + [(y + i, v) for i in range(k)], y + k
        else:
            data = rng.randbytes(k)
            ops += bytes([0x80 | k]) + data
            does, y = does + [(y + i, b) for i, b in enumerate(data)], y + k
        count = n + 1
    return bytes([locals().get("count", 0)]) + ops, [(y, b) for y, b in does if y < height]


def packed(body):
    out = b""
    for at in range(0, len(body), 50):
        part = body[at : at + 50]
        out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return out + b"\x80"


def some_file(rng, width, height, planes, n, pack):
    """The file, and for each frame the picture as bytes by (plane, row, column)."""
    columns = (width + 7) // 8
    bmhd = chunk("BMHD", struct.pack(">HHHHBBBB", width, height, 0, 0, planes, 0, int(pack), 0).ljust(20, b"\0"))
    frames, shots, a, b = [], [], {}, {}
    for k in range(n):
        if k == 0 or rng.random() < 0.15:
            body = bytes(rng.choice([0, 0, 255, rng.randint(0, 255)]) for _ in range(columns * planes * height))
            frames.append(form("ILBM", bmhd, chunk("BODY", packed(body) if pack else body)))
            a = {(i % (columns * planes) // columns, i // (columns * planes), i % columns): v for i, v in enumerate(body)}
            b = dict(a)
            shots.append(dict(a))
            continue
        bits = rng.choice([0, 0, 2, 1])
        table, data = [], b""
        for p in range(planes):
            if rng.random() < 0.4:
                table.append(0)
                continue
            table.append(64 + len(data))
            for c in range(columns):
                ops, does = column(rng, height)
                data += ops
                for y, v in does:
                    a[p, y, c] = v
        anhd = chunk("ANHD", (b"\5" + b"\0" * 19 + struct.pack(">I", bits)).ljust(24, b"\0"))
        delta = struct.pack(f">{len(table)}I", *table).ljust(64, b"\0") + data
        frames.append(form("ILBM", anhd, chunk("DLTA", delta)))
        shots.append(dict(a))
        if bits != 2:
            a, b = b, a
    return form("ANIM", *frames), shots


def test_screens_match_a_player(spark):
    rng = random.Random(12)
    made = {f"f{k}": some_file(rng, w, h, p, 25, k % 2) for k, (w, h, p) in enumerate([(16, 5, 3), (8, 9, 8), (20, 3, 1), (33, 4, 5)])}
    runs = anim_delta.anim_runs(spark.createDataFrame([(p, x[0]) for p, x in made.items()], "path string, content binary").repartition(2)).cache()
    assert runs.where("kind = 'error'").count() == 0
    rows = anim_delta.anim_screens(runs).collect()
    touched = {}
    for r in rows:
        shot = made[r.path][1][r.frame_index]
        want = [shot.get((p, r.y, r.column), 0) for p in range(8)]
        assert [r[f"plane{p}"] for p in range(8)] == want, r
        assert list(r.pixels) == [sum((want[p] >> (7 - i) & 1) << p for p in range(8)) for i in range(8)]
        touched.setdefault((r.path, r.frame_index), set()).add((r.y, r.column))
    for path, (_, shots) in made.items():  # what is not touched is what the buffer held before
        for k, shot in enumerate(shots):
            for before in (1, 2):
                if k >= before and all(r["swaps"] for r in runs.where(f"path = '{path}' AND kind = 'frame' AND frame_index BETWEEN {k - 2} AND {k}").collect()) and before == 2:
                    changed = {(y, c) for (p, y, c), v in shot.items() if shots[k - 2].get((p, y, c), 0) != v}
                    assert changed <= touched.get((path, k), set())


@pytest.mark.parametrize(("delta", "message"), [(b"\0" * 10, "delta without its table"), (struct.pack(">I", 999).ljust(64, b"\0"), "plane beyond the delta"), (struct.pack(">I", 64).ljust(64, b"\0") + b"\1", "delta cut short"), (struct.pack(">I", 64).ljust(64, b"\0") + b"\1\x85ab", "delta cut short")])
def test_broken_deltas_end_a_file(delta, message):
    bmhd = chunk("BMHD", struct.pack(">HHHHBBBB", 8, 2, 0, 0, 1, 0, 0, 0).ljust(20, b"\0"))
    anhd = lambda op: chunk("ANHD", bytes([op]).ljust(24, b"\0"))
    frames = [form("ILBM", bmhd, chunk("BODY", b"ab")), form("ILBM", anhd(5), chunk("DLTA", delta)), form("ILBM", anhd(5), chunk("DLTA", delta))]
    rows = list(anim_delta.runs_of(form("ANIM", *frames)))
    assert (rows[-1][0], rows[-1][1], rows[-1][-1]) == (1, "error", message) and [r[1] for r in rows] == ["frame", "body", "error"]
    other = list(anim_delta.runs_of(form("ANIM", frames[0], form("ILBM", anhd(7), chunk("DLTA", delta)))))
    assert other[-1][-1] == "operation 7" and list(anim_delta.runs_of(b"")) == []


def test_packed_pictures_cut_short_are_errors():
    bmhd = chunk("BMHD", struct.pack(">HHHHBBBB", 8, 6, 0, 0, 1, 0, 1, 0).ljust(20, b"\0"))
    whole, short = (list(anim_delta.runs_of(form("ANIM", form("ILBM", bmhd, chunk("BODY", body))))) for body in (packed(b"aabbcc"), b"\x05ab"))
    assert whole[1][-1] == b"aabbcc" and short[-1][1] == "error" and short[-1][-1] == "literal cut short"


def test_frames_are_shown_as_their_places_are(spark, sf_dir):
    rng = random.Random(5)
    made = [(f"f{k}", some_file(rng, w, h, p, 30, k % 2)[0]) for k, (w, h, p) in enumerate([(16, 5, 3), (8, 9, 8), (20, 3, 1), (33, 4, 5)])]
    late = form("ANIM", form("ILBM", chunk("ANHD", b"\5".ljust(24, b"\0")), chunk("BMHD", struct.pack(">HHHHBBBB", 8, 2, 0, 0, 1, 0, 0, 0).ljust(20, b"\0")), chunk("DLTA", struct.pack(">I", 64).ljust(64, b"\0") + b"\1\x82ab")))
    files = spark.createDataFrame([*made, ("late", late), ("cut", made[0][1][:-3]), ("empty", b""), ("none", None)], "path string, content binary").repartition(3)
    want = {}
    for r in anim_delta.anim_screens(anim_delta.anim_runs(files)).collect():
        want.setdefault((r.path, r.frame_index, r.segment, r.buffer), {})[r.y, r.column] = bytes(r.pixels)
    got = {}
    for r in anim_delta.anim_shown(files).collect():
        got[r.path, r.frame_index, r.segment, r.buffer] = {divmod(p, r.columns): bytes(r.pixels[8 * k : 8 * k + 8]) for k, p in enumerate(r.places)}
        assert list(r.places) == sorted(r.places)
    assert got == want and any(k[0] == "late" for k in got)
    plan = queries.queries()["anim_deltas"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # a row a byte was shuffled
