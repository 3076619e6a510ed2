"""Smacker frames taken apart, against a loop over frames."""

import random
import struct

from framelake.operators import smk


def palette_block(rng):
    ops, n = b"", 0
    while n < 256 and len(ops) < 200:
        kind = rng.randint(0, 2)
        if kind == 0:
            k = rng.randint(1, 128)
            ops, n = ops + bytes([0x80 | (k - 1)]), n + k
        elif kind == 1:
            k = rng.randint(1, 64)
            ops, n = ops + bytes([0x40 | (k - 1), rng.randint(0, 256 - k)]), n + k
        else:
            ops, n = ops + bytes([rng.randint(0, 63), rng.randint(0, 255), rng.randint(0, 255)]), n + 1
        if rng.random() < 0.1:
            break
    ops += b"\x80" * (-(len(ops) + 1) % 4)
    return bytes([(len(ops) + 1) // 4]) + ops


def applied(palette, block):
    """The palette after a block, entry by entry from a copy of the one before."""
    before, palette, at, n = list(palette), list(palette), 1, 0
    wide = lambda v: (v % 64) * 4 + (v % 64) // 16
    while n < 256 and at < len(block):
        b = block[at]
        if b >= 128:
            n, at = n + b - 127, at + 1
        elif b >= 64:
            for k in range(b - 63):
                if n + k < 256:
                    palette[n + k] = before[block[at + 1] + k]
            n, at = n + b - 63, at + 2
        else:
            palette[n] = wide(b) * 65536 + wide(block[at + 1]) * 256 + wide(block[at + 2])
            n, at = n + 1, at + 3
    return palette


TRACKS = [0x40000000 | 11025, 0x70000000 | 22050, 0, 0xC0000000 | 8000, 0, 0, 0x40000000 | 1]


def file_of(frames):
    """Frames of (flags, body)."""
    bodies = [body + b"\0" * (-len(body) % 4) for _, body in frames]
    head = b"SMK2" + struct.pack("<5I", 4, 4, len(frames), 100, 0)
    head = head.ljust(72, b"\0") + struct.pack("<7I", *TRACKS)
    return head.ljust(104, b"\0") + b"".join(struct.pack("<I", len(b)) for b in bodies) + bytes(f for f, _ in frames) + b"".join(bodies)


def some_file(rng, n):
    frames, pcm, palettes, palette = [], {}, {}, [0] * 256
    for k in range(n):
        flags, body = 0, b""
        if rng.random() < 0.6:
            block = palette_block(rng)
            flags, body, palette = 1, block, applied(palette, block)
            palettes[k] = palette
        for track in (0, 1, 3, 6):
            if rng.random() < 0.4:
                sound = rng.randbytes(rng.choice([0, 1, 2, 9, 40]))
                flags, body = flags | 2 << track, body + struct.pack("<I", len(sound) + 4) + sound
                if track != 3:  # packed
                    pcm[k, track] = bytes(b ^ 128 for b in sound) if track != 1 else sound[1::2]
        frames.append((flags, body + rng.randbytes(rng.randint(0, 9))))
    return file_of(frames), pcm, palettes


def test_parts_sound_and_palettes(spark):
    rng = random.Random(3)
    made = {f"f{k}": some_file(rng, n) for k, n in enumerate((1, 4, 40, 120))}
    media = spark.createDataFrame([(p, x[0]) for p, x in made.items()] + [("none", None), ("empty", b"SMK2")], "path string, content binary").repartition(3)
    parts = smk.smk_parts(media).cache()
    assert parts.where("kind = 'error'").count() == 0 and parts.where("kind = 'video'").count() == 165
    got = {(r.path, r.frame_index, r.track): bytes(r.pcm) for r in smk.smk_pcm(parts).collect()}
    assert got == {(p, *key): sound for p, x in made.items() for key, sound in x[1].items()}
    form = {(r.track, r.rate, r.channels, r.bits, r.packed) for r in parts.where("kind = 'audio'").collect()}
    assert form == {(0, 11025, 1, 8, False), (1, 22050, 2, 16, False), (3, 8000, 1, 8, True), (6, 1, 1, 8, False)}
    for group in (2, 5, 64):  # many levels of groups, some, one
        got = {(r.path, r.frame_index): r.palette for r in smk.smk_palettes(parts, group).collect()}
        assert got == {(p, k): colours for p, x in made.items() for k, colours in x[2].items()}


def test_maps_compose_in_any_order():
    rng = random.Random(5)
    blocks = [palette_block(rng) for _ in range(3)]
    a, b, c = (smk.palette_changes(x) for x in blocks)
    after = lambda first, then: [x if x < 0 else first[x] for x in then]
    assert after(after(a, b), c) == after(a, after(b, c))
    whole = [0] * 256
    for block in blocks:
        whole = applied(whole, block)
    assert [-1 - x if x < 0 else 0 for x in after(after(a, b), c)] == whole


def test_broken_parts_end_a_file(spark):
    good = (0, b"abcd")
    files = {"palette": [good, (1, b"\0abc"), good], "long palette": [(1, b"\x09abc")], "copy": [(1, b"\x01\x7f\xff\x80")], "colour": [(1, b"\x01\x80\x80\x01")], "sound": [good, (2, struct.pack("<I", 99))], "short sound": [(2, b"")]}
    media = spark.createDataFrame([(k, file_of(v)) for k, v in files.items()] + [("cut", file_of([good, good])[:-1])], "path string, content binary")
    errors = {(r.path, r.frame_index): r.error for r in smk.smk_parts(media).where("error IS NOT NULL").collect()}
    assert errors == {("palette", 1): "palette block out of range", ("long palette", 0): "palette block out of range", ("copy", 0): "palette copy out of range", ("colour", 0): "palette colour cut short",
                      ("sound", 1): "sound out of range", ("short sound", 0): "sound out of range"}
    assert smk.smk_parts(media).where("path = 'cut'").count() == 1
