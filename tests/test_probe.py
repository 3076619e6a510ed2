"""Probing IFF files, whole and broken; the query over all formats has its SQL."""

import struct

from framelake.operators.probe import probe


def chunk(kind, body):
    return kind.encode() + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)


def form(kind, *chunks):
    return chunk("FORM", kind.encode() + b"".join(chunks))


def bmhd(w=16, h=4, planes=5, packing=1):
    return chunk("BMHD", struct.pack(">HHHHBBBB", w, h, 0, 0, planes, 0, packing, 0).ljust(20, b"\0"))


def anhd(reltime):
    return chunk("ANHD", (b"\5" + b"\0" * 13 + struct.pack(">I", reltime)).ljust(24, b"\0"))


def sxhd(bits=8, packing=0, channels=1, rate=11025):
    return chunk("SXHD", struct.pack(">BBIIIBBI", bits, 64, 0, 0, packing, 1, channels, rate).ljust(20, b"\0"))


def info(w=20, h=5, planes=4, speed=0, frames=3, kind=0, flags=0):
    return chunk("INFO", struct.pack(">7H", w, h, planes, speed, frames, kind, flags))


FILES = {
    "plain": form("ANIM", form("ILBM", bmhd(), chunk("BODY", b"xx")), form("ILBM", anhd(0), chunk("DLTA", b"y")), form("ILBM", anhd(3), chunk("DLTA", b"z"))),
    "ham": form("ANIM", form("ILBM", bmhd(planes=6), chunk("CAMG", struct.pack(">I", 0x800)), sxhd(channels=2), chunk("BODY", b"x"), chunk("SBDY", b"abcd"))),
    "wide sound": form("ANIM", form("ILBM", bmhd(), sxhd(bits=16), chunk("BODY", b"x"), chunk("SBDY", b"abcd"))),
    "no sound": form("ANIM", form("ILBM", bmhd(), sxhd(), chunk("BODY", b"x"))),
    "packing": form("ANIM", form("ILBM", bmhd(packing=2), chunk("BODY", b"x"))),
    "planes": form("ANIM", form("ILBM", bmhd(planes=9), chunk("BODY", b"x"))),
    "zero": form("ANIM", form("ILBM", bmhd(w=0), chunk("BODY", b"x"))),
    "large": form("ANIM", form("ILBM", bmhd(w=20000), chunk("BODY", b"x"))),
    "headless": form("ANIM", form("ILBM", chunk("BODY", b"x"))),
    "yafa": form("YAFA", info(speed=5), chunk("BODY", b"x")),
    "yafa ham": form("YAFA", info(flags=1, kind=3), chunk("PROF", b"\0" * 12), chunk("BODY", b"x")),
    "yafa ends": form("YAFA", info(), chunk("PROF", b"\0" * 8), chunk("BODY", b"x")),
    "yafa packed": form("YAFA", info(kind=3), chunk("BODY", b"x")),
    "yafa empty": form("YAFA", info()),
    "nothing": b"", "null": None, "other": b"FORM\0\0\0\4AIFF",
}


def test_probe_of_iff_files(spark):
    rows = spark.createDataFrame(list(FILES.items()), "path string, content binary").repartition(3)
    got = {r.path: r for r in probe(rows).collect()}
    seen = lambda path: tuple(got[path])[1:9]
    assert seen("plain") == ("amiga_anim", 16, 4, 3, "indexed8", 150_000, 50_000, 0)
    assert seen("ham") == ("amiga_anim", 16, 4, 1, "rgb888", 16_666, 16_666, 1)
    assert (got["ham"].audio_rate, got["ham"].audio_channels, got["ham"].audio_bits) == (11025, 2, 8)
    assert got["wide sound"].audio_track_count == got["no sound"].audio_track_count == 0
    assert seen("yafa") == ("yafa", 20, 5, 3, "indexed8", 300_000, 100_000, 0) and seen("yafa ham")[4] == "rgb888" and got["yafa ham"].error is None
    errors = {p: r.error for p, r in got.items() if r.error}
    assert errors == {
        "packing": "amiga_anim: unsupported packing of pictures", "planes": "amiga_anim: unsupported number of planes", "zero": "zero dimensions", "large": "larger than allowed",
        "headless": "amiga_anim: no picture header", "yafa ends": "yafa: ends of other frames", "yafa packed": "yafa: packed frames without their ends", "yafa empty": "yafa: no header or no pictures",
        "nothing": "unknown format", "null": "unknown format", "other": "unknown format",
    }
