import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import binary, colour, timing


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_readers_follow_byte_order_and_give_zero_past_the_end(spark):
    data = F.lit(bytearray(b"\xc3\x88\x01\xff\x80"))
    got = one(spark, a=binary.u8(data, 0), b=binary.u16le(data, 0), c=binary.u16be(data, 0), d=binary.u32le(data, 1), e=binary.u32be(data, 1), f=binary.u16le(data, 4), g=binary.u8(data, 9), h=binary.s16(binary.u16le(data, 3)))
    assert got == {"a": 0xC3, "b": 0x88C3, "c": 0xC388, "d": 0x80FF0188, "e": 0x8801FF80, "f": 0, "g": 0, "h": -32513}


def test_periods(spark):
    n = lambda x: F.lit(x).cast("bigint")
    got = one(spark, fli=timing.fli_period(n(5)), flc=timing.flc_period(n(33)), smk=timing.smk_period(n(-6667)), smk0=timing.smk_period(n(0)), seq=timing.seq_period(n(200)), anim=timing.anim_period(n(0)),
              cdxl=timing.cdxl_period(), yafa=timing.yafa_period(n(2)), yafa0=timing.yafa_period(n(0)), dpan=timing.dpan_period(n(0)), bink=timing.bink_period(n(30000), n(1001)), none=timing.bink_period(n(0), n(1)))
    assert got == {"fli": 71428, "flc": 33000, "smk": 66670, "smk0": 100000, "seq": 33333, "anim": 16666, "cdxl": 83333, "yafa": 40000, "yafa0": 83333, "dpan": 55555, "bink": 33366, "none": None}


@pytest.mark.parametrize(("pts", "frame"), [(-5, 0), (0, 0), (32999, 0), (33000, 1), (10**9, 10)])
def test_seek_clamps_to_the_end(spark, pts, frame):
    assert one(spark, f=timing.frame_at(F.lit(pts), F.lit(33000), F.lit(10)))["f"] == frame


def test_byte_sizes(spark):
    got = one(spark, a=timing.byte_size(F.lit(1023)), b=timing.byte_size(F.lit(2047)), c=timing.byte_size(F.lit(3 << 20)))
    assert got == {"a": "1023 B", "b": "1 KiB", "c": "3 MiB"}


def test_colours(spark):
    got = one(spark, six=colour.scale_6_to_8(F.lit(63)), three=colour.scale_3_to_8(F.lit(7)), rgb=colour.rgb12(F.lit(0xF80)), white=colour.yuv_to_rgb(F.lit(235), F.lit(128), F.lit(128)), low=colour.yuv_to_rgb(F.lit(0), F.lit(0), F.lit(0)), pitch=colour.bitplane_pitch(F.lit(17)))
    assert got["six"] == 255 and got["three"] == 255 and tuple(got["rgb"]) == (255, 136, 0)
    assert tuple(got["white"]) == (255, 255, 255) and min(got["low"]) == 0 and got["pitch"] == 4


def test_conversion_of_whole_buffers(spark):
    pixels, palette = F.lit(bytearray([0, 1, 3, 9])), F.lit(bytearray([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255]))
    f = F.lit("indexed8")
    got = one(spark, rgb=colour.convert_pixels(pixels, palette, f, "rgb888"), rgba=colour.convert_pixels(pixels, palette, f, "rgba8888"), same=colour.convert_pixels(pixels, palette, f, "indexed8"),
              back=colour.convert_pixels(pixels, palette, F.lit("rgba8888"), "indexed8"), bare=colour.convert_pixels(pixels, F.lit(None).cast("binary"), f, "rgb888"))
    assert bytes(got["rgb"]) == bytes([255, 0, 0, 0, 255, 0, 255, 255, 255, 0, 0, 0])
    assert bytes(got["rgba"])[:8] == bytes([255, 0, 0, 255, 0, 255, 0, 255]) and bytes(got["same"]) == b"\0\1\3\x09"
    assert got["back"] is None and got["bare"] is None


def test_half_bright_palette(spark):
    p = F.array(F.struct(F.lit(255).alias("r"), F.lit(3).alias("g"), F.lit(0).alias("b")))
    assert [tuple(c) for c in one(spark, p=colour.half_bright(p))["p"]] == [(255, 3, 0), (127, 1, 0)]
    assert np.array(one(spark, p=colour.st_palette(F.array(F.lit(0x777), F.lit(0x123)), F.lit(1)))["p"]).tolist() == [[255, 255, 255], [0, 0, 0]]
