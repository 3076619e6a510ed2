import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import binary
from framelake.operators import audio, chunks, folds, frame_index, frames, timeline
from framelake.operators import iff as iff_ops
from framelake.sources import media, sinks

PALETTE = bytes(range(256)) * 3


def flc_chunk(kind, payload, size=None):
    return struct.pack("<IH", 6 + len(payload) if size is None else size, kind) + payload


def flc_frame(*parts, delay=0):
    body = b"".join(parts)
    return struct.pack("<IHHH", 16 + len(body), 0xF1FA, len(parts), delay) + bytes(6) + body


def flc(width, height, *all_frames, magic=0xAF12, speed=33):
    body = b"".join(all_frames)
    head = struct.pack("<IHHHHHHI", 128 + len(body), magic, len(all_frames), width, height, 8, 3, speed)
    return head + bytes(128 - len(head)) + body


#: Frame 0 is all ones, frame 1 changes two pixels in the middle.
TWO = flc(4, 1, flc_frame(flc_chunk(4, b"\1\0\0\0" + PALETTE), flc_chunk(15, b"\1\4\1")), flc_frame(flc_chunk(12, bytes([0, 0, 1, 0, 1, 1, 2, 2, 2])), delay=50))


def rows(spark, **files):
    return spark.createDataFrame([(n, bytearray(d)) for n, d in files.items()], "path string, content binary").withColumn("codec", media.codec_of(F.col("content"), F.length("content").cast("bigint")))


def cdxl(width, height, planes, bitmap, info=0, palette=b"", sound=b"", number=1):
    size = 32 + len(palette) + len(bitmap) + len(sound)
    head = struct.pack(">BBIIIHHBBHH", 1, info, size, 0, number, width, height, 0, planes, len(palette), len(sound))
    return head + bytes(32 - len(head)) + palette + bitmap + sound


def test_files_are_told_apart_by_content(spark):
    samples = {"a": b"1234\x12\xaf", "b": b"1234\x11\xaf", "c": b"SMK2", "d": b"SMK4", "e": b"\xfe\xdb", "f": b"FORM\0\0\0\0ANIM", "g": b"FORM\0\0\0\0YAFA", "h": b"BIKi", "i": b"KB2i", "j": b"garbage", "k": b"", "l": cdxl(16, 1, 1, b"\0\0"), "m": b"BIKz"}
    got = {r.path: r.codec for r in rows(spark, **samples).collect()}
    assert got == {"a": "flc", "b": "flc", "c": "smk", "d": "smk", "e": "atari_seq", "f": "amiga_anim", "g": "yafa", "h": "bink", "i": None, "j": None, "k": None, "l": "cdxl", "m": None}


def test_containers_tell_size_time_and_errors(spark):
    files = {"two": TWO, "fli": flc(320, 200, magic=0xAF11, speed=5), "short": TWO[:30], "big": flc(20000, 1), "none": b"x" * 200, "sound": cdxl(16, 1, 1, b"\0\0", info=0x10, sound=bytes(4))}
    got = {r.path: r for r in media.containers(rows(spark, **files)).collect()}
    two = got["two"]
    assert (two.codec, two.width, two.height, two.frame_count, two.frame_period_us, two.duration_us, two.error) == ("flc", 4, 1, 2, 33000, 66000, None)
    assert got["fli"].frame_period_us == 71428 and got["short"].error and got["big"].error and got["none"].error == "unknown format"
    assert (got["sound"].audio_track_count, got["sound"].audio_rate, got["sound"].audio_channels) == (1, 24, 2)


def test_the_slice_of_the_plan(spark):
    """Frames, chunk census and the second frame's pixels of a two-frame clip."""
    files = rows(spark, two=TWO)
    decoded = {r.frame_index: r for r in frames.decode_frames(files).collect()}
    assert bytes(decoded[0].pixels) == b"\1\1\1\1" and bytes(decoded[1].pixels) == b"\1\2\2\1"
    assert decoded[0].palette_changed and not decoded[1].palette_changed and decoded[0].keyframe
    census = {(r.type_name, r.n_chunks, r.n_bytes) for r in chunks.top_chunks(chunks.chunk_census(chunks.flc_chunks(files))).collect()}
    assert census == {("COLOR_256", 1, 772), ("BRUN", 1, 3), ("LC", 1, 9)}
    timed = {r.frame_index: (r.pts_us, r.duration_us) for r in frame_index.with_times(frame_index.flc_index(files), media.containers(files)).collect()}
    assert timed == {0: (0, 33000), 1: (33000, 50000)}
    assert [bytes(r.payload) for r in chunks.payloads(files, ("LC",)).collect()] == [bytes([0, 0, 1, 0, 1, 1, 2, 2, 2])]


@pytest.mark.parametrize(
    ("step", "width", "height", "base", "data", "expected"),
    [
        (frames.flc_brun, 4, 1, 0, "0104AA", {0: "AAAAAAAA"}),
        (frames.flc_lc, 6, 4, 0xCC, "010002000102" + "03AABBCC" + "0100FC77", {1: "CCCCAABBCCCC", 2: "77777777CCCC"}),
        (frames.flc_ss2, 8, 4, 0xCC, "0100FEFF01000202AABBCCDD", {2: "CCCCAABBCCDDCCCC"}),
        (frames.flc_ss2, 6, 1, 0, "0100010000FE7788", {0: "778877880000"}),
        (frames.flc_ss2, 5, 1, 0x11, "0100AA800000", {0: "11111111AA"}),
    ],
)
def test_flc_deltas(step, width, height, base, data, expected):
    picture = np.full((height, width), base, np.uint8)
    step(picture, bytes.fromhex(data))
    for y, row in expected.items():
        assert picture[y].tobytes().hex().upper() == row


def test_broken_deltas_are_errors_and_keep_the_frames_before(spark):
    with pytest.raises(ValueError):
        frames.flc_ss2(np.zeros((1, 4), np.uint8), bytes.fromhex("01000040"))
    with pytest.raises(ValueError):
        frames.run_skip_dump(np.zeros(4, np.uint8), bytes.fromhex("4200000003AA"))
    bad = flc(4, 1, flc_frame(flc_chunk(15, b"\1\4\1")), flc_frame(flc_chunk(15, b"\1\4")))
    got = sorted((r.frame_index, r.error is None) for r in frames.decode_frames(rows(spark, bad=bad)).collect())
    assert got == [(0, True), (1, False)]


def test_a_last_picture_may_state_too_little(spark):
    data = flc(4, 2, flc_frame(flc_chunk(16, bytes(range(1, 9)), size=12)), magic=0xAF11)
    assert [bytes(r.pixels) for r in frames.decode_frames(rows(spark, f=data)).collect()] == [bytes(range(1, 9))]


def test_random_bytes_never_fail_a_task(spark):
    rng = np.random.default_rng(3)
    files = {f"f{i}": TWO[:128] + rng.bytes(200) for i in range(20)} | {f"d{i}": b"LPF " + rng.bytes(12) + b"ANIM" + rng.bytes(4000) for i in range(5)} | {f"c{i}": cdxl(16, 4, 1, bytes(8)) + rng.bytes(90) for i in range(5)}
    assert frames.decode_frames(rows(spark, **files)).count() >= 5
    assert media.containers(rows(spark, **files)).count() == 30


def test_cdxl_pictures_palettes_and_format_changes(spark):
    palette = bytes.fromhex("00000F80")
    a, b = cdxl(2, 2, 1, bytes.fromhex("80004000"), palette=palette), cdxl(4, 2, 1, bytes.fromhex("80004000"), palette=palette, number=2)
    got = {r.frame_index: r for r in frames.decode_frames(rows(spark, x=a + b)).collect()}
    assert bytes(got[0].pixels) == b"\1\0\0\1" and bytes(got[0].palette)[3:6] == bytes([255, 136, 0]) and got[1].error
    sound = cdxl(16, 1, 1, b"\0\0", sound=b"abcd")
    assert [(r.frame_index, bytes(r.pcm), r.rate) for r in audio.cdxl_audio(rows(spark, s=sound * 2)).orderBy("frame_index").collect()] == [(0, b"abcd", 48), (1, b"abcd", 48)]


def test_hold_and_modify_matches_a_sequential_fold():
    rng = np.random.default_rng(5)
    palette = rng.integers(0, 256, (64, 3)).astype(np.uint8)
    for planes, keep in ((6, False), (8, False), (8, True)):
        pixels = rng.integers(0, 1 << planes, (3, 50)).astype(np.uint8)
        got, bits = frames.ham_to_rgb(pixels, planes, palette, keep), planes - 2
        for y in range(3):
            now = palette[0].tolist()
            for x in range(50):
                op, v = pixels[y, x] >> bits, int(pixels[y, x]) & ((1 << bits) - 1)
                if op == 0:
                    now = palette[v].tolist()
                else:
                    c = {1: 2, 2: 0, 3: 1}[op]
                    now[c] = v << 2 | now[c] & 3 if keep else (v << 4 | v if bits == 4 else v << 2 | v >> 4)
                assert got[y, x].tolist() == now


def test_byte_runs():
    assert frames.byte_run(bytes([2, 1, 2, 3, 128, 254, 9]), 6) == bytes([1, 2, 3, 9, 9, 9])
    with pytest.raises(ValueError):
        frames.byte_run(b"\x05ab", 6)


def test_window_folds_match_sequential_ones(spark):
    rng = np.random.default_rng(7)
    data = [(int(i), int(rng.integers(0, 3)), int(rng.integers(0, 256)), bool(rng.integers(0, 6) == 0), None if rng.integers(0, 2) else int(rng.integers(0, 256))) for i in range(200)]
    df = spark.createDataFrame(data, "i int, place int, word int, clear boolean, v int")
    xor = {r.i: r.folded for r in folds.xor_fold(df, ["place"], ["i"], "word", "clear").collect()}
    last = {r.i: r.pixel for r in folds.carry(df, ["place"], ["i"], "v").collect()}
    dpcm = {r.i: r.sample for r in folds.running_sum(df, ["place"], ["i"], "word", 8).collect()}
    acc, held, total = {}, {}, {}
    for i, place, word, clear, v in data:
        acc[place] = word if clear else acc.get(place, 0) ^ word
        held[place] = held.get(place) if v is None else v
        total[place] = (total.get(place, 0) + word) % 256
        assert (xor[i], last[i], dpcm[i]) == (acc[place], held[place], total[place])


def test_timelines(spark):
    times = [0, 10, 1000, 1500, 500, 5000, 9000]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(times)], "s string, i int, t bigint")
    got = timeline.present_asof(df, ["s"], ["i"], "t", F.lit(1000), F.lit(3)).orderBy("i").collect()
    assert [(r.frame_index, r.rendered, r.eos) for r in got] == [(0, True, False), (0, False, False), (1, True, False), (1, False, False), (0, True, False), (5, False, True), (9, False, False)]
    loop = timeline.present_asof(df, ["s"], ["i"], "t", F.lit(1000), F.lit(3), loop=True).orderBy("i").collect()
    assert [r.frame_index for r in loop] == [0, 0, 1, 1, 0, 2, 0]
    late = spark.createDataFrame([("s", 0, 2500), ("s", 1, 2600)], "s string, i int, t bigint")
    assert [r.frame_index for r in timeline.player_parity(late, ["s"], ["i"], "t", F.lit(1000), F.lit(3)).orderBy("i").collect()] == [0, 2]


def test_sound_events_drop_what_names_no_sound(spark):
    controls = spark.createDataFrame([("p", 0, 0, 1, 64, 1), ("p", 1, 0, 0, 64, 1), ("p", 2, 0, 9, 64, 1), ("p", 3, 0, 2, 99, 1)], "path string, frame_index int, seq int, sound int, volume int, repeats int")
    bank = spark.createDataFrame([("p", 1, bytearray(b"a")), ("p", 2, bytearray(b"b"))], "path string, slot int, sound_bytes binary")
    assert sorted((r.frame_index, r.slot, r.volume) for r in audio.sound_events(controls, bank).collect()) == [(0, 1, 1.0), (3, 2, 1.0)]


def test_iff_headers(spark):
    chunk = lambda name, data: name + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)
    form = lambda kind, data: b"FORM" + struct.pack(">I", len(data) + 4) + kind + data
    bmhd = struct.pack(">HHhhB", 320, 200, 0, 0, 5) + bytes(11)
    anhd = lambda rel: bytes(14) + struct.pack(">I", rel) + bytes(22)
    anim = form(b"ANIM", form(b"ILBM", chunk(b"BMHD", bmhd) + chunk(b"ANHD", anhd(0)) + chunk(b"BODY", b"abc")) + form(b"ILBM", chunk(b"ANHD", anhd(4)) + chunk(b"DLTA", b"x")))
    yafa = form(b"YAFA", chunk(b"INFO", struct.pack(">HHHHHHH", 320, 256, 5, 2, 100, 0, 0)))
    got = {r.path: r for r in chunks.iff_headers(rows(spark, a=anim, y=yafa)).collect()}
    assert (got["a"].codec, got["a"].width, got["a"].height, got["a"].planes, got["a"].frame_count, got["a"].frame_period_us) == ("amiga_anim", 320, 200, 5, 2, 66666)
    assert (got["y"].codec, got["y"].width, got["y"].frame_count, got["y"].frame_period_us) == ("yafa", 320, 100, 40000)


def test_pictures_and_sound_are_written(spark, tmp_path):
    written = sinks.write_ppm(frames.decode_frames(rows(spark, two=TWO)), tmp_path.as_uri()).collect()
    assert sorted(r.file for r in written) == ["two/frame_0000.ppm", "two/frame_0001.ppm"]
    data = (tmp_path / "two/frame_0001.ppm").read_bytes()
    assert data == b"P6\n4 1\n255\n" + b"".join(PALETTE[3 * i : 3 * i + 3] for i in (1, 2, 2, 1))
    audio_rows = spark.createDataFrame([("a/b", 3, bytearray([0x80, 0x40]))], "path string, frame_index int, pcm binary")
    assert [r.bytes for r in sinks.write_f32(audio_rows, tmp_path.as_uri()).collect()] == [8]
    assert np.frombuffer((tmp_path / "a_b/sound_0003.f32").read_bytes(), "<f4").tolist() == [-1.0, 0.5]


def test_media_is_read_from_files_and_streams(spark, tmp_path):
    from framelake.streaming.player import new_media

    (tmp_path / "a.flc").write_bytes(TWO)
    (tmp_path / "b.txt").write_bytes(b"no")
    assert media.read_media(spark, str(tmp_path), ["flc"]).count() == 1
    stream = media.containers(new_media(spark, str(tmp_path))).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert {r.codec for r in spark.table("seen").collect()} == {"flc", None}


def test_streamed_player_keeps_state(spark, tmp_path):
    from framelake.streaming.player import present_stream

    schema = "session_id string, seq int, media_time_us bigint, control string"
    source = tmp_path / "in"
    ticks = [("s", 0, 0, None), ("s", 1, 500, None), ("s", 2, 1000, None), ("s", 3, 1200, "pause"), ("s", 4, 2500, None), ("s", 5, 2600, "play"), ("s", 6, 9000, None), ("s", 7, 9500, None), ("s", 8, 0, "rewind")]
    spark.createDataFrame(ticks, schema).coalesce(1).write.json(str(source))
    stream = present_stream(spark.readStream.schema(schema).json(str(source)), 1000, 3)
    query = stream.writeStream.format("memory").queryName("shown").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.frame_index, r.rendered, r.eos) for r in spark.table("shown").collect()]
    assert got == [(0, True, False), (0, False, False), (1, True, False), (2, True, False), (9, False, True), (9, False, False), (0, True, False)]


def iff(kind, payload):
    return kind + struct.pack(">I", len(payload)) + payload + bytes(len(payload) % 2)


def form(kind, *parts):
    return iff(b"FORM", kind + b"".join(parts))


def sxhd(mode, depth=8, packed=0, rate=8000):
    return iff(b"SXHD", struct.pack(">BBIIIBBI", depth, 64, 4, 0, packed, mode, mode, rate))


def anhd(time):
    return iff(b"ANHD", bytes(14) + struct.pack(">I", time) + bytes(6))


def test_anim_frames_begin_once_the_one_before_is_filled(spark):
    bmhd = iff(b"BMHD", struct.pack(">HH", 16, 2) + bytes(4) + bytes([3]) + bytes(11))
    bank = form(b"8SVX", iff(b"BODY", b"snd1")), form(b"8SVX", iff(b"BODY", b"odd"))
    control = lambda sound, volume: iff(b"SCTL", struct.pack(">BBHHHHH", 1, volume, sound, 0, 3, 0, 0) + bytes(4))
    one = form(b"ILBM", bmhd, anhd(0), iff(b"CMAP", b"abcdef+"), iff(b"CAMG", b"\0\0\x08\0"), sxhd(2), control(1, 100), control(3, 9), iff(b"BODY", b"12345"), iff(b"SBDY", b"LlRr"), iff(b"SBDY", b"xy"))
    two = form(b"ILBM", anhd(3), control(2, 16), iff(b"SCTL", b"short"), iff(b"DLTA", b"67"))
    late = form(b"8SVX", iff(b"BODY", b"late"))
    files = spark.createDataFrame([("a", form(b"ANIM", *bank, one, two, late)), ("b", b""), ("c", form(b"ANIM", form(b"ILBM", bmhd, sxhd(1), iff(b"SBDY", b"mono")))), ("d", form(b"ANIM", form(b"ILBM", bmhd, sxhd(1, 16), iff(b"SBDY", b"wide"))))], "path string, content binary")
    index = {(r.path, r.frame_index): r for r in iff_ops.anim_index(files).collect()}
    assert [(k, r.size, r.keyframe_flag, r.sound_bytes, r.pts_us, r.duration_us) for k, r in sorted(index.items())] == [
        (("a", 0), 5, True, 6, 0, 50000), (("a", 1), 2, False, 0, 50000, 50000), (("c", 0), None, None, 4, 0, 16666), (("d", 0), None, None, 4, 0, 16666)]
    head = {r.path: r for r in iff_ops.anim_headers(files).collect()}
    assert (head["a"].width, head["a"].height, head["a"].planes, bytes(head["a"].cmap), head["a"].camg, head["a"].audio_rate, head["a"].audio_channels) == (16, 2, 3, b"abcdef", 2048, 8000, 2)
    assert {r.path: (r.channels, bytes(r.pcm)) for r in iff_ops.anim_pcm(files).collect()} == {"a": (2, b"LrlxRy"), "c": (1, b"mono")}
    assert sorted((r.slot, bytes(r.sound_bytes)) for r in iff_ops.sound_bank(files).collect()) == [(1, bank[0]), (2, bank[1])]
    events = audio.sound_events(iff_ops.anim_controls(files), iff_ops.sound_bank(files)).collect()
    assert sorted((r.frame_index, r.slot, r.volume) for r in events) == [(0, 1, 1.0), (1, 2, 0.25)]
    assert [r.sound for r in iff_ops.anim_controls(files).where("frame_index = 1").orderBy("seq").collect()] == [2, 0]


def test_yafa_frames_from_ends_or_of_one_size(spark):
    info = lambda n, kind, flags: iff(b"INFO", struct.pack(">HHHHHHH", 16, 2, 2, 0, n, kind, flags))
    rows = {
        "listed": [info(2, 3, 0), iff(b"PROF", struct.pack(">II", 10, 15)), iff(b"BODY", bytes(15))], "planar": [info(2, 0, 0), iff(b"BODY", bytes(16))], "delta": [info(2, 0, 4), iff(b"BODY", bytes(16))],
        "wrong": [info(3, 3, 0), iff(b"PROF", struct.pack(">II", 10, 15)), iff(b"BODY", bytes(15))], "none": [info(0, 4, 0), iff(b"BODY", b"")], "short": [iff(b"INFO", bytes(4)), iff(b"BODY", b"")],
    }
    files = spark.createDataFrame([(k, form(b"YAFA", *v)) for k, v in rows.items()], "path string, content binary")
    got = sorted((r.path, r.frame_index, r.offset, r.size, r.pts_us) for r in iff_ops.yafa_index(files).collect())
    assert got == [("listed", 0, 58, 10, 0), ("listed", 1, 68, 5, 83333), ("planar", 0, 42, 8, 0), ("planar", 1, 50, 8, 83333)]


def test_contents_are_never_shuffled(spark):
    files = spark.createDataFrame([("a", b"")], "path string, content binary").repartition(2)
    for found in (audio.cdxl_audio(files), chunks.payloads(files, ("LC",)), chunks.iff_headers(files), iff_ops.anim_index(files), iff_ops.yafa_index(files), frame_index.smk_index(files), frame_index.dpan_index(files)):
        plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [x.split("\n")[1] for x in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", x) and "REPARTITION_BY_NUM" not in x]
        assert not any("content" in x for x in moved), moved


def test_bits_lowest_first_and_zeros_past_the_end(spark):
    data = bytes([0b10110101, 0b01100011, 0xFF])
    df = spark.createDataFrame([(data,)], "d binary")
    whole = int.from_bytes(data, "little")
    for at, n in ((0, 1), (0, 8), (3, 7), (5, 19), (16, 8), (20, 32), (24, 4), (100, 3)):
        assert df.select(binary.bits(F.col("d"), at, n)).first()[0] == whole >> at & (1 << n) - 1


def test_names_and_tracks(spark):
    rows = spark.createDataFrame([("x/one.flc", "flc"), ("x/two.smk", "smk"), ("y/two.smk", None)], "path string, codec string")
    assert [r.name for r in media.named(rows, "smk/tw", "decode").collect()] == ["decode/smk/two.smk"]
    smk = b"SMK2" + bytes(68) + struct.pack("<7I", 11025 | 0x40 << 24, 5, 22050 | 0x70 << 24, 0, 0, 0, 0) + bytes(4)
    bink = lambda tail: b"BIKk" + bytes(36) + struct.pack("<I", 2) + bytes(4) + tail
    table = struct.pack("<2I4H2I", 100, 200, 44100, 0x2000, 8000, 0x4000, 5, 6)
    files = spark.createDataFrame([("s", smk), ("b", bink(table)), ("cut", bink(table[:-1])), ("n", None)], "path string, content binary")
    got = sorted((r.path, r.track, r.rate, r.channels, r.bits, r.packed, r.track_id, r.max_bytes) for r in media.audio_tracks(files).collect())
    assert got == [("b", 0, 44100, 2, 8, True, 5, 100), ("b", 1, 8000, 1, 16, True, 6, 200), ("s", 0, 11025, 1, 8, False, None, None), ("s", 2, 22050, 2, 16, False, None, None)]


def test_a_clock_under_control(spark):
    rows = [(1, 5, None, None), (2, 3, "pause", None), (3, 4, None, None), (4, 0, "resume", None), (5, -2, None, None), (6, 6, None, None), (7, 0, "seek", 100), (8, 1, None, None), (9, 0, "rewind", None), (10, 2, None, None), (11, 9, "external", 50)]
    df = spark.createDataFrame([(0, *r) for r in rows], "s int, n int, dt bigint, control string, to bigint")
    got = timeline.transport_clock(df, ["s"], ["n"], "dt", "control", "to").orderBy("n").collect()
    assert [r.media_time_us for r in got] == [5, 5, 5, 5, 5, 11, 100, 101, 0, 2, 50] and [r.paused for r in got] == [False, True, True] + [False] * 8
