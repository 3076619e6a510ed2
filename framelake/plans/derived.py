"""Containers that Spark builds from the test tables, so that queries over them read data that grows with the tables.

Binding a table to a format is this module's convention. A document's bytes become the pixels, frame after frame; what
a decoder gives back can then be held against the document.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.binary import hex_uint, once
from framelake.operators.chunks import BATCH_BYTES, map_files

WIDTH, HEIGHT = 32, 8
SIZE = WIDTH * HEIGHT
SPEED = 33
#: Frames that a file can hold: 16 bits of an FLC header, 256 pages of 200 records of a DPAN file. Longer documents make several files.
FLC_FRAMES, DPAN_FRAMES = 65535, 256 * 200


def _num(x: Column | int, size: int, little: bool = True) -> Column:
    return hex_uint(x if isinstance(x, Column) else F.lit(x), size, little)


def _padded(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """``path``, ``data`` (the text's bytes, filled with zeros to whole frames) and ``n`` frames; a row for each ``limit`` frames, from the second on with ``#`` and the part's number in its path."""
    path, data = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.encode(F.coalesce("text", F.lit("")), "utf-8")
    if limit is None:
        rows = docs.select(path.alias("path"), data.alias("data"))
    else:
        step = limit * SIZE
        parts = once(data, lambda d: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(d) / step).cast("int") - 1, F.lit(0))), lambda k: F.substring(d, k * step + 1, F.lit(step))))
        rows = docs.select(path.alias("path"), F.posexplode(parts).alias("part", "data"))
        rows = rows.select(F.when(F.col("part") > 0, F.concat("path", F.lit("#"), F.col("part").cast("string"))).otherwise(F.col("path")).alias("path"), "data")
    n = F.greatest(F.ceil(F.length("data") / SIZE), F.lit(1)).cast("int")
    fill = F.unhex(F.repeat(F.lit("00"), (n * SIZE - F.length("data")).cast("int")))
    # generated, so that Spark doesn't build the data again for each frame
    return rows.select("path", n.alias("n"), F.explode(F.array(F.concat("data", fill))).alias("data"))


def joined(rows: DataFrame, limit: int, **steps: int) -> DataFrame:
    """Rows of frames with the parts of a document as one file again: ``frame_index`` and the columns of ``steps``, by their step a part, run on."""
    part = F.when(F.col("path").contains("#"), F.substring_index("path", "#", -1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    moved = {name: F.col(name) + part * step for name, step in steps.items()}
    index = (F.col("frame_index") + part * limit).cast("int")
    return rows.withColumns({**moved, "frame_index": index, "path": F.substring_index("path", "#", 1)})


def _files(rows: DataFrame, digits: Callable[[Column], Column]) -> DataFrame:
    """``path`` and ``content``, of the digits that ``digits`` makes of ``data``. Generated, so that no reader of the content makes Spark build it again.

    ``data`` is bound once: a binary column that a lambda reads by its name is copied whole at every use.
    """
    data = F.col("data") if "data" in rows.columns else F.lit(b"")
    return rows.select("path", F.explode_outer(F.array(once(data, lambda d: F.unhex(digits(d))))).alias("content"))


def _slice(data: Column, at: Column, size: int) -> Column:
    """``size`` bytes from byte ``at``, as hexadecimal digits."""
    return F.hex(F.substring(data, at + 1, F.lit(size)))


def _built(rows: DataFrame, build: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``path`` and ``content``, which ``build`` makes of a file's frames: a row of ``SIZE`` bytes each."""
    rows = rows.select("path", F.col("data").alias("content"))
    return map_files(rows, lambda data: [(build(np.frombuffer(data, np.uint8).reshape(-1, SIZE)),)], "path string, content binary")


def _row(*parts: bytes | np.ndarray) -> np.ndarray:
    """Records side by side of their parts: a column of bytes a record, or bytes that all have."""
    n = next(len(x) for x in parts if not isinstance(x, bytes))
    return np.concatenate([np.broadcast_to(np.frombuffer(x, np.uint8), (n, len(x))) if isinstance(x, bytes) else x for x in parts], axis=1)


def _column(values: np.ndarray, kind: str) -> np.ndarray:
    """Numbers as columns of bytes."""
    return values.astype(kind)[:, None].view(np.uint8)


def _lined(frames: np.ndarray, head: bytes) -> np.ndarray:
    """Frames with ``head`` before each of their lines."""
    lines = _row(head, frames.reshape(-1, WIDTH))
    return lines.reshape(len(frames), HEIGHT * lines.shape[1])


def flc_files(docs: DataFrame, words: bool = False) -> DataFrame:
    """FLC files: frames in turn a raw picture, byte runs and changed bytes; the first with a palette.

    ``words``: with changed words in the place of bytes, every fifth frame black, and a palette of six bits a colour.
    """
    chunk = lambda kind, size: struct.pack("<IH", size + 6, kind)
    head = lambda size, n: struct.pack("<IHH8x", size + 16, 0xF1FA, n)
    colours = chunk(11 if words else 4, 772) + b"\1\0\0\0" + bytes(i * 7 % (64 if words else 256) for i in range(768))

    def frame(kind: int, payload: np.ndarray) -> list[bytes]:
        n = payload.shape[1]
        return [x.tobytes() for x in _row(head(n + 6, 1) + chunk(kind, n), payload)]

    def build(d: np.ndarray) -> bytes:
        parts = [b""] * len(d)
        parts[::3] = frame(16, d[::3])
        parts[0] = head(len(colours) + 6 + SIZE, 2) + colours + parts[0][16:]
        parts[1::3] = frame(15, _lined(d[1::3], bytes((0, 256 - WIDTH))))
        lines = struct.pack("<H", HEIGHT)
        parts[2::3] = frame(7, _row(lines, _lined(d[2::3], bytes((1, 0, 0, WIDTH // 2))))) if words else frame(12, _row(b"\0\0" + lines, _lined(d[2::3], bytes((1, 0, WIDTH)))))
        if words:
            parts[14::15] = [head(6, 1) + chunk(13, 0)] * len(parts[14::15])
        body = b"".join(parts)
        return struct.pack("<I6HI", len(body) + 128, 0xAF12, len(d), WIDTH, HEIGHT, 8, 3, SPEED).ljust(128, b"\0") + body

    return _built(_padded(docs, FLC_FRAMES), build)


def cdxl_files(docs: DataFrame, planes: int = 1) -> DataFrame:
    """CDXL files: a chunk's picture is 32 bytes of the text a plane, as 32 by 8 bits, and its sound the next 16. A last chunk is filled with zeros."""
    bitmap, sound, colours = WIDTH // 8 * HEIGHT * planes, 16, 1 << planes
    step = bitmap + sound
    size = 32 + 2 * colours + step

    def build(d: np.ndarray) -> bytes:
        data = d.tobytes()
        data = np.frombuffer(data.ljust(-(-len(data) // step) * step, b"\0"), np.uint8).reshape(-1, step)
        numbers = np.arange(len(data))
        sizes = struct.pack(">5H8x", WIDTH, HEIGHT, planes, 2 * colours, sound)
        return _row(struct.pack(">HI", 0x100, size), _column((numbers > 0) * size, ">u4"), _column(numbers + 1, ">u4"), sizes, b"\0\0" + b"\x0f\xff" * (colours - 1), data).tobytes()

    return _built(_padded(docs), build)


def dpan_files(docs: DataFrame) -> DataFrame:
    """DPAN files of one page a 64 KiB: each record a long copy of a whole frame; 200 frames a page."""
    per, record = 200, 4 + 3 + SIZE
    colours = bytes(i * 5 % 256 for i in range(1024))

    def build(d: np.ndarray) -> bytes:
        firsts = range(0, len(d), per)
        held = [len(d[k : k + per]) for k in firsts]
        entries = [struct.pack("<3H", k, n, n * record) for k, n in zip(firsts, held, strict=True)]
        head = struct.pack("<4sHHIHH4sHH", b"LPF ", 256, len(held), len(d), per, 1280, b"ANIM", WIDTH, HEIGHT) + bytes.fromhex("0000000000010001")
        head = (head.ljust(64, b"\0") + struct.pack("<IH", len(d), 10)).ljust(256, b"\0")
        pages = [e + b"\0\0" + struct.pack("<H", record) * n + _row(struct.pack("<5sH", b"\x42\0\0\0\x80", 0x8000 + SIZE), d[k : k + per]).tobytes() for e, k, n in zip(entries, firsts, held, strict=True)]
        return head + colours + b"".join(entries).ljust(256 * 6, b"\0") + b"".join([p.ljust(65536, b"\0") for p in pages[:-1]] + pages[-1:])

    return _built(_padded(docs, DPAN_FRAMES), build)


def _seq_file(cels: np.ndarray) -> bytes:
    return struct.pack(">HHIH", 0xFEDB, 0, len(cels), SPEED).ljust(128, b"\0") + bytes(4 * len(cels)) + cels.tobytes()


def seq_files(docs: DataFrame) -> DataFrame:
    """SEQ files: a cel of the text's bytes a frame, every fourth a copy and the others XOR; the table of offsets is left empty, as it is not to be trusted."""

    def build(d: np.ndarray) -> bytes:
        return _seq_file(_row(b"\xff\xff".ljust(62, b"\0"), _column(np.arange(len(d)) % 4 > 0, "u1"), struct.pack(">BI", 0, SIZE).ljust(65, b"\0"), d))

    return _built(_padded(docs), build)


#: Of a cel's 128 words, those that lie in the file one by one; the last of them is repeated for the rest.
SEQ_LITERAL = 120
SEQ_CEL = (32, 16)


def seq_cel_files(docs: DataFrame) -> DataFrame:
    """SEQ files of run-length cels of 32 by 16 pixels in four planes, each of 256 bytes of the text: its first 32 are the palette too. Every fourth clears the screen, the others are XOR; they move by 5 pixels and a line a frame."""
    at = 2 * (SEQ_LITERAL - 1)
    size = 2 + at + 4

    def build(d: np.ndarray) -> bytes:
        f = np.arange(len(d))
        place = (_column(f * 5 % 40, ">u2"), _column(f % 20, ">u2"), struct.pack(">HH", *SEQ_CEL), _column(f % 4 > 0, "u1"))
        fields = _row(b"\xff\xff\0\0", d[:, :32], bytes(18), *place, struct.pack(">BI", 1, size).ljust(65, b"\0"))
        return _seq_file(_row(fields, struct.pack(">H", 0x8000 + SEQ_LITERAL - 1), d[:, :at], struct.pack(">H", SIZE // 2 - SEQ_LITERAL + 1), d[:, at : at + 2]))

    return _built(_padded(docs), build)


#: Of a Smacker file's sound, bytes a frame; and a palette block's.
SMK_SOUND, SMK_PALETTE = 32, 8


def smk_files(docs: DataFrame) -> DataFrame:
    """Smacker files: of the text's bytes, every third frame has a palette block and every other one raw 8-bit sound; the rest is its picture, which no decoder reads."""
    rows, n = _padded(docs), F.col("n")
    head = F.concat(F.lit(b"SMK2".hex()), _num(WIDTH, 4), _num(HEIGHT, 4), _num(n, 4), _num(100, 4), _num(0, 4))
    head = F.rpad(F.concat(F.rpad(head, 144, "0"), _num(11025 + (0x40 << 24), 4)), 208, "0")
    palette = lambda f: f % 3 == 0
    sound = lambda f: f % 2 == 0
    size = lambda f: F.when(palette(f), SMK_PALETTE).otherwise(0) + F.when(sound(f), 4 + SMK_SOUND).otherwise(0) + SIZE
    each = lambda make: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), make), "")

    def block(d: Column, f: Column) -> Column:
        byte = lambda k: F.conv(_slice(d, f * SIZE + k, 1), 16, 10).cast("int")
        pick = lambda k, room, flag: F.lpad(F.hex(byte(k) % room + flag), 2, "0")
        return F.concat(F.lit("02"), pick(0, 64, 0x80), pick(1, 64, 0x40), pick(2, 128, 0), pick(3, 64, 0), pick(4, 256, 0), pick(5, 256, 0), F.lit("80"))

    def frame(d: Column, f: Column) -> Column:
        heard = F.concat(_num(4 + SMK_SOUND, 4), _slice(d, f * SIZE, SMK_SOUND))
        return F.concat(F.when(palette(f), block(d, f)).otherwise(""), F.when(sound(f), heard).otherwise(""), _slice(d, f * SIZE, SIZE))

    flags = lambda f: _num(F.when(palette(f), 1).otherwise(0) + F.when(sound(f), 2).otherwise(0), 1)
    return _files(rows, lambda d: F.concat(head, each(lambda f: _num(size(f), 4)), each(flags), each(lambda f: frame(d, f))))


def _chunk(kind: bytes, payload: bytes | np.ndarray) -> bytes | np.ndarray:
    """An IFF chunk of an even number of bytes, or one a record."""
    if isinstance(payload, bytes):
        return kind + struct.pack(">I", len(payload)) + payload
    return _row(kind + struct.pack(">I", payload.shape[1]), payload)


#: The sounds of ANIM files: eight bytes of the slot's number each.
BANK = [f"{k:02X}" * 8 for k in (1, 2, 3)]
ANIM_RELTIME, ANIM_RATE = 2, 8000
_BMHD = _chunk(b"BMHD", struct.pack(">HH4xB5xBBHH", WIDTH, HEIGHT, 8, 1, 1, WIDTH, HEIGHT))


def anim_files(docs: DataFrame) -> DataFrame:
    """ANIM files: a picture of the text's bytes a frame, whole at first and a delta from then on, each with a sound control and 16 bytes of stereo sound, behind a bank of sounds."""
    bank = b"".join(_chunk(b"FORM", b"8SVX" + _chunk(b"BODY", bytes.fromhex(sound))) for sound in BANK)
    sxhd = struct.pack(">BBIIIBBI", 8, 64, 8, 0, 0, 2, 2, ANIM_RATE)
    first = _BMHD + _chunk(b"CMAP", bytes.fromhex("000000FF8040")) + _chunk(b"CAMG", struct.pack(">I", 0x800)) + _chunk(b"SXHD", sxhd)
    later = _chunk(b"ANHD", struct.pack(">B13xI6x", 5, ANIM_RELTIME))

    def build(d: np.ndarray) -> bytes:
        f = np.arange(len(d))
        control = _chunk(b"SCTL", _row(b"\1", _column(32 + f % 64, "u1"), _column(f % 5, ">u2"), struct.pack(">HH8x", 1, 3)))
        sound = _chunk(b"SBDY", d[:, :16])
        frames = [_chunk(b"FORM", _row(b"ILBM" + head, control[at], _chunk(kind, d[at]), sound[at])) for head, kind, at in ((first, b"BODY", slice(1)), (later, b"DLTA", slice(1, None)))]
        return _chunk(b"FORM", b"ANIM" + bank + b"".join(x.tobytes() for x in frames))

    return _built(_padded(docs), build)


def anim_delta_files(docs: DataFrame) -> DataFrame:
    """ANIM files of 8 planes: every ninth frame is a whole picture of the text's bytes, the others change, in every other plane, five rows of each column, none, and two alike; every seventh delta draws to the same buffer again."""
    columns, planes = WIDTH // 8, 8
    size = 11 * columns
    tables = np.array([[64 + size * (p // 2) if p % 2 == odd else 0 for p in range(planes)] for odd in (0, 1)], ">u4").view(np.uint8)

    def build(d: np.ndarray) -> bytes:
        f = np.arange(len(d))
        changed = d.reshape(-1, planes // 2, 2, columns, 8)[f, :, f % 2].reshape(-1, 8)
        runs = _row(b"\3\x85", changed[:, :5], b"\1\0\2", changed[:, 5:6]).reshape(len(d), planes // 2 * size)
        anhd = _chunk(b"ANHD", _row(struct.pack(">B13xI2x", 5, ANIM_RELTIME), _column(np.where(f % 7 == 6, 2, 0), ">u4")))
        frames = [x.tobytes() for x in _chunk(b"FORM", _row(b"ILBM", anhd, _chunk(b"DLTA", _row(tables[f % 2], bytes(32), runs))))]
        frames[::9] = [x.tobytes() for x in _chunk(b"FORM", _row(b"ILBM" + _BMHD, _chunk(b"BODY", d[::9])))]
        return _chunk(b"FORM", b"ANIM" + b"".join(frames))

    return _built(_padded(docs), build)


YAFA_SPEED = 2


def yafa_files(docs: DataFrame) -> DataFrame:
    """YAFA files: the text's bytes as chunky frames; with an even number of frames they count as packed, and their ends are listed."""

    def build(d: np.ndarray) -> bytes:
        n = len(d)
        listed = n % 2 == 0
        ends = _chunk(b"PROF", (np.arange(1, n + 1) * SIZE).astype(">u4").tobytes()) if listed else b""
        return _chunk(b"FORM", b"YAFA" + _chunk(b"INFO", struct.pack(">7H", WIDTH, HEIGHT, 8, YAFA_SPEED, n, 3 if listed else 4, 0)) + ends + _chunk(b"BODY", d.tobytes()))

    return _built(_padded(docs, FLC_FRAMES), build)


def _smk_order(key: int, sizes: list[int]) -> bytes:
    n = len(sizes)
    head = struct.pack("<4s5I48xI28x", b"SMK2", 160, 120, n, 100, 0, 22050 + (0xF0 << 24) if key % 2 else 0)
    return head + struct.pack(f"<{n}I{n}x", *sizes) + b"\xab" * sum(s >> 2 << 2 for s in sizes)


def _bink_order(key: int, sizes: list[int]) -> bytes:
    n, tracks = len(sizes), key % 3
    base, end, ends = 44 + 12 * tracks + 4 * (n + 1), 0, []
    for s in sizes:
        end += s >> 1 << 1
        ends.append(base + end)
    sound = struct.pack(f"<{tracks}I", *range(1000, 1000 + tracks)) + b"".join(struct.pack("<HH", 11025 * (k + 1), 0x1000 if k else 0x7000) for k in range(tracks)) + struct.pack(f"<{tracks}I", *range(7, 7 + tracks))
    return struct.pack("<4s10I", b"BIKi", 0, n, 64, n, 320, 200, 30000, 1001, 0, tracks) + sound + struct.pack(f"<{n + 1}I", base + 1, *ends) + b"\xcd" * end


_ORDERS = {"smk": _smk_order, "bink": _bink_order}


def index_files(lines: DataFrame, *codecs: str, tracks: bool = False) -> DataFrame:
    """SMK or Bink files of an order's lines, or both: a frame a line, in order of line number, of as many bytes as the part's number modulo 64, and 4 more.

    ``tracks``: with sound tracks by the order's number: Bink as many as it leaves modulo 3, Smacker one if it is odd. Lines
    are dealt by order and sorted, so that files of all ``codecs`` are cut from one shuffle of three numbers a line.
    """
    makes = [_ORDERS[c] for c in codecs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, key, sizes = ([], []), 0, None, []

        def files() -> Iterator[pa.RecordBatch]:
            nonlocal out, held
            for make in makes if sizes else ():
                out[0].append(None if key is None else f"order/{key}")
                out[1].append(make(key or 0 if tracks else 0, sizes))
                held += 64 + len(out[1][-1])
            if held > BATCH_BYTES:
                yield packed()
                out, held = ([], []), 0

        packed = lambda: pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["path", "content"])
        for batch in batches:
            for order, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if order != key:
                    yield from files()
                    key, sizes = order, []
                sizes.append(size)
        yield from files()
        yield packed()

    rows = lines.select("l_orderkey", (F.pmod(F.coalesce("l_partkey", F.lit(0)), F.lit(64)) + 4).alias("size"), "l_linenumber", "l_partkey").repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey")
    return rows.select("l_orderkey", "size").mapInArrow(run, "path string, content binary")
