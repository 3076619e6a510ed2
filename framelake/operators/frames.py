"""Pixels of frames. A file's frames are a fold, so a task runs it file by file and gives frames in bounded batches.

Each format has a short stepping function from (state, bytes) to state; a broken frame ends its file's rows with an
error, and the frames before it stay.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.operators.chunks import flc_chunks_of
from framelake.operators.frame_index import flc_frames_of

FRAMES = "path string, frame_index int, width int, height int, format string, palette_changed boolean, keyframe boolean, pixels binary, palette binary, error string"
#: Bytes of rows that a task holds as Python objects.
BATCH_BYTES = 4 << 20


def byte_run(data: bytes, size: int) -> bytes:
    """ByteRun1: n below 128 is n + 1 literal bytes, n above repeats a byte 257 - n times, 128 is nothing."""
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise ValueError("byte run cut short")
        n = data[at]
        if n < 128:
            if at + 2 + n > len(data):
                raise ValueError("literal cut short")
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            if at + 2 > len(data):
                raise ValueError("repeat cut short")
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def _paint(row: memoryview, x: int, values: bytes) -> int:
    if x + len(values) > len(row):
        raise ValueError("row overrun")
    row[x : x + len(values)] = values
    return x + len(values)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("data cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def s8(self) -> int:
        return (self.u8() ^ 128) - 128

    def u16(self) -> int:
        return int.from_bytes(self.take(2), "little")


def flc_brun(picture: np.ndarray, data: bytes) -> None:
    """Whole rows of runs: counts of 0 and more repeat a byte, negative ones copy."""
    c = _Cursor(data)
    for row in map(memoryview, picture):
        c.u8()
        x = 0
        while x < len(row):
            n = c.s8()
            x = _paint(row, x, c.take(1) * n if n >= 0 else c.take(-n))


def flc_lc(picture: np.ndarray, data: bytes) -> None:
    """Changed bytes of some rows: counts above 0 copy, negative ones repeat."""
    c = _Cursor(data)
    first, lines = c.u16(), c.u16()
    if first + lines > len(picture):
        raise ValueError("rows past the picture")
    for row in map(memoryview, picture[first : first + lines]):
        x = 0
        for _ in range(c.u8()):
            x += c.u8()
            n = c.s8()
            x = _paint(row, x, c.take(n) if n >= 0 else c.take(1) * -n)


def flc_ss2(picture: np.ndarray, data: bytes) -> None:
    """Changed words of some rows. The top bits of a row's word: 0 packets follow, 2 a last byte, 3 rows to skip."""
    c, y = _Cursor(data), 0
    for _ in range(c.u16()):
        while (op := c.u16()) >> 14:
            if op >> 14 == 3:
                y += 0x10000 - op
            elif op >> 14 == 2 and y < len(picture):
                picture[y, -1] = op & 255
            else:
                raise ValueError("undefined row word")
        if y >= len(picture):
            raise ValueError("rows past the picture")
        x = 0
        for _ in range(op):
            x += c.u8()
            n = c.s8()
            x = _paint(memoryview(picture[y]), x, c.take(2 * n) if n >= 0 else c.take(2) * -n)
        y += 1


def flc_palette(palette: bytearray, data: bytes, six_bits: bool) -> None:
    """Packets of entries to skip and to set; a count of 0 is 256."""
    c, entry = _Cursor(data), 0
    for _ in range(c.u16()):
        entry += c.u8()
        n = c.u8() or 256
        if entry + n > 256:
            raise ValueError("entries past the palette")
        values = np.frombuffer(c.take(3 * n), np.uint8).astype(np.uint16)
        palette[3 * entry : 3 * (entry + n)] = ((values << 2 | values >> 4) & 255 if six_bits else values).astype(np.uint8).tobytes()
        entry += n


def flc_frames(data: bytes) -> Iterator[tuple]:
    """(frame, width, height, format, palette changed, keyframe, pixels, palette) of each frame."""
    width, height = struct.unpack_from("<HH", data, 8)
    picture, palette = np.zeros((height, width), np.uint8), bytearray(768)
    chunks: dict[int, list[tuple]] = {}
    for frame, _, kind, at, size in flc_chunks_of(data):
        chunks.setdefault(frame, []).append((kind, at, size))
    steps: dict[int, Callable] = {15: flc_brun, 12: flc_lc, 7: flc_ss2}
    for frame, *_ in flc_frames_of(data):
        changed = False
        for kind, at, size in chunks.pop(frame, ()):
            payload = data[at : at + size]
            if kind in steps:
                steps[kind](picture, payload)
            elif kind == 16:
                if len(payload) < picture.size:
                    raise ValueError("picture cut short")
                picture[:] = np.frombuffer(payload, np.uint8, picture.size).reshape(picture.shape)
            elif kind == 13:
                picture[:] = 0
            elif kind in (4, 11):
                flc_palette(palette, payload, kind == 11)
                changed = True
        yield frame, width, height, "indexed8", changed, frame == 0, picture.tobytes(), bytes(palette)


def planes_to_chunky(data: bytes, pitch: int, planes: int, width: int, height: int, interleaved: bool = False) -> np.ndarray:
    """Pixels from bit planes, most significant bit first: plane after plane, or the planes of each row together."""
    shape = (height, planes, pitch) if interleaved else (planes, height, pitch)
    packed = np.frombuffer(data, np.uint8, planes * height * pitch)
    bits = np.unpackbits(packed).reshape(*shape[:2], 8 * pitch)[:, :, :width]
    out = np.zeros((height, width), np.uint8)
    for plane in range(planes):
        out |= (bits[:, plane] if interleaved else bits[plane]) << plane
    return out


def ham_to_rgb(pixels: np.ndarray, planes: int, palette: np.ndarray, keep_low: bool = False) -> np.ndarray:
    """Hold-and-modify: the top two bits take a palette entry or change blue, red or green of the pixel to the left.

    The value to hold is found column by column for all rows at once. ``keep_low``: 8-plane changes keep two low bits.
    """
    bits = planes - 2
    op, value = pixels >> bits, (pixels & ((1 << bits) - 1)).astype(np.int32)
    scaled = value << (8 - bits) | value >> max(0, 2 * bits - 8)
    out = np.zeros((*pixels.shape, 3), np.int32)
    now = np.tile(palette[0].astype(np.int32), (len(pixels), 1))
    for x in range(pixels.shape[1]):
        held = op[:, x] == 0
        now = np.where(held[:, None], palette[value[:, x]].astype(np.int32), now)
        for code, channel in ((1, 2), (2, 0), (3, 1)):
            hit = op[:, x] == code
            new = value[:, x] << 2 | now[:, channel] & 3 if keep_low and bits == 6 else scaled[:, x]
            now[:, channel] = np.where(hit, new, now[:, channel])
        out[:, x] = now
    return out.astype(np.uint8)


#: Chunks of a CDXL file that are taken apart at once.
CDXL_RUN = 256


def _alike(data: bytes, at: int, size: int, fixed: int) -> int:
    """How many chunks from ``at`` on, ``CDXL_RUN`` at most, begin like the first one, but for their numbers."""
    n = min(CDXL_RUN, (len(data) - at) // size)
    heads = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)[:, :fixed]
    same = (heads[:, :6] == heads[0, :6]).all(axis=1) & (heads[:, 14:] == heads[0, 14:]).all(axis=1)
    return n if same.all() else int(same.argmin())


def cdxl_frames(data: bytes) -> Iterator[tuple]:
    head = lambda at: struct.unpack_from(">BBIIIHHBBHH", data, at)
    first, at, n, palette, stored, held = head(0), 0, 0, np.zeros((256, 3), np.uint8), None, bytes(768)
    _, info, size, _, _, width, height, _, planes, *_ = first
    pitch, ham = (width + 15) // 16 * 2, info & 3 == 1
    while at + size <= len(data):
        now = head(at)
        if (now[1] & 0xE3, now[2], *now[5:7], now[8]) != (info & 0xE3, size, width, height, planes):
            raise ValueError("the format changes within the file")
        cmap, sound = now[9], now[10]
        if size < 32 + cmap + pitch * planes * height + sound:
            raise ValueError("chunk smaller than what it holds")
        if cmap and data[at + 32 : at + 32 + cmap] != stored:
            stored = data[at + 32 : at + 32 + cmap]
            words = np.frombuffer(data, ">u2", min(256, cmap // 2), at + 32).astype(np.int32)
            palette = np.zeros((256, 3), np.uint8)
            palette[: len(words)] = np.stack([(words >> s & 15) * 17 for s in (8, 4, 0)], axis=1)
            held = palette.tobytes()
        run = _alike(data, at, size, 32 + cmap)
        bodies = np.frombuffer(data, np.uint8, run * size, at).reshape(run, size)[:, 32 + cmap : 32 + cmap + pitch * planes * height]
        # as of one row a chunk, whose planes lie together; the padding of picture rows is cut off then
        pixels = planes_to_chunky(bodies.tobytes(), pitch * height, planes, pitch * height * 8, run, interleaved=True).reshape(run, height, pitch * 8)[:, :, :width]
        for k in range(run):
            picture = ham_to_rgb(pixels[k], planes, palette, keep_low=True) if ham else pixels[k]
            yield n + k, width, height, "rgb888" if ham else "indexed8", cmap > 0, True, picture.tobytes(), None if ham else held
        at, n = at + run * size, n + run


def run_skip_dump(picture: np.ndarray, record: bytes) -> None:
    """DPAN: copies, fills and skips over the flat picture; an empty record changes nothing."""
    if not record:
        return
    if len(record) < 4 or record[0] != 0x42 or record[1]:
        raise ValueError("record header")
    c, at = _Cursor(record[4:]), 0
    while c.at < len(c.data) and at < len(picture):
        op = c.u8()
        if op == 0:
            n, value = c.u8(), c.take(1)
            picture[at : at + n] = value[0]
        elif op < 128:
            n = op
            part = c.take(min(n, len(picture) - at))
            picture[at : at + len(part)] = np.frombuffer(part, np.uint8)
        elif op > 128:
            n = op - 128
        else:
            word = c.u16()
            kind, n = word >> 14, word & 0x3FFF
            if word == 0:
                return
            if kind == 2 and n == 0:
                raise ValueError("undefined operation")
            if kind == 2:
                part = c.take(min(n, len(picture) - at))
                picture[at : at + len(part)] = np.frombuffer(part, np.uint8)
            elif kind == 3 and n:
                picture[at : at + n] = c.u8()
            elif kind == 1 and n:
                n += 0x4000
        at += n


def dpan_frames(data: bytes) -> Iterator[tuple]:
    width, height = struct.unpack_from("<HH", data, 20)
    records, last = struct.unpack_from("<I", data, 8)[0], data[26]
    total = max(records, 1) - 1 if last else records
    found = {}
    for page in range(256):
        base, n, _ = struct.unpack_from("<HHH", data, 1280 + 6 * page)
        n, at = n & 0x3FFF, 2816 + 65536 * page
        if not n or at >= len(data):
            continue
        sizes = struct.unpack_from(f"<{n}H", data, at + 8)
        pos = at + 8 + 2 * n
        for k, size in enumerate(sizes):
            found.setdefault(base + k, (pos, size))
            pos += size
    colours = np.frombuffer(data, np.uint8, 1024, 256).reshape(256, 4)[:, 2::-1].tobytes()
    picture = np.zeros(width * height, np.uint8)
    for frame in range(total):
        if frame not in found:
            raise ValueError(f"no record of frame {frame}")
        at, size = found[frame]
        run_skip_dump(picture, data[at : at + size])
        yield frame, width, height, "indexed8", frame == 0, frame == 0, picture.tobytes(), colours


DECODERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {"flc": flc_frames, "cdxl": cdxl_frames, "dpan": dpan_frames}


def decode_frames(media: DataFrame, upto: int | None = None, palette: bool = True) -> DataFrame:
    """The frames of files (``path``, ``codec``, ``content``), in their order, up to frame ``upto`` if given. Without ``palette`` that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FRAMES.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.string()]
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            for place in range(batch.num_rows):
                path, codec, data = (batch.column(c)[place].as_py() for c in range(3))  # one file at a time
                decode, n = DECODERS.get(codec), -1
                try:
                    for frame in decode(data or b"") if decode else ():
                        n = frame[0]
                        if upto is not None and n > upto:
                            break
                        rows.append((path, *frame[:7], frame[7] if palette else None, None))
                        held += 400 + len(frame[6]) + (len(frame[7]) if palette and frame[7] else 0)
                        if held >= BATCH_BYTES:
                            yield out()
                            rows, held = [], 0
                except (ValueError, struct.error, IndexError) as error:
                    rows.append((path, n + 1, None, None, None, None, None, None, None, str(error)))
        yield out()

    return media.select("path", "codec", "content").mapInArrow(run, FRAMES)
