"""Writing pictures and sound to a folder: tasks write the files, the returned list names them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

WRITTEN = "path string, frame_index int, file string, bytes bigint"


def ppm(pixels: bytes, palette: bytes | None, width: int, height: int, format: str) -> bytes:
    """A binary PPM; an index past the palette is entry 0."""
    data = np.frombuffer(pixels, np.uint8)
    if format == "indexed8":
        colours = np.frombuffer(palette or b"\0\0\0", np.uint8).reshape(-1, 3)
        data = colours[np.where(data < len(colours), data, 0)]
    elif format == "rgba8888":
        data = data.reshape(-1, 4)[:, :3]
    return f"P6\n{width} {height}\n255\n".encode() + np.ascontiguousarray(data).tobytes()


def write_ppm(frames: DataFrame, folder: str) -> DataFrame:
    """A ``frame_%04d.ppm`` a frame, in a folder a file. Writing a frame again gives the same bytes, so tasks can be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            rows = []
            for path, frame, width, height, format, pixels, palette in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if pixels is None:
                    continue
                own = "".join(c if c.isalnum() else "_" for c in path)
                if own not in made:
                    fs.create_dir(f"{base}/{own}", recursive=True)
                    made.add(own)
                data, name = ppm(pixels, palette, width, height, format), f"{own}/frame_{frame:04d}.ppm"
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(data)
                rows.append((path, frame, name, len(data)))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in WRITTEN.split(", ")])

    return frames.select("path", "frame_index", "width", "height", "format", "pixels", "palette").mapInArrow(run, WRITTEN)


def pcm_to_f32(pcm: bytes) -> bytes:
    """Signed 8-bit samples as little-endian 32-bit floats from -1 to 1."""
    return (np.frombuffer(pcm, np.int8).astype("<f4") / np.float32(128)).tobytes()


def write_f32(audio: DataFrame, folder: str) -> DataFrame:
    """A ``sound_%04d.f32`` a row of ``path``, ``frame_index`` and ``pcm``, at its own rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for path, frame, pcm in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = "".join(c if c.isalnum() else "_" for c in path)
                fs.create_dir(f"{base}/{own}", recursive=True)
                data, name = pcm_to_f32(pcm or b""), f"{own}/sound_{frame:04d}.f32"
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(data)
                rows.append((path, frame, name, len(data)))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in WRITTEN.split(", ")])

    return audio.select("path", "frame_index", "pcm").mapInArrow(run, WRITTEN)
