"""Pictures as a Spark data source to write to, all of them or none.

``spark.dataSource.register(PictureSink)``, then ``frames.write.format("framelake_pictures").mode("append").save(folder)``.
A task writes to a folder of its own beneath ``_attempts``, which readers of the folder don't look into; when all tasks
have ended well, the driver renames the folders of those attempts that count, one rename a task. If the job fails they are
deleted, and so is what an attempt of a lost executor or a slower twin left, with the folder of all attempts of the job.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from framelake.sources.sinks import ppm

COLUMNS = ("path", "frame_index", "width", "height", "format", "pixels", "palette")


@dataclass
class Attempt(WriterCommitMessage):
    """The folder that a task has written, null if it had no picture, and how many it wrote."""

    folder: str | None
    pictures: int


class PictureWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def write(self, rows: Iterator[Row]) -> Attempt:
        fs, base = self._open()
        own, made, n = f"{base}/_attempts/{self.job}/{uuid.uuid4().hex}", set(), 0
        for row in rows:
            path, frame, width, height, form, pixels, palette = (row[c] for c in COLUMNS)
            if pixels is None:
                continue
            data = ppm(bytes(pixels), None if palette is None else bytes(palette), width, height, form)
            if len(data) != len(f"P6\n{width} {height}\n255\n") + 3 * width * height:
                raise ValueError(f"{path}, frame {frame}: the pixels are not {width} by {height}")
            file = "".join(c if c.isalnum() else "_" for c in path)
            if file not in made:
                fs.create_dir(f"{own}/{file}", recursive=True)
                made.add(file)
            with fs.open_output_stream(f"{own}/{file}/frame_{frame:04d}.ppm") as out:
                out.write(data)
            n += 1
        return Attempt(own if n else None, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, base = self._open()
        if self.overwrite:
            for old in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    fs.delete_dir(old.path)
        for k, message in enumerate(m for m in messages if m and m.folder):
            fs.move(message.folder, f"{base}/part-{k:05d}-{self.job}")
        self._clear(fs, base)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear(*self._open())

    def _clear(self, fs: pyarrow.fs.FileSystem, base: str) -> None:
        if fs.get_file_info(f"{base}/_attempts/{self.job}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{base}/_attempts/{self.job}")


class PictureSink(DataSource):
    """Takes the columns of decoded frames; others are left out."""

    @classmethod
    def name(cls) -> str:
        return "framelake_pictures"

    def writer(self, schema: StructType, overwrite: bool) -> PictureWriter:
        missing = [c for c in COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"pictures need the columns {', '.join(missing)}")
        return PictureWriter(self.options["path"], overwrite)
