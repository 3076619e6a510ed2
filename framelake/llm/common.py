"""What several corpus operators share: the word pattern, a let-binding, and tables in the shared folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII white space only.
WORD_GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """The words of a text; null has none. Replacing the rare gaps first and splitting at a plain space takes no regular expression."""
    spaced = F.coalesce(text, F.lit(""))
    for gap in "\t\n\v\f\r":
        spaced = F.replace(spaced, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def fresh(columns: list[str], prefix: str) -> str:
    """``prefix``, lengthened until no column's name begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix += "_"
    return prefix


def own_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns of ``like`` only, in their order."""
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def shared_dir(spark: SparkSession) -> str:
    """A new folder, named by URI, that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``. Where that is unset, as in local tests, a folder of this machine is set, which
    only a local master can share: on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ours = spark.sparkContext._jsc.sc().getCheckpointDir()
        if ours.isEmpty():
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
            ours = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = ours.get()
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/framelake-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*written: DataFrame) -> None:
    """Deletes what ``materialize`` wrote; nothing that is still to be computed may read it."""
    for df in written:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(conf).delete(path, True)


#: Text that a task turns into Python objects at once.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], *at: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of a row and up to ``PIECE_BYTES`` more in the columns ``at``; no empty ones.

    What a task holds as Python objects is so bounded by bytes, whatever the number of rows in a batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in at)
        part = np.cumsum(sizes) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def worker_state() -> dict:
    """A dict that lives as long as the Python worker process, so that what a task loads serves the next one too."""
    return sys.modules.setdefault("framelake_worker_state", ModuleType("framelake_worker_state")).__dict__


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
