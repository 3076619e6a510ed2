"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard file is a run of frames. A frame is: the payload's length (8 bytes), the masked CRC-32 of those 8 bytes, the
payload, and the masked CRC-32 of the payload; all little-endian. A payload is the document's id (8 bytes, signed; the
least value stands for null) and its token ids as 4-byte unsigned integers, or 2-byte if the vocabulary allows.
A checksum is masked by turning it right 15 bits and adding a constant, so that a file that holds checksums of its own
data does not look sound by chance.

Documents are range-partitioned by id and sorted, so that shards in order, and records within them, ascend by id. Each
task writes one shard under a name of its own attempt and returns the index rows; the index is then written as Parquet
and names only the shards of the attempts that ended well, so a lost executor or a second attempt leaves no record twice.

Defined results: a null or empty text is a sequence of the end id alone; null ids come first; repeated rows are
records of their own; an empty table gives an empty index and no shard; columns besides id and text are not read.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import pieces, worker_state

END_ID = 1
# Fixed values of the frame format.
MASK_TURN, MASK_ADD = 15, 0xA282EAD8
NULL_ID = -(1 << 63)
#: Words whose ids a task keeps; about 200 bytes each.
CACHE_WORDS = 400_000
#: A shard's text, where that makes more shards than Spark's shuffle partitions, and the records that a task reads in a row.
SHARD_BYTES, READ_BYTES = 128 << 20, 4 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> MASK_TURN | crc << (32 - MASK_TURN)) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(source) -> bytes | None:
    """The next payload of a file, None at its end; a broken frame raises ValueError."""
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("broken record length")
    n = struct.unpack("<Q", head[:8])[0]
    payload, check = source.read(n), source.read(4)
    if len(payload) < n or len(check) < 4 or struct.unpack("<I", check)[0] != masked_crc(payload):
        raise ValueError("broken record")
    return payload


class WordEncoder:
    """A tokenizer whose pre-tokens never span white space, applied word by word with a bounded cache.

    Plain words of ASCII and Latin letters go straight to the model; all else goes through the whole tokenizer. Texts
    with characters that may act across words are encoded whole. The ids are those of encoding the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.cache: dict[str, bytes] = {}
        self.odd = re.compile("[^\t\n\v\f\r -~¡-ɏ]|<[|]")
        latin = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() == c and unicodedata.is_normalized("NFC", c))
        self.plain = re.compile(f"[a-z{latin}]+")
        self.tail = re.compile(f"([a-z{latin}]+)([.,;:!?]+)")
        # byte-level form: printable bytes stand for themselves, the others for characters from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        form = [chr(b) if b in shown else chr(next(rest)) for b in range(256)]
        self.form = {ord(c): "".join(form[b] for b in c.encode()) for c in latin}
        sample = ("thé", "ça,", "mot", "déjà")
        self.direct = all(self._pack(self._direct(w)) == self._pack(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in sample)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def _direct(self, word: str) -> list[int] | None:
        """Ids of a lower-case word of plain letters, with or without closing marks; None for another."""
        if self.plain.fullmatch(word):
            parts = (word,)
        elif m := self.tail.fullmatch(word):
            parts = m.groups()
        else:
            return None
        return [t.id for p in parts for t in self.model.tokenize(p.translate(self.form))]

    def _word(self, word: str) -> bytes:
        ids = self._direct(word) if self.direct else None
        found = self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids if ids is None else ids)
        if len(self.cache) < CACHE_WORDS and len(word) < 64:
            self.cache[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        """The ids of a text, packed."""
        if self.odd.search(text):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        known, word = self.cache.get, self._word
        return b"".join([known(w) or word(w) for w in text.lower().split()])


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and vocabulary."""
    held = worker_state()
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


INDEX = "shard string, shard_number int, record int, doc_id bigint, offset bigint, length bigint, n_tokens bigint, start_in_shard bigint, id_bytes int"


def _writer(folder: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        number, name, out = TaskContext.get().partitionId(), "", None
        end, offset, start, record = None, 0, 0, 0
        try:
            for batch in pieces(batches, 1):
                if out is None:
                    name = f"part-{number:06d}-{uuid.uuid4().hex}.rec"
                    out, encode = fs.open_output_stream(f"{path}/{name}", buffer_size=1 << 20), encoder(tokenizer)
                    end = np.array([END_ID], encode.width).tobytes()
                width, rows = len(end), []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    framed = frame(struct.pack("<q", NULL_ID if doc_id is None else doc_id) + ids)
                    out.write(framed)
                    n = len(ids) // width
                    rows.append((name, number, record, doc_id, offset, len(framed), n, start, width))
                    offset, start, record = offset + len(framed), start + n, record + 1
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes shards to ``folder`` and their index to ``folder/index``; returns the index, a row a document."""
    spark = docs.sparkSession
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    volume = int(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # Spark's estimate; of a join it may be far off
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // SHARD_BYTES if volume < 1 << 50 else 0)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    index = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(_writer(folder, tokenizer), INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _reader(folder: str, with_ids: bool):
    """Reads index rows, fetches each record by its place and checks it."""
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        open_, source = "", None
        for batch in batches:
            rows, held = [], 0
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for shard, offset, length, width, base in zip(*columns, strict=True):
                if shard != open_:
                    if source is not None:
                        source.close()
                    open_, source = shard, fs.open_input_file(f"{path}/{shard}")
                source.seek(offset)
                payload = read_frame(source)
                if payload is None or len(payload) + 16 != length:
                    raise ValueError(f"{shard} does not hold the record at {offset}")
                ids = np.frombuffer(payload, f"<u{width}", offset=8).astype("<u4", copy=False).tobytes()
                doc_id = struct.unpack("<q", payload[:8])[0]
                rows.append((None if doc_id == NULL_ID else doc_id, base, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                held += len(ids) if with_ids else 0
                if held >= READ_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)
        if source is not None:
            source.close()

    return run


def read_records(spark: SparkSession, folder: str, index: DataFrame | None = None, ids: bool = True) -> DataFrame:
    """The records that ``index`` names (all by default): id, start, n_tokens, crc, and (with ``ids``) the ids as packed u32.

    An index of the caller's is read in the order and the partitions that it has, for shuffled reads. All records are
    dealt out by place in runs of ``READ_BYTES``, so that reading is as parallel as the records' volume allows.
    """
    whole = spark.read.parquet(f"{folder}/index")
    totals = whole.groupBy("shard_number").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("length")).alias("bytes"))  # a row a shard
    before = Window.orderBy("shard_number").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard_number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = (whole if index is None else index).join(bases, "shard_number")
    placed = rows.select("shard", "offset", "length", "id_bytes", (F.col("base") + F.col("start_in_shard")).alias("start"))
    if index is None:
        volume = totals.agg(F.sum("bytes")).first()[0] or 0
        placed = placed.repartition(max(1, -(-volume // READ_BYTES)), "shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")
    fields = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return placed.mapInArrow(_reader(folder, ids), f"{fields}, ids binary" if ids else fields)
