"""Substring dedup: removes words in passages of ``WINDOW`` words or more that the corpus has twice.

Anchors stand at the places of a document that a difference cover modulo ``PERIOD`` names: for any two places some
shift below PERIOD brings both onto the cover. So the two ends of any match of WINDOW words share an anchor, a shorter
window of ``ANCHOR`` words, at the same offset, and only the anchors, a quarter of all places, are shuffled. Where an
anchor recurs, the match is extended: the full windows around it, and those alone, are compared over the corpus by 96
bits of hash, and those that recur are marked.

Before each shuffle a task combines its own rows: of equal hashes one goes on under its hash, and the others, known to
recur, are spread evenly; so no key has more rows than there are chunks, whatever the copies. Sorted rows are then
compared with their neighbours in constant memory.

A text is named by its id, or where ids are repeated or null by a hash of id and text; so rows equal in both share one
name. A task hashes such a text once and takes it as recurring, so that repeated rows cost no more than other ones.

Defined results: a null or empty text has no words; texts shorter than WINDOW lose nothing; repeated rows are
occurrences of their own, so that all copies lose what they share, and so are rows of one id with different texts; an
empty table gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import fresh, materialize, pieces

WINDOW = 35
# A difference cover modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Rows that a task combines at once.
CHUNK = 1_000_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _M1 + (b ^ (b >> np.uint64(29))) * _M2
    h ^= h >> np.uint64(32)
    h *= _M3
    h ^= h >> np.uint64(29)
    return h


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, joined from runs of powers of two."""
    n = len(h) - size + 1
    if n <= 0:
        return h[:0]
    found, at, step, run = None, 0, 1, h
    while True:
        if size & step:
            part = run[at : at + n]
            found = part if found is None else _join(found, part)
            at += step
        if step * 2 > size:
            return found
        run, step = _join(run[:-step], run[step:]), step * 2


def _sums(h: np.ndarray, size: int) -> np.ndarray:
    """32 more bits for every run of ``size`` words."""
    total = np.r_[np.uint64(0), np.cumsum(h * _M3, dtype=np.uint64)]
    return ((total[size:] - total[:-size]) >> np.uint64(32)).astype(np.int64)


#: h: the hash. xp: 32 more bits of it, below the place. id: the text's name. kv: what is known of the hash, above the kind of the name.
#: What varies from row to row stands together, so that the rest of a shuffled row packs into one repeat of the row before.
_ROWS = "h bigint, xp bigint, id bigint, kv bigint"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
SHIFT, LOW = 32, (1 << 32) - 1
#: One occurrence so far; the one of several in its chunk that stands for its hash; another of these.
ONE, FIRST, KNOWN = 0, 1, 2
#: Bits of an anchor's hash. Two anchors that agree in these by chance are told apart when they are extended.
ANCHOR_MASK = np.uint64((1 << 48) - 1)


#: What a text's name is: its id, which no other row has, or a hash of id and text, which equal rows share.
BY_ID, BY_TEXT = 0, 1


class _Chunks:
    """Collects rows and gives them combined, a chunk at a time, in the order in which they came."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0
        self.shared: dict[int, int] = {}  # texts named by hash, and where they are held
        self.again: set[int] = set()

    def has(self, id: int, version: int) -> bool:
        """Whether the chunk has this text from an equal row; then all its rows recur, and are not needed again."""
        if version == BY_ID:
            return False
        at = self.shared.setdefault(id, len(self.held))
        if at == len(self.held):
            return False
        self.again.add(at)
        return True

    def add(self, h: np.ndarray, x: np.ndarray, id: int, version: int, places: np.ndarray) -> None:
        self.held.append((h.view(np.int64), x, np.full(len(h), id, np.int64), np.full(len(h), version, np.int64), places.astype(np.int64)))
        self.n += len(h)

    def take(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        again = np.repeat([k in self.again for k in range(len(self.held))], [len(c[0]) for c in self.held])
        h, x, id, version, place = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.n, self.shared, self.again = [], 0, {}, set()
        order = np.lexsort((x, h))
        same = np.r_[False, (h[order[1:]] == h[order[:-1]]) & (x[order[1:]] == x[order[:-1]])]
        kind = np.empty(len(h), np.int64)
        kind[order] = np.where(same, KNOWN, np.where(np.r_[same[1:], False], FIRST, ONE))
        kind[again & (kind == ONE)] = FIRST
        known = kind == KNOWN  # need no hash any more; a document's go together
        h = np.where(known, (id.view(np.uint64) * _M1 >> np.uint64(20)).view(np.int64), h)
        xp = np.where(known, 0, x & LOW) | place << SHIFT
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, xp, id, kind << SHIFT | version)], _NAMES)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed anchors of each text."""
    size, chunks = WINDOW - PERIOD + 1, _Chunks()
    for batch in pieces(batches, 2):
        for id, version, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            words = split(text)
            if len(words) < WINDOW or chunks.has(id, version):
                continue
            h = window_hashes(word_hashes(words), size)
            places = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(len(h)) % PERIOD])
            chunks.add(h[places] & ANCHOR_MASK, np.zeros(len(places), np.int64), id, version, places)
            if chunks.n >= CHUNK:
                yield from chunks.take()
    yield from chunks.take()


def _places(found: list[int] | None) -> np.ndarray:
    return np.unique(np.asarray(found or [], np.int64))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full windows around the recurring anchors, which are the last column, of each text."""
    chunks = _Chunks()
    for batch in pieces(batches, 2):
        columns = [batch.column(c).to_pylist() for c in (0, 1, 2, batch.num_columns - 1)]
        for id, version, text, anchors in zip(*columns, strict=True):
            if not anchors or chunks.has(id, version):
                continue
            words, at = word_hashes(split(text)), _places(anchors)
            n = len(words) - WINDOW + 1
            marks = np.zeros(n + 1, np.int32)
            np.add.at(marks, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(marks, np.minimum(at + 1, n), -1)
            places = np.flatnonzero(np.cumsum(marks)[:n])
            chunks.add(window_hashes(words, WINDOW)[places], _sums(words, WINDOW)[places], id, version, places)
            if chunks.n >= CHUNK:
                yield from chunks.take()
    yield from chunks.take()


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, the places whose hash has another row or is known to recur."""
    held = [np.zeros(0, np.int64) for _ in range(4)]
    decided = 0  # of the held rows, those that are there to be compared with only

    def decide(upto: int) -> pa.RecordBatch:
        h, xp, id, kv = held
        same = (h[1:] == h[:-1]) & (xp[1:] & LOW == xp[:-1] & LOW)
        keep = ((kv >> SHIFT != ONE) | np.r_[False, same] | np.r_[same, False])[decided:upto]
        at = (kv & LOW) << SHIFT | xp >> SHIFT
        return pa.RecordBatch.from_arrays([pa.array(id[decided:upto][keep]), pa.array(at[decided:upto][keep])], ["id", "at"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = [np.concatenate([a, batch.column(c).to_numpy(zero_copy_only=False)]) for c, a in enumerate(held)]
        yield decide(len(held[0]) - 1)
        decided = min(1, len(held[0]) - 1)
        held = [c[-2:] for c in held]
    if len(held[0]):
        yield decide(len(held[0]))


def _where_recurring(rows: DataFrame) -> DataFrame:
    """``key``, ``version`` and ``places`` (an array): where rows whose hash recurs come from."""
    found = rows.repartition("h").sortWithinPartitions("h", F.col("xp").bitwiseAND(F.lit(LOW))).mapInArrow(_recurring, "id bigint, at bigint")
    version = F.shiftright("at", SHIFT).cast("int").alias("version")
    return found.groupBy(F.col("id").alias("key"), version).agg(F.collect_list(F.col("at").bitwiseAND(F.lit(LOW)).cast("int")).alias("places"))


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """A text's name as ``key`` and ``version``, the text, and the row. Only ids are read to find those that are repeated."""
    own, name = F.col(f"`{id}`").cast("bigint"), fresh(docs.columns, "_again")
    # written first: with its size known, Spark broadcasts it if it is small
    again = materialize(docs.select(own.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name))
    rows = docs.join(again, own == F.col(name), "left")
    shared = own.isNull() | F.col(name).isNotNull()
    # never null: a join that filters nulls out would not find the exchange of the other one
    key, version = F.when(shared, F.xxhash64(own, f"`{text}`")).otherwise(F.coalesce(own, F.lit(0))), F.when(shared, BY_TEXT).otherwise(BY_ID)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    return rows.select(key.alias("key"), version.alias("version"), F.col(f"`{text}`").alias("text"), row.alias("row"))


def _remover(into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            counts, removed, kept, spans = [], [], [], []
            for text, places in zip(*(batch.column(c).to_pylist() for c in (2, 4)), strict=True):
                words, starts = split(text), _places(places)
                cover, left, edges = np.zeros(len(words) + 1, np.int32), words, starts
                if len(starts):
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + WINDOW, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    left = [words[i] for i in np.flatnonzero(~gone)]
                    edges = np.flatnonzero(np.diff(np.r_[0, gone, 0]))
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                spans.append(edges.tolist())
            fields = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.int32()))]
            report = pa.StructArray.from_arrays(fields, names=["n_words", "n_removed", "kept_text", "spans"])
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), report], ["text", "row", into])

    return run


def dedup_report(docs: DataFrame, id: str = "doc_id", text: str = "text", into: str = "_dedup") -> DataFrame:
    """``docs`` with one more column (or another in the place of one of its name): counts, the kept words joined by spaces, the removed spans.

    The texts are shuffled once, by name; both joins read that exchange.
    """
    docs = docs.drop(into)
    texts = _texts(docs, id, text)
    anchors = _where_recurring(texts.mapInArrow(_anchors, _ROWS))
    windows = _where_recurring(texts.join(anchors, ["key", "version"]).mapInArrow(_windows, _ROWS))
    report = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("spans", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField("text", texts.schema["text"].dataType), texts.schema["row"], T.StructField("report", report)])
    done = texts.join(windows, ["key", "version"], "left").mapInArrow(_remover("report"), schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns], F.col("report").alias(into))
