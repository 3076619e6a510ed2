"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ten consecutive words of the benchmark items (an item of fewer is one window). Per
pattern length, a shift table over blocks of two words tells how far a scan may jump: a block that ends no pattern
moves it on, past all positions where no pattern can end. Where the shift is zero, the patterns that end in that
block are looked up by their suffix and compared word for word. Documents are scanned whole, in place: no shuffle.

The benchmark is a stated query set. It reaches the tasks in blocks of ``BLOCK_BYTES`` of text, each with tables of its
own; an item longer than a block is cut into parts that overlap by a window less a word, so that no window is lost. In
the tables words are numbers and patterns lie in one run of bytes. ``BLOCKS_AT_ONCE`` blocks at most share a pass over the
rows, and a Python process; then the rows are written with what was found, and the next ones read them. Above ``MAX_BYTES`` the operator refuses, as
there would be too many passes.

Defined results: null or wordless texts have no words and no hits; a null or wordless item has no windows; an item with
a null id still marks words, and counts under the empty name; repeated items count once by id; an empty benchmark hits
nothing; repeated documents are scanned one by one; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import fresh, materialize, own_columns, pieces

WINDOW = 10
BLOCK_BYTES, BLOCKS_AT_ONCE, MAX_BYTES = 2 << 20, 2, 64 << 20

#: A-Z to lower case, and what is neither digit, letter nor beyond ASCII to a space.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def benchmark_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Patterns:
    """Shift and suffix tables for the windows of some items, one pair a window length.

    A block of words is the number that its words' numbers make. The different patterns of a length are sorted by their
    last block, and within it by their bytes, one after the other in ``runs``, four bytes a word; ``ends`` tells which of
    them end in a block, so that those equal to a stretch of text are found by halving, however many share a suffix.
    ``owners`` has the items of all patterns in turn, those of pattern k from ``first[k]`` on.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, words in items:
            if words:
                ids = np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), np.int32, len(words))
                by_length.setdefault(min(window, len(words)), []).append((place[name], ids))
        self.tables = [(m, *self._tables(m, found)) for m, found in sorted(by_length.items())]

    def _tables(self, m: int, items: list[tuple[int, np.ndarray]]) -> tuple:
        block, base = min(2, m), len(self.numbers) + 1
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, m) for _, ids in items])
        owners = np.concatenate([np.full(len(ids) - m + 1, k, np.int32) for k, ids in items])
        keys = windows.astype(np.int64) if block == 1 else windows[:, :-1].astype(np.int64) * base + windows[:, 1:]
        shift: dict[int, int] = {}
        for at in range(keys.shape[1]):  # from the far end of the windows to the near one, so that the least shift stays
            shift.update(dict.fromkeys(np.unique(keys[:, at]).tolist(), keys.shape[1] - 1 - at))
        runs, same = np.unique(np.ascontiguousarray(windows).view(f"V{4 * m}").ravel(), return_inverse=True)
        last = np.zeros(len(runs), np.int64)
        last[same] = keys[:, -1]
        order = np.argsort(last, kind="stable")  # keeps the order of bytes within a block
        last, runs = last[order], runs[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        owned = np.unique(np.c_[rank[same], owners], axis=0)  # an item owns a repeated window once
        first = np.searchsorted(owned[:, 0], np.arange(len(runs) + 1))
        starts = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        ends = dict(zip(last[starts].tolist(), zip(starts.tolist(), np.r_[starts[1:], len(last)].tolist(), strict=True), strict=True))
        return block, base, shift, ends, runs.tobytes(), owned[:, 1].astype(np.int32), first

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans of all occurrences, and the names of the items that have one."""
        spans, names = [], set()
        number = self.numbers.get
        ids = [number(w, 0) for w in words]
        packed = np.array(ids, np.int32).tobytes()
        for m, block, base, shift, ends, runs, owners, first in self.tables:
            at, n, jump, width = m, len(words), m - block + 1, 4 * m
            far, found = shift.get, set()
            while at <= n:
                key = ids[at - 1] if block == 1 else ids[at - 2] * base + ids[at - 1]
                step = far(key, jump)
                if step:
                    at += step
                    continue
                here, (low, high) = packed[4 * (at - m) : 4 * at], ends[key]
                while low < high:
                    middle = (low + high) // 2
                    low, high = (middle + 1, high) if runs[middle * width : (middle + 1) * width] < here else (low, middle)
                if low < ends[key][1] and runs[low * width : (low + 1) * width] == here:
                    if low not in found:
                        found.add(low)
                        names.update(self.names[k] for k in owners[first[low] : first[low + 1]])
                    spans.append((at - m, at))
                at += 1
        return spans, names


def covered(spans: list[tuple[int, int]]) -> int:
    """How many places lie in one of the spans at least."""
    total = last = 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, last))
        last = max(last, end)
    return total


def _scanner(tables: list[Patterns], text_at: int, into: str | None = None):
    """Appends what the blocks of ``tables`` hit to the last two columns, spans and items; or puts the report ``into`` their place.

    All that a task does is one function, as each further one in a row would be a Python process of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_at):
            found: list[tuple] = []
            columns = (batch.column(text_at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))
            for text, spans, items in zip(*(c.to_pylist() for c in columns), strict=True):
                words = benchmark_words(text)
                for patterns in tables:
                    hits, names = patterns.search(words)
                    spans += [x for span in hits for x in span]
                    items += sorted(names)
                if into is not None:
                    hit, items = covered(list(zip(spans[::2], spans[1::2], strict=True))), sorted(set(items))
                    found.append((len(words), hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, spans, items))
                else:
                    found.append((spans, items))
            kinds = [pa.list_(pa.int32()), pa.list_(pa.string())]
            if into is None:
                last = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *last], batch.schema.names)
                continue
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *kinds]
            report = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            struct = pa.StructArray.from_arrays(report, names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], struct], [*batch.schema.names[:-2], into])

    return run


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The words of the benchmark's items in blocks of bounded size, read a partition at a time."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > MAX_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; {MAX_BYTES} are allowed")
    block, held = [], 0
    for row in items.toLocalIterator():
        words, start = benchmark_words(row["t"]), 0
        while start < len(words):
            end = start
            while end < len(words) and held < BLOCK_BYTES:
                held += len(words[end]) + 1
                end += 1
            end = min(len(words), max(end, start + window))  # a part holds one window at least
            block.append((row["i"], words[start:end]))
            start = end if end == len(words) else end - window + 1
            if held >= BLOCK_BYTES:
                yield block
                block, held = [], 0
    if block:
        yield block


def contamination_report(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, into: str = "_hits") -> DataFrame:
    """``docs`` with one more column (or another in the place of one of its name): counts, covered spans (start, end, start, ...), items that occur."""
    docs = docs.drop(into)
    name, at = fresh(docs.columns, "_wm"), docs.columns.index(text)
    found = docs.withColumns({f"{name}1": F.array().cast("array<int>"), f"{name}2": F.array().cast("array<string>")})
    tables: list[Patterns] = []
    for block in benchmark_blocks(benchmark, window=window):
        if len(tables) == BLOCKS_AT_ONCE:
            found, tables = materialize(found.mapInArrow(_scanner(tables, at), found.schema)), []
        tables.append(Patterns(block, window))
    report = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, spans: array<int>, items: array<string>>"
    return found.mapInArrow(_scanner(tables, at, into), docs.withColumn(into, F.lit(None).cast(report)).schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of any item, with their own columns."""
    into = fresh(docs.columns, "_hits")
    return own_columns(contamination_report(docs, benchmark, text, window, into).where(~F.col(into)["contaminated"]), docs)
