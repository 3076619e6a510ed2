"""Importance resampling: documents drawn by how much likelier a target corpus makes their words.

Words and runs of words are hashed to buckets, a bucket's gain is the logarithm of its share in the target over its share
in the documents, and a document weighs the sum of its features' gains. Gumbel noise on the weights turns "the highest
scores" into a draw without replacement. No sort of the whole corpus finds the cutoff: scores are written once, and jobs
that count rows above trial values narrow it down (bisection), then the tied ids at the cutoff, then tied rows. Only what
is drawn is dealt out by range and ranked.

Each task adds up its own bucket counts, so that no word is shuffled; a task reads a piece of bounded bytes at a time.

Defined results: a null or empty text has no features and weighs 0, a null id is hashed as an empty string and loses
ties, of rows with equal score and id any fill the draw up, an empty table gives no rows and an empty target is an
all-zero one. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import fresh, materialize, pieces

BUCKETS, RUN, PERCENT, MIN_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Trial values that one count job tries: fifteen are four halvings.
CUTS = 15
#: Features whose gain a task remembers; others are hashed anew.
REMEMBERED = 1 << 20
#: The bytes that are part of words, lower-cased; the rest are gaps.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _words(texts: pa.Array) -> Iterator[list[bytes]]:
    for text in texts.cast(pa.binary()):
        yield (text.as_py() or b"").translate(_WORD_BYTES).split()


def _features(words: list[bytes], longest: int) -> list[bytes]:
    found = list(words)
    for n in range(2, longest + 1):
        found += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return found


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in pieces(batches, 0):
            seen: Counter = Counter()
            for words in _words(batch.column(0)):
                seen.update(_features(words, run))
            at = np.fromiter((zlib.crc32(f) % buckets for f in seen), dtype=np.int64, count=len(seen))
            np.add.at(total, at, np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    parts = texts.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    counts = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        counts[row.bucket] = row.n
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of its smoothed share in the target over that in the raw texts, rounded down."""
    s, t, all_s, all_t = raw.tolist(), target.tolist(), int(raw.sum()), int(target.sum())
    n = len(s)
    return np.array([math.floor(1000 * math.log((y + 1) * (all_s + n) / ((x + 1) * (all_t + n)))) for x, y in zip(s, t, strict=True)], dtype=np.int64)


def _noise(seed: int, key: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, gains: np.ndarray, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, into: str = "_draw", run: int = RUN, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` (all, if not given) and a struct ``into``: ``n_features``, ``n_words``, ``weight``, ``score``."""
    buckets, names = len(gains), docs.columns if keep is None else keep

    class Gains(dict):
        def __missing__(self, feature: bytes) -> int:
            gain = int(gains[zlib.crc32(feature) % buckets])
            if len(self) < REMEMBERED:
                self[feature] = gain
            return gain

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = Gains().__getitem__
        for batch in pieces(batches, 1):
            found = []
            for key, words in zip(batch.column(0).to_pylist(), _words(batch.column(1)), strict=True):
                features = _features(words, run)
                weight = sum(map(gain, features))
                found.append({"n_features": len(features), "n_words": len(words), "weight": weight, "score": weight + _noise(seed, key or "")})
            result = pa.array(found, pa.struct([(c, pa.int64()) for c in ("n_features", "n_words", "weight", "score")]))
            yield pa.RecordBatch.from_arrays([*batch.column(2).flatten(), result], names=[*names, into])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(into, T.StructType([T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight", "score")]))])
    rows = docs.select(F.col(f"`{id}`").cast("string").alias("a"), F.col(f"`{text}`").cast("string").alias("b"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("c"))
    return rows.mapInArrow(score, schema)


def smallest_reaching(count: Callable[[list[int]], list[int]], low: int, high: int, wanted: int) -> int:
    """The smallest value from ``low`` to ``high`` that ``wanted`` rows don't exceed; ``count`` gives the rows up to each of some values in one job."""
    while low < high:
        cuts = sorted({low + (high - low) * k // (CUTS + 1) for k in range(CUTS + 1)})
        for cut, n in zip(cuts, count(cuts), strict=True):
            if n >= wanted:
                high = cut
                break
            low = cut + 1
    return low


def _reach(rows: DataFrame, key: Column, wanted: int) -> int:
    low, high = rows.agg(F.min(key), F.max(key)).first()
    return smallest_reaching(lambda cuts: list(rows.agg(*[F.count_if(key <= F.lit(c)) for c in cuts]).first()), int(low), int(high), wanted)


def draw(scored: DataFrame, id: str = "doc_id", into: str = "_draw", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows of ``scored``, with a ``rank`` in the struct ``into``: of those with ``min_words``, ``percent`` percent are drawn by score, then smaller id; null if not drawn. Ids are whole numbers."""
    if not isinstance(scored.schema[id].dataType, T.IntegralType):
        raise TypeError(f"ids of whole numbers are wanted: the cutoff among equal scores is found by halving, and {id} is {scored.schema[id].dataType.simpleString()}")
    row = fresh(scored.columns, "row")
    rows = materialize(scored.withColumn(row, F.monotonically_increasing_id()))
    key, score, number = F.col(f"`{id}`"), F.col(f"{into}.score"), F.col(row)
    apt = rows.where(F.col(f"{into}.n_words") >= min_words)
    wanted = percent * apt.count() // 100
    ranked = lambda df, rank: df.withColumn(into, F.struct(f"{into}.n_features", f"{into}.n_words", f"{into}.weight", f"{into}.score", rank.cast("bigint").alias("rank"))).drop(row)
    if not wanted:
        return ranked(rows, F.lit(None))
    at = -_reach(apt, -score, wanted)
    tied = apt.where(score == at)
    above, named = (int(x) for x in apt.agg(F.count_if(score > at), F.count_if((score == at) & key.isNotNull())).first())
    left = wanted - above
    if left <= named:
        most = _reach(tied.where(key.isNotNull()), key, left)
        less = tied.where(key < most).count()
        last = _reach(tied.where(key == most), number, left - less)
        among = (key < most) | (key == most) & (number <= last)
    else:
        last = _reach(tied.where(key.isNull()), number, left - named)
        among = key.isNotNull() | (number <= last)
    chosen = F.coalesce((F.col(f"{into}.n_words") >= min_words) & ((score > at) | (score == at) & among), F.lit(False))
    place = fresh(rows.columns, "place")
    order = (score.desc(), key.asc_nulls_last(), number.asc())
    dealt = materialize(rows.where(chosen).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))
    # an id has its partition in the upper bits and the place within it in the lower 33
    part, before, starts = F.shiftright(place, 33), 0, []
    for p, n in sorted(dealt.groupBy(part.alias("p")).count().collect()):  # a row a partition
        starts.append((p, before))
        before += n
    first = dealt.sparkSession.createDataFrame(starts, "_p bigint, _before bigint")
    first = first.select(*[F.col(c).alias(fresh(dealt.columns, c)) for c in first.columns])
    p, b = first.columns
    drawn = dealt.join(F.broadcast(first), part == F.col(p))
    drawn = ranked(drawn, F.col(b) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(place, p, b)
    return drawn.unionByName(ranked(rows.where(~chosen), F.lit(None)))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, into: str = "_draw", buckets: int = BUCKETS, run: int = RUN, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with its weight, score and rank in the draw (``into``); the drawn ones are those with a rank."""
    gains = bucket_gains(bucket_counts(docs, text, buckets, run), bucket_counts(target, text, buckets, run))
    return draw(importance_scores(docs, gains, id, text, keep, into, run, seed), id, into, percent, min_words)
