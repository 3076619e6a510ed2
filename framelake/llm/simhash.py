"""Near-duplicates by SimHash, found through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments, so that of two fingerprints with at most three differing bits one
segment differs by at most one. Each segment is indexed by its variants with one bit masked out; an equality join on
the variants, done by sorting them, brings all such pairs together, and the whole fingerprints are then compared.

Only distinct fingerprints are indexed: copies share one. Within a variant's group, small groups are compared in full
and larger ones are searched breadth first, which gives a spanning forest of their links, never all pairs. A group of
over ``MANY`` fingerprints is dealt out again by the bytes of its other segment, one of which must agree, and if that
leaves over ``MANY``, by the variants of the other three bytes with one bit masked out, of which one must agree. Then 46
of 64 bits are fixed: no group has over 2 ** 18 fingerprints, and no link is lost.

Defined results: a text without words, null included, has fingerprint zero and links like any other; repeated rows
are rows of one class; a null id takes part but is never a component's name, and a class without any id has none;
an empty table gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import fresh, materialize, own_columns, pieces
from framelake.llm.components import connected_components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Groups up to SMALL are compared pair by pair; those over MANY are dealt out again.
SMALL, MANY = 8, 4096


def fingerprint(text: str | None, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest, total = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((digest(g, seed) for g in grams), "<u8", total)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        found = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "fp"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS


def _forest(group: np.ndarray) -> list[np.ndarray]:
    """Links that connect what is connected within a group; one fewer than a component has members."""
    found, rest = [], group
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _near(rest, x)
            if near.any():
                hit = rest[near]
                found.append(np.stack([np.full(len(hit), x), hit]))
                front.extend(hit)
                rest = rest[~near]
    return found


def _group_links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links, as two rows, within the whole groups of equal key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(key)])
    found = [f for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True) for f in _forest(fp[s : s + n])]
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    key, fp = key[few], fp[few]
    for d in range(1, SMALL):
        if len(key) <= d:
            break
        a, b = fp[:-d], fp[d:]
        hit = (key[:-d] == key[d:]) & _near(a, b)
        found.append(np.stack([a[hit], b[hit]]))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _linker(many: int | None):
    """Reads sorted (key, fp) and gives links (hot false: two fingerprints) and rows of large groups (hot true: key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a), pa.array(b)], ["hot", "a", "b"])

        key, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if hot is not None:
                n = np.searchsorted(key, hot, "right")
                yield out(key[:n], fp[:n], True)
                key, fp, hot = key[n:], fp[n:], hot if n == len(key) else None
            if not len(key):
                continue
            cut = np.searchsorted(key, key[-1])
            yield out(*_group_links(key[:cut], fp[:cut]), False)
            key, fp = key[cut:], fp[cut:]
            if many is not None and len(key) > many:
                yield out(key, fp, True)
                key, fp, hot = key[:0], fp[:0], key[0]
        yield out(*_group_links(key, fp), False)

    return run


def _linked(keyed: DataFrame, many: int | None) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linker(many), "hot boolean, a bigint, b bigint")


def near_links(fingerprints: DataFrame, many: int = MANY) -> DataFrame:
    """``a``, ``b``: links between the distinct fingerprints of column ``fp`` which connect all that are MAX_BITS apart or nearer."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    at = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
    bit, upper = F.col("j") % 32, F.col("j") >= 32
    segment = F.when(upper, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(low))
    mask = F.bitwise_not(F.expr("shiftleft(1L, j % 32)"))
    key = F.col("j").cast("bigint") * F.lit(1 << 32) + segment.bitwiseAND(mask)
    first = materialize(_linked(at.select(key.alias("key"), "fp"), many))
    hot = first.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    other = F.expr("(CASE WHEN shiftright(key, 37) = 1 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END)")
    byte = F.expr("shiftright(o, 8 * k) & 255L")
    again = hot.withColumn("o", other).select((F.col("key") * 1024 + F.col("k") * 256 + byte).alias("key"), "fp")
    second = materialize(_linked(again, many))
    rest = second.where("hot").select(F.col("a").alias("key2"), F.col("b").alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("v"))
    rest = rest.withColumns({"key": F.shiftright("key2", 10), "k": F.expr("shiftright(v, 3)")}).where("k != (shiftright(key2, 8) & 3L)").withColumn("o", other)
    variant = F.expr("v * 256L + (shiftright(o, 8 * k) & 255L & ~shiftleft(1L, v % 8))")
    third = _linked(rest.select((F.col("key2") * (1 << 13) + variant).alias("key"), "fp"), None)
    return first.where("NOT hot").select("a", "b").union(second.where("NOT hot").select("a", "b")).union(third.select("a", "b"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``fp`` and ``component`` for each row: the least id that links reach from it, itself included."""
    rows = materialize(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(_fingerprints, f"id {docs.schema[id].dataType.simpleString()}, fp bigint"))
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(near_links(classes), "a", "b")
    members = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = members.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(members.join(names, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: that of the least id, once if it is repeated.

    Rows without an id can't be told apart and are all kept.
    """
    name = fresh(docs.columns, "_near")
    kept = near_duplicates(docs, id, text).where(F.col("id") == F.col("component")).select(F.col("id").alias(f"{name}id")).distinct()
    named = docs.join(kept, F.col(f"`{id}`") == F.col(f"{name}id"))
    once = Window.partitionBy(f"{name}id").orderBy(F.col(f"`{text}`"))
    named = own_columns(named.withColumn(f"{name}n", F.row_number().over(once)).where(f"{name}n = 1"), docs)
    return named.union(docs.where(F.col(f"`{id}`").isNull()))
