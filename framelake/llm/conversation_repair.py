"""Conversations whose turns are out of order, blank, repeated or cut off, repaired by the cheapest edits.

A conversation is an optional system row and then pairs of user and assistant. The grammar in Chomsky normal form has a
nonterminal ``[p q]`` for each two states of that language, with the rules ``[p q] -> [p r] [r q]``, and ``[p q] -> row``
by an edit of the row: keep, rerole or delete. Insertions derive empty spans; their closure is taken into each row's
cells and into the end. A cell of a span holds the least (cost, audit) of a nonterminal, and spans are combined bottom-up,
each length from the one before. Whatever the split of a span, the rules give the same cell, as both halves range over
all states between; so one split a span is enough, and a conversation takes time in proportion to its rows.
(Least audits of the halves give the least audit of the whole: of two audits of one span and nonterminal at one cost,
neither begins the other, as all further initials would be paid insertions.)

Spark does the rest on rows without their texts: equal rows are counted before they are shuffled, first occurrences are
grouped and joined by (conversation, role, hash of the text), and rows are dealt by range of (conversation, turn, role,
hash), so that a conversation of any length lies over many tasks. A task streams through its rows and writes the cells of
up to ``BLOCK`` rows at a time; blocks of a conversation are folded in order. Only then are texts shuffled, once, to meet
their audit: rows and audit are streamed in order, a row at a time. A conversation's repaired text is written by one
task, since its hash has to be taken in sequence; that task holds its audit and one batch.

Defined results: null roles and texts are one space, null turns come first, a null conversation id is an id like others;
rows of equal turn are taken by role and then MD5 of the text; a row with an empty role adds no initial when kept; a
conversation whose rows all go has an empty repaired text; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framelake.llm.common import materialize, pieces

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Rows of a conversation whose cells a task works out at once.
BLOCK = 1 << 16
_SPACE = " \t\n\v\f\r"

#: The language by states: before anything, after a system row, after a user row, after an assistant row.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
_PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or p != 1 and q in (2, 3) or p == 0 or p == 1 and q > 1]
_AT = {pair: k for k, pair in enumerate(_PAIRS)}
_RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in _PAIRS]

Cells = list[tuple[int, str] | None]


def combine(left: Cells, right: Cells) -> Cells:
    """The cells of a span from those of its two parts."""
    found: Cells = []
    for rules in _RULES:
        best = None
        for a, b in rules:
            x, y = left[a], right[b]
            if x and y and (best is None or x[0] + y[0] <= best[0]):
                way = (x[0] + y[0], x[1] + y[1])
                best = way if best is None else min(best, way)
        found.append(best)
    return found


def _cells(ways: list[tuple[int, int, int, str]]) -> Cells:
    found: Cells = [None] * len(_PAIRS)
    for p, q, cost, initial in ways:
        k = _AT[p, q]
        found[k] = min(found[k] or (cost, initial), (cost, initial))
    return found


_NOTHING = [(p, p, 0, "") for p in range(4)]


@lru_cache(1)
def empty_span() -> Cells:
    """The closure of insertions: what an empty span can stand for."""
    closed, before = _cells(_NOTHING + [(p, q, INSERT, "I") for (p, c), q in STEPS.items() if c in "ua"]), None
    while closed != before:
        closed, before = combine(closed, closed), closed
    return closed


@lru_cache(32)
def row_span(symbol: str) -> Cells:
    """The cells of one row: its role's initial (e: an empty role, o: any other), in upper case if the row is cut off, x if it has to go."""
    ways = [(p, p, DELETE, "D") for p in range(4)]
    if symbol != "x":
        initial, more = symbol.lower(), CUT if symbol.isupper() else 0
        ways += [(p, q, KEEP + more, "K") for (p, c), q in STEPS.items() if c == initial]
        ways += [(p, p, KEEP + more, "K") for p in range(4) if initial == "e"]
        ways += [(p, q, REROLE + more, "R") for (p, c), q in STEPS.items() if c in "ua"]
    return combine(empty_span(), _cells(ways))


@lru_cache(1 << 14)
def _short_span(symbols: str) -> Cells:
    return row_span(symbols) if len(symbols) == 1 else combine(_short_span(symbols[: len(symbols) // 2]), _short_span(symbols[len(symbols) // 2 :]))


def span(symbols: str) -> Cells:
    """The cells of a run of rows, bottom-up by length of the spans."""
    level = [_short_span(symbols[i : i + 8]) for i in range(0, len(symbols), 8)]
    while len(level) > 1:
        level = [combine(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else _cells(_NOTHING)


def cheapest(cells: Cells) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    whole = combine(cells, empty_span())
    return min(x for q in ENDS if (x := whole[_AT[0, q]]))


def apply_audit(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The repaired rows: edit, role, text."""
    state = 0
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = STEPS[state, role[0]] if role else state
        yield edit, role, text


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with every fifth to twentieth kind of row damaged, by CRC-32 of id and turn: dropped, emptied, without ends of sentences, repeated, or given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def _rows(conversations: DataFrame) -> DataFrame:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("turn"), told("role").alias("role"), told("text").alias("text")).withColumn("hash", F.unhex(F.md5("text")))


def _faults(rows: DataFrame) -> DataFrame:
    """A row for all equal rows (``times``), without its text: ``blank``, ``cut`` and ``repeat`` (seen in an earlier turn)."""
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    slim = rows.select("id", "turn", "role", "hash", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    slim = slim.groupBy(*slim.columns).agg(F.count("*").alias("times"))
    first = slim.groupBy("id", "role", "hash").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("id").alias("_id"), F.col("role").alias("_role"), F.col("hash").alias("_hash"), "least", "unnumbered")
    found = slim.join(first, F.col("id").eqNullSafe(F.col("_id")) & (F.col("role") == F.col("_role")) & (F.col("hash") == F.col("_hash")), "left")
    repeat = F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("least")))
    return found.select("id", "turn", "role", "hash", "blank", "cut", F.coalesce(repeat, F.lit(False)).alias("repeat"), "times")


_SUMS = ("distinct", "blank", "duplicate", "truncated", "illegal")
_BLOCK = "part int, seq bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string, " + ", ".join(f"{c} bigint" for c in _SUMS) + ", costs array<bigint>, audits array<string>"


class _Block:
    def __init__(self) -> None:
        self.symbols, self.first_turn, self.last_turn, self.first_initial, self.last_initial, self.sums = [], None, None, None, None, dict.fromkeys(_SUMS, 0)

    def follow(self, turn: int | None, initial: str) -> None:
        """The next row, or the first one of the next block."""
        if self.first_initial is None:
            self.first_initial = initial
        else:
            self.sums["illegal"] += f"{self.last_initial}{initial}" not in ("su", "ua", "au")
        if turn is not None:
            self.sums["distinct"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.last_initial = initial


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order to blocks of one conversation each."""
    now, key, seq = _Block(), None, 0

    def closed(part: int) -> dict:
        nonlocal now, seq
        cells = span("".join(now.symbols))
        row = {"id": key[0], "part": part, "seq": seq, "first_turn": now.first_turn, "last_turn": now.last_turn, "first_initial": now.first_initial, "last_initial": now.last_initial, **now.sums}
        row |= {"costs": [x and x[0] for x in cells], "audits": [x and x[1] for x in cells]}
        now, seq = _Block(), seq + 1
        return row

    out: list[dict] = []
    size = 0
    for batch in batches:
        for r in batch.to_pylist():
            part = r["part"]
            if key != (r["id"],):
                if now.symbols:
                    out.append(closed(part))
                key = (r["id"],)
            gone = r["blank"] or r["repeat"]
            initial = r["initial"]
            symbol = "x" if gone else (initial or "e") if initial in ("s", "u", "a", "") else "o"
            left = r["times"]
            now.sums["blank" if r["blank"] else "duplicate"] += left - (not gone)
            now.sums["truncated"] += not gone and r["cut"]
            while left:
                now.follow(r["turn"], initial)
                now.symbols.append("x" if gone else symbol.upper() if r["cut"] else symbol)
                gone, left = True, left - 1
                size += 1
                if len(now.symbols) >= most:
                    out.append(closed(part))
                if size >= BLOCK:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
    if now.symbols:
        out.append(closed(part))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks in order to a row a conversation."""
    key, now, cells, out, size = None, None, None, [], 0

    def closed() -> dict:
        cost, audit = cheapest(cells)
        s = now.sums
        gaps = 0 if now.last_turn is None else now.last_turn - now.first_turn + 1 - s["distinct"]
        return {"id": key[0], "gaps": gaps, "blank": s["blank"], "duplicate": s["duplicate"], "truncated": s["truncated"], "illegal": s["illegal"], "cost": cost, "audit": audit}

    for batch in batches:
        for slice_at in range(0, batch.num_rows, 256):
            for r in batch.slice(slice_at, 256).to_pylist():
                more = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
                if key != (r["id"],):
                    if now:
                        out.append(closed())
                        size += len(out[-1]["audit"])
                    key, now, cells = (r["id"],), _Block(), more
                    now.first_turn, now.last_turn, now.first_initial, now.last_initial = r["first_turn"], r["last_turn"], r["first_initial"], r["last_initial"]
                    now.sums = {c: r[c] for c in _SUMS}
                else:
                    cells = combine(cells, more)
                    now.follow(r["first_turn"], r["first_initial"])
                    now.sums["distinct"] += r["distinct"] - (r["first_turn"] is not None)
                    now.sums |= {c: now.sums[c] + r[c] for c in ("blank", "duplicate", "truncated", "illegal")}
                    now.last_initial = r["last_initial"]
                    now.last_turn = now.last_turn if r["last_turn"] is None else r["last_turn"]
            if size > BLOCK or len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
    if now:
        out.append(closed())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


_REPORT = ", ".join(f"{c} bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")) + ", audit string"


def _arrow(df: DataFrame, columns: str) -> tuple[T.StructType, pa.Schema]:
    """A schema of the id and ``columns``, as Spark and Arrow have it."""
    schema = T.StructType([T.StructField("id", df.schema["id"].dataType), *T.StructType.fromDDL(columns).fields])
    return schema, to_arrow_schema(schema)


def repair_report(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation with rows: ``id``, gaps in its turns, rows by first fault, illegal pairs, least cost, and the edits' initials in order."""
    order = ("id", "turn", "role", "hash")
    rows = _faults(_rows(conversations)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("id", F.spark_partition_id().alias("part"), "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut", "repeat", "times")
    schema, arrow = _arrow(rows, _BLOCK)
    told, report = _arrow(rows, _REPORT)
    blocks = materialize(rows.mapInArrow(lambda batches: _blocks(batches, arrow, block), schema))
    return blocks.repartition("id").sortWithinPartitions("id", "part", "seq").mapInArrow(lambda batches: _fold(batches, report), told)


def _met(conversations: DataFrame, report: DataFrame) -> DataFrame:
    """Each conversation's report and then its rows, in order within one partition."""
    rows = _rows(conversations)
    told = F.struct(*[F.col(c) for c in report.columns if c != "id"])
    null = F.lit(None)
    heads = report.select("id", told.alias("report"), null.cast("bigint").alias("turn"), null.cast("string").alias("role"), null.cast("binary").alias("hash"), null.cast("string").alias("text"))
    both = heads.unionByName(rows.withColumn("report", null.cast(heads.schema["report"].dataType)))
    return both.repartition("id").sortWithinPartitions("id", F.col("report").isNull(), "turn", "role", "hash").select("id", "report", "role", "text")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict, Iterator[tuple[str, str, str]]]]:
    """Id, report and repaired rows of each conversation, as they come."""
    stream = (r for batch in pieces(batches, 3) for r in batch.to_pylist())
    head = next(stream, None)
    while head:
        after: list[dict | None] = [None]

        def rows(after: list[dict | None] = after) -> Iterator[tuple[str, str]]:
            for r in stream:
                if r["report"]:
                    after[0] = r
                    return
                yield r["role"], r["text"]

        source = rows()
        yield head["id"], head["report"], apply_audit(head["report"]["audit"], source)
        for _ in source:
            pass
        head = after[0]


def repaired_rows(conversations: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: ``id``, ``place`` from 0, ``role``, ``text``, and the ``edit`` that gave the row."""
    met = _met(conversations, repair_report(conversations) if report is None else report)
    schema, arrow = _arrow(met, "place bigint, edit string, role string, text string")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, _, rows in _repaired(batches):
            for place, (edit, role, text) in enumerate(rows):
                out.append({"id": key, "place": place, "edit": edit, "role": role, "text": text})
                size += len(text) + 100
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return met.mapInArrow(write, schema)


def repair_digests(conversations: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """The report with ``repaired_sha256``: of the repaired rows as ``role:text``, joined by newlines."""
    met = _met(conversations, repair_report(conversations) if report is None else report)
    schema, arrow = _arrow(met, _REPORT + ", repaired_sha256 string")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, report, rows in _repaired(batches):
            digest = hashlib.sha256()
            for place, (_, role, text) in enumerate(rows):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            out.append({"id": key, **report, "repaired_sha256": digest.hexdigest()})
            size += len(report["audit"]) + 200
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return met.mapInArrow(write, schema)


def all_conversations(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with a row for every conversation of the table: zeros, an empty audit and the hash of an empty text for those without rows."""
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()

    def filled(c: str) -> Column:
        empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}.get(c, F.lit(0).cast("bigint"))
        return F.coalesce(F.col(c), empty).alias(c)

    return ids.join(found, F.col("_id").eqNullSafe(F.col("id")), "left").select(F.col("_id").alias("conv_id"), *[filled(c) for c in found.columns if c != "id"])
