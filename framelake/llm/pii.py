"""Personal data: addresses and numbers by pattern, and further identifiers by the contexts that these stand in.

Seeds are valid e-mail addresses, IP numbers, card numbers and phone numbers. Each occurrence of a seed, and of any other
run of characters that could be an identifier, votes for its lexical patterns: the two words before it, and the word
before and the word after it. Patterns and instances form a graph, and each round scores a pattern by the mean confidence
of its distinct instances in a kind, then an instance by its patterns together (noisy or). What a pattern needs are
``SUPPORT`` instances of the kind that are sure; instances that become sure support further patterns in the next round.
Instances sure at the end are new identifiers, and all their occurrences are added to the spans.

DataFrame functions only: a text is split at each kind's matches, and the lengths of gaps and matches, summed in order by
a window, are the places of the spans. The texts are read once and never shuffled. The graph is of distinct (pattern,
instance) pairs, keyed by hashes, so that copies count once and a frequent context is added up before it is dealt out.

Defined results: a null text is an empty one and gives no spans; rows of equal or null id are rows of their own; spans of
different kinds may overlap, added ones overlap none of the base; an empty table gives no rows. A context ends 64
characters from its match, or at the match of the same kind before it; a match without a word before it has no pattern.
Patterns are written so that no text, however long, takes more than linear time: possessive repeats and starts at the
begin of a run only, where a later start in the same run could not match either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import fresh, let, materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, SURE = 3, 4, 0.8
#: Lengths of what could be an identifier besides the seeds, and how much text before or after a match is its context.
SHORTEST, LONGEST, CONTEXT = 5, 64, 64
_ADDRESS, _DIGIT, _ANY = "A-Za-z0-9._%+-", "0-9", "A-Za-z0-9._%+@-"


def _begins(run: str) -> str:
    """The begin of a run of these characters, or where the match before has ended."""
    return rf"(?:\G|(?<![{run}]))"


PATTERNS = {
    "email": rf"{_begins(_ADDRESS)}[{_ADDRESS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"{_begins(_DIGIT)}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": rf"(?<![{_ANY}])(?=[{_ADDRESS}]*@|(?:[A-Za-z._%+@-]*+[0-9]){{4}})[{_ANY}]*[A-Za-z0-9]",
}
#: What a text must hold for a kind to be looked for.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    def digit(k: Column) -> Column:
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, k: a + digit(k)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(F.translate(match, " -", ""), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True) if kind == "email" else F.length(match).between(SHORTEST, LONGEST)


def _context(before: Column, after: Column) -> Column:
    """The lexical patterns of a match between two gaps: texts, none if no word stands before it."""
    words = lambda text: F.array_remove(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09-\x0D]+"), "")

    def pair(left: Column, right: Column) -> Column:
        two = F.concat(F.lit("2 "), F.array_join(F.slice(left, F.greatest(F.size(left) - 1, F.lit(1)), 2), " "))
        around = F.concat(F.lit("1 "), F.element_at(left, -1), F.lit(" _ "), F.coalesce(F.get(right, F.lit(0)), F.lit("")))
        return F.when(F.size(left) > 0, F.array(two, around)).otherwise(F.array().cast("array<string>"))

    tail = F.when(F.length(before) > CONTEXT, F.substring(before, -CONTEXT, CONTEXT)).otherwise(before)
    return let(words(tail), lambda left: let(words(F.substring(after, 1, CONTEXT)), lambda right: pair(left, right)))


def matches(text: Column) -> Column:
    """All matches of all kinds, valid or not, in order within a kind: kind by number (4: other), ``i``, ``gap`` before and ``size`` in code points, ``valid``, the value's ``key`` and its ``contexts`` (hashes)."""

    def of(number: int, kind: str) -> Column:
        pattern = PATTERNS[kind]

        def one(gaps: Column, match: Column, i: Column) -> Column:
            family = F.when(F.contains(match, F.lit("@")), "@").otherwise("0")
            contexts = F.transform(_context(F.get(gaps, i), F.get(gaps, i + 1)), lambda c: F.xxhash64(family, c))
            valid = _valid(kind, match)
            return let(valid, lambda ok: F.struct(
                F.lit(number).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(match).alias("size"), ok.alias("valid"),
                F.when(ok, F.xxhash64(match)).alias("key"), F.when(ok, contexts).otherwise(F.array().cast("array<bigint>")).alias("contexts"),
            ))

        found = let(F.split(text, pattern, -1), lambda gaps: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: one(gaps, m, i)))
        there = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]") if kind == "card" else text.rlike("[0-9@]")
        return F.when(there, found)

    parts = [of(number, kind) for number, kind in enumerate(PATTERNS)]
    return F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))


def _places(found: DataFrame, row: str) -> DataFrame:
    """Valid matches with ``start`` and ``end``; others (kind 4) only where they overlap no seed."""
    ordered = Window.partitionBy(row, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.repartition(row).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(ordered)).withColumn("start", F.col("end") - F.col("size")).where("valid")
    seed = F.col("kind") < 4
    before = Window.partitionBy(row).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(row).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("seed_end", F.max(F.when(seed, F.col("end"))).over(before)).withColumn("seed_start", F.min(F.when(seed, F.col("start"))).over(after))
    clear = (F.coalesce("seed_end", F.lit(0)) <= F.col("start")) & (F.coalesce("seed_start", F.col("end")) >= F.col("end"))
    return placed.where(seed | clear).select(row, "kind", "start", "end", "key", "contexts")


def score_graph(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """``edges``: distinct ``pattern``, ``key`` and, for each kind, ``seed_<kind>`` (0 or 1). A row a key: ``key`` and its confidence in each kind."""
    known = {k: F.col(f"seed_{k}") for k in KINDS}
    instances = edges.groupBy("key").agg(*[F.max(known[k]).cast("double").alias(k) for k in KINDS])
    for _ in range(rounds):
        seen = edges.join(instances, "key")
        # patterns: mean confidence, if enough instances are sure
        scores = seen.groupBy("pattern").agg(*[F.when(F.count_if(F.col(k) >= sure) >= support, F.avg(k)).otherwise(0.0).alias(f"p_{k}") for k in KINDS])
        scores = scores.where(F.greatest(*[F.col(f"p_{k}") for k in KINDS]) > 0)
        # instances: seeds stay what they are, others are what their patterns make them
        doubt = lambda k: F.exp(F.sum(F.log(1 - F.least(F.coalesce(f"p_{k}", F.lit(0.0)), F.lit(0.99)))))
        instances = edges.join(scores, "pattern", "left").groupBy("key").agg(*[F.greatest(F.max(known[k]).cast("double"), 1 - doubt(k)).alias(k) for k in KINDS])
        instances = materialize(instances)
    return instances


def find_personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = "_pii", rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """The columns ``keep`` (all, if not given) and ``into``: spans in order, each ``start``, ``kind`` by number, ``end`` (code points, end exclusive) and whether it is ``base``."""
    names = docs.columns if keep is None else keep
    row, found = fresh(names, "_row"), fresh(names, "_found")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias(row), matches(whole).alias(found), *[F.col(f"`{c}`") for c in names]))
    placed = materialize(_places(rows.select(row, F.inline(found)), row))
    edges = placed.select("key", "kind", F.explode("contexts").alias("pattern")).groupBy("pattern", "key")
    edges = materialize(edges.agg(*[F.max((F.col("kind") == n).cast("int")).alias(f"seed_{k}") for n, k in enumerate(KINDS)]))
    scored = score_graph(edges, rounds, support, sure)
    best = F.greatest(*[F.col(k) for k in KINDS])
    kind = F.coalesce(*[F.when(F.col(k) == best, n) for n, k in enumerate(KINDS)])
    new = scored.where(best >= sure).select(F.col("key").alias("_key"), kind.alias("_kind"))
    other = placed.where("kind = 4").select(row, "start", "end", "key")
    added = other.join(new, F.col("key") == F.col("_key")).select(row, "start", F.col("_kind").alias("kind"), "end", F.lit(False).alias("base"))
    spans = placed.where("kind < 4").select(row, "start", "kind", "end", F.lit(True).alias("base")).unionByName(added)
    spans = spans.groupBy(F.col(row).alias(f"{row}_")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias(into))
    none = F.array().cast(spans.schema[into].dataType)
    return rows.join(spans, F.col(row) == F.col(f"{row}_"), "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(into), none).alias(into))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
