"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histograms of character classes and of common words are compared to those of each language by
Jensen-Shannon distance; a document far from every language is rejected. The language references are the summed
histograms of all documents of that language, so they cost one aggregation and have one row a language.

Defined results: a null or empty text has no words and fails the base rules; a document shorter than the guard
``min_words`` is not judged by distance, nor is one of a named language that has no word list (null is no name); with no
reference (an empty table, or no known ``lang``) only the base rules count; repeated rows are judged one by one; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import fresh, let, own_columns, split_words

# Frequent function words of the four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "que", "un", "est"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las"],
}

# Character classes, as regular expressions over what lower-case letters and white space leave.
CHAR_CLASSES = {
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "symbol": "[#*$%&|<>=_~^{}@\\\\/+\\[\\]]+",
    "accented": "[^\\x00-\\x7F]+",
}
KINDS = [*CHAR_CLASSES, "other", "space", "lower"]

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Distances (0 to 1) beyond which a document is far from a language.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.285
#: Shorter documents are not judged by their common words.
MIN_COMMON_WORDS = 150
#: A language's reference needs so many words.
MIN_REFERENCE_WORDS = 1000


def _all_words() -> list[str]:
    return sorted({w for ws in COMMON_WORDS.values() for w in ws})


def _features(rows: DataFrame) -> DataFrame:
    """Adds to ``_q_text`` (no nulls) what the rules need. Arrays are columns of their own, so that Spark compiles what is done with them."""
    known, whole, rest = _all_words(), F.length("_q_text"), F.length("_q_rest")
    listed = known + [w.capitalize() for w in known]
    # _q_rest: the text without lower-case letters and white space. _q_found: its common words, in lower case
    rows = rows.withColumns({"_q_words": split_words(F.col("_q_text")), "_q_rest": F.regexp_replace("_q_text", r"[a-z\x20\x09-\x0D]+", "")})
    classes = F.array(*[rest - F.length(F.regexp_replace("_q_rest", rule, "")) for rule in CHAR_CLASSES.values()])
    rows = rows.withColumns({"_q_found": F.transform(F.filter("_q_words", lambda w: w.isin(listed)), F.lower), "_q_classes": classes, "_q_solid": F.length(F.array_join("_q_words", ""))})
    named = F.aggregate("_q_classes", F.lit(0), lambda a, n: a + n)
    solid = F.col("_q_solid")
    return rows.withColumns({
        "_q_chars": F.concat("_q_classes", F.array(rest - named, whole - solid, solid - rest)),
        "_q_common": F.array(*[F.size("_q_found") - F.size(F.array_remove("_q_found", w)) for w in known]),
    })


#: Up to so many repeated windows, their places are found by looking each window up among them; beyond, by sorting.
FEW = 32
_REST = 1 << 30


def _repeats(rows: DataFrame) -> DataFrame:
    """Adds ``_q_repeat``: words of ``_q_words`` that lie in a three-word window which the text has twice or more.

    Windows are compared by 64 bits: the hashes of their words, shifted by place and joined. A text whose windows are
    all distinct, as most are, is done then; for the others the places are found and counted, in n log n at most.
    """
    h, two, x = F.col("_q_hashes"), F.col("_q_two"), F.col("_q_windows")
    rows = rows.withColumn("_q_hashes", F.when(F.size("_q_words") >= 3, F.transform("_q_words", lambda w: F.xxhash64(w))))
    rows = rows.withColumn("_q_two", F.zip_with(h, F.slice(h, 2, _REST), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 1))))
    three = F.zip_with(two, F.slice(h, 3, _REST), lambda a, c: a.bitwiseXOR(F.shiftleft(c, 2)))
    rows = rows.withColumn("_q_windows", F.slice(three, F.lit(1), F.size(h) - 2))
    # null where all windows are distinct, and so is all that is made of it
    rows = rows.withColumn("_q_sorted", F.when(F.size(F.array_distinct(x)) < F.size(x), F.sort_array(x)))
    twice = F.zip_with("_q_sorted", F.slice("_q_sorted", 2, _REST), lambda a, b: F.when(a == b, a))
    rows = rows.withColumn("_q_twice", F.array_distinct(F.array_compact(twice)))
    values = F.col("_q_twice")

    def sorted_out(pairs: Column) -> Column:
        none = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("p")))
        before = F.zip_with(pairs, F.concat(none, pairs), lambda x, y: F.struct(x["p"].alias("p"), (x["h"] == y["h"]).alias("hit"), x["h"].alias("h")))
        both = F.zip_with(before, F.slice(pairs, 2, _REST), lambda x, y: F.when(F.coalesce(x["hit"], F.lit(False)) | F.coalesce(x["h"] == y["h"], F.lit(False)), x["p"]))
        return F.sort_array(F.array_compact(both))

    looked_up = F.array_compact(F.transform(x, lambda v, i: F.when(F.array_contains(values, v), i)))
    pairs = F.sort_array(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rows = rows.withColumn("_q_at", F.when(F.size(values) <= FEW, looked_up).when(values.isNotNull(), let(pairs, sorted_out)))
    # windows begin at the ascending places; the words of one are counted up to where the next one begins
    steps = F.zip_with("_q_at", F.slice("_q_at", 2, _REST), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda n, k: n + k)
    return rows.withColumn("_q_repeat", F.when(values.isNull(), 0).otherwise(covered).cast("bigint")).drop("_q_hashes", "_q_two", "_q_windows", "_q_sorted", "_q_twice", "_q_at")


def _x_log_x(x: Column | float) -> Column | float:
    """``x * log2(x)``, 0 at 0."""
    if isinstance(x, Column):
        return F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    return x * math.log2(x) if x > 0 else 0.0


def _distance(p: list[Column], own: list[Column], q: list[float]) -> Column:
    """Jensen-Shannon distance in bits of a row's distribution p from a fixed q; ``own``: ``_x_log_x`` of p.

    The divergence is half of what both distributions sum up to by x log x, less what their mean does.
    """
    total = lambda xs: functools.reduce(operator.add, xs)
    mean = total([_x_log_x((a + b) / 2) for a, b in zip(p, q, strict=True)])
    return F.sqrt(F.greatest((total(own) + math.fsum(map(_x_log_x, q))) / 2 - mean, F.lit(0.0)))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """For each known language, the shares of KINDS and of its common words (rest last) in all its documents."""
    known = _all_words()
    rows = _features(docs.select(F.col(lang).alias("l"), F.coalesce(F.col(text), F.lit("")).alias("_q_text")).where(F.col("l").isin(list(COMMON_WORDS))))
    sums = rows.select("l", F.col("_q_chars").alias("c"), F.col("_q_common").alias("w"), F.size("_q_words").alias("n")).groupBy("l").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(len(KINDS))], *[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(len(known))])
    found = {}
    for row in sums.collect():  # a row a known language
        if row["n"] >= MIN_REFERENCE_WORDS:
            own = [row[f"w{known.index(w)}"] / row["n"] for w in COMMON_WORDS[row["l"]]]
            whole = sum(row[f"c{i}"] for i in range(len(KINDS)))
            found[row["l"]] = [row[f"c{i}"] / whole for i in range(len(KINDS))], [*own, max(0.0, 1 - math.fsum(own))]
    return dict(sorted(found.items()))


def quality_report(docs: DataFrame, text: str = "text", lang: str = "lang", references: dict[str, tuple[list[float], list[float]]] | None = None, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_words: int = MIN_WORDS, min_common: int = MIN_COMMON_WORDS, into: str = "_quality") -> DataFrame:
    """``docs`` with one more column (or another in the place of one of its name): a struct of the base counts, both distances and the verdict.

    ``references``: those of a trusted corpus, as ``language_references`` gives them; by default they are taken from
    ``docs``. The distances are those to the nearest language; null where a guard leaves the document unjudged.
    """
    refs, known = language_references(docs, text, lang) if references is None else references, _all_words()
    docs = docs.drop(into)
    row = fresh([*docs.columns, "_q_"], "_row")  # the row itself, set aside so that no name of it can clash
    d = _repeats(_features(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.coalesce(F.col(text), F.lit("")).alias("_q_text"), F.coalesce(F.col(lang).isin(list(COMMON_WORDS)), F.lit(True)).alias("_q_known"))))
    lines = F.filter(F.split("_q_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = d.withColumns({"_q_lines": lines, "_q_n": F.size("_q_words").cast("bigint")})
    shares = lambda counts, whole: F.transform(counts, lambda x: x / F.greatest(whole, F.lit(1)))
    d = d.withColumns({
        "_q_symbols": (F.length("_q_rest") - F.length(F.regexp_replace("_q_rest", r"[#*$%&|<>]+", ""))).cast("bigint"),
        "_q_dup": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint"),
        "_q_p": shares("_q_chars", F.length("_q_text")), "_q_w": shares("_q_common", F.col("_q_n")),
    })

    d = d.withColumns({"_q_pl": F.transform("_q_p", _x_log_x), "_q_wl": F.transform("_q_w", _x_log_x)})
    for name in refs:  # the share of the words that are no common words of a language
        own = [F.col("_q_w")[known.index(w)] for w in COMMON_WORDS[name]]
        d = d.withColumn(f"_q_rest_{name}", F.greatest(F.lit(0.0), 1 - functools.reduce(operator.add, own)))

    def words_of(name: str) -> tuple[list[Column], list[Column]]:
        places, rest = [known.index(w) for w in COMMON_WORDS[name]], F.col(f"_q_rest_{name}")
        return [*(F.col("_q_w")[k] for k in places), rest], [*(F.col("_q_wl")[k] for k in places), _x_log_x(rest)]

    kinds = [[F.col(c)[i] for i in range(len(KINDS))] for c in ("_q_p", "_q_pl")]

    def nearest(distances: list[Column], guard: int) -> Column:
        return F.when(F.col("_q_known") & (F.col("_q_n") >= guard), F.least(*distances) if len(distances) > 1 else distances[0]) if distances else F.lit(None).cast("double")

    d = d.withColumns({
        "_q_dc": nearest([_distance(*kinds, q) for q, _ in refs.values()], min_words),
        "_q_dw": nearest([_distance(*words_of(name), q) for name, (_, q) in refs.items()], max(min_words, min_common)),
    })
    failed = (F.col("_q_n") < MIN_WORDS) | (100 * F.col("_q_repeat") > MAX_REPEAT_PERCENT * F.col("_q_n"))
    far = F.coalesce(F.col("_q_dc") > max_char, F.lit(False)) | F.coalesce(F.col("_q_dw") > max_word, F.lit(False))
    word_chars = (F.length("_q_text") - F.col("_q_chars")[KINDS.index("space")]).cast("bigint")
    verdict = F.struct(
        F.col("_q_n").alias("n_words"), word_chars.alias("word_chars"), F.col("_q_symbols").alias("n_symbols"), F.col("_q_dup").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"), F.col("_q_dc").alias("char_distance"), F.col("_q_dw").alias("word_distance"), failed.alias("base_failed"), (~failed & ~far).alias("kept"))
    # generated, so that a filter on the verdict stays above and the features are not computed again for it
    return d.select(row, F.explode(F.array(verdict)).alias(into)).select(*[F.col(row)[c].alias(c) for c in docs.columns], into)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    into = fresh(docs.columns, "_quality")
    return own_columns(quality_report(docs, into=into, **options).where(F.col(into)["kept"]), docs)
