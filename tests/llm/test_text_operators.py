import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import decontaminate, mixing, quality_rules, simhash, substring_dedup
from framelake.llm.components import connected_components

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def test_quality_counts_match_brute_force(documents):
    for r in quality_rules.quality_report(documents).collect():
        text, q = r.text or "", r._quality
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        windows, hit = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert q.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (q.kept and q.base_failed)


def test_quality_rejects_what_is_far_from_every_language(spark):
    clean = " ".join("the river of stone and the light in a garden that is to be for it on the hill".split() * 3 + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)])
    rows = [(i, clean.replace("hill", f"hill{i}"), "en") for i in range(20)] + [(99, " ".join(f"{w}%%%$$$" for w in clean.split()), "en"), (98, clean.upper(), "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r._quality for r in quality_rules.quality_report(df).collect()}
    assert not got[99].kept and not got[99].base_failed and not got[98].kept
    assert all(got[i].kept for i in range(20))
    assert sorted(r.doc_id for r in quality_rules.keep_good(df).collect()) == list(range(20))


def test_quality_leaves_other_languages_to_the_base_rules(spark):
    text = lambda i: " ".join("the river of stone and the light in a garden that is to be for it on the hill".split() * 3 + [f"word{chr(97 + k % 26)}{chr(97 + i)}{chr(97 + k // 26)}" for k in range(200)])
    odd = " ".join(f"слово{chr(0x430 + k % 26)}{chr(0x430 + k // 26)}" for k in range(200))
    rows = [(i, text(i), "en") for i in range(20)] + [(90, odd, "ru"), (91, odd, "en"), (92, odd, None), (93, "слово", "ru")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r._quality for r in quality_rules.quality_report(df).collect()}
    assert got[90].kept and got[90].char_distance is None and not got[91].kept and not got[92].kept and not got[93].kept
    trusted = quality_rules.language_references(df.where("doc_id < 20"))
    junk = df.where("doc_id IN (5, 91)")  # references of a trusted corpus judge a corpus of junk
    assert {r.doc_id: r._quality.kept for r in quality_rules.quality_report(junk, references=trusted).collect()} == {5: True, 91: False}


@pytest.mark.parametrize("few", [0, 32])
def test_repeated_windows_by_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(quality_rules, "FEW", few)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefghij"[: 2 + i % 9]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    for r in quality_rules.quality_report(df, references={}).collect():
        w = words(r.text)
        seen = Counter(zip(w, w[1:], w[2:]))
        assert r._quality.n_repeat_words == len({k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)})


def test_quality_expressions_hold_no_python(documents):
    plan = quality_rules.quality_report(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(documents):
    none = documents.where("false")
    assert quality_rules.keep_good(none).collect() == [] and simhash.keep_one(none).collect() == []
    assert substring_dedup.dedup_report(none).collect() == [] and mixing.mix(none).collect() == []
    bench = none.select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.drop_contaminated(none, bench).collect() == []
    assert decontaminate.drop_contaminated(documents, bench).count() == documents.count()


def brute_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_duplicates_match_brute_force(documents):
    got = simhash.near_duplicates(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect() if r.doc_id is not None and len(r.text or "") < 5000}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert all(r.fp % 2**64 == prints[r.id] for r in got if r.id in prints)
    by_row = [(r.id, r.fp % 2**64) for r in got]
    root = list(range(len(by_row)))
    for _ in root:
        for i, (_, a) in enumerate(by_row):
            for j, (_, b) in enumerate(by_row):
                if (a ^ b).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    names = {}
    for (i, _), r in zip(by_row, root, strict=True):
        if i is not None:
            names[r] = min(i, names.get(r, i))
    assert sorted((str(r.id), r.component) for r in got) == sorted((str(i), names.get(r)) for (i, _), r in zip(by_row, root, strict=True))
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and {100, 101, 102, 200, 201}.isdisjoint(ids) and ids.count(10) == 1 and 400 in ids and 401 not in ids


def test_every_link_of_a_whole_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    prints = np.array([simhash.fingerprint(r.text) for r in rows], np.int64).view(np.uint64)
    assert all(int(prints[k]) == brute_fingerprint(rows[k].text) for k in range(0, len(rows), 50))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    ids = np.array([r.doc_id for r in rows])
    least = ids.copy()
    while True:
        now = np.where(near, least[None, :], ids.max()).min(axis=1)
        if (now == least).all():
            break
        least = now
    assert near.sum() > len(rows)
    assert {r.id: r.component for r in simhash.near_duplicates(docs).collect()} == dict(zip(ids.tolist(), least.tolist(), strict=True))


@pytest.mark.parametrize("many", [8, 2])
def test_large_groups_are_dealt_again_without_losing_links(spark, many):
    rng = np.random.default_rng(1)
    prints = set()
    for x in rng.integers(0, 2**63, 10):
        for _ in range(40):
            y = int(x)
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                y ^= 1 << int(k)
            prints.add(y - 2**64 if y >= 2**63 else y)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in prints], "fp bigint"), many=many)
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in links.collect())
    root = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    order = sorted(prints)
    want = {x: x for x in order}
    for _ in range(12):
        for a in order:
            want[a] = min(want[b] for b in order if ((a ^ b) % 2**64).bit_count() <= 3)
    assert {x: root.get(x, x) for x in order} == want


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a bigint, b bigint")
    assert {r.node: r.root for r in connected_components(edges, "a", "b").collect()} == {i: 0 for i in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("chunk", [50, 1_000_000])
def test_repeated_passages_match_brute_force(documents, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    got = substring_dedup.dedup_report(documents).collect()
    all_words = {r.key: words(r.text) for r in documents.collect()}
    seen = Counter(tuple(w[i : i + 35]) for w in all_words.values() for i in range(len(w) - 34))
    assert len(got) == len(all_words)
    for r in got:
        w = all_words[r.key]
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r._dedup.n_words, r._dedup.n_removed) == (len(w), len(gone))
        assert r._dedup.kept_text == left
        assert sum(b - a for a, b in zip(r._dedup.spans[::2], r._dedup.spans[1::2], strict=True)) == len(gone)


@pytest.mark.parametrize("chunk", [300, 1_000_000])
def test_repeated_rows_cost_no_more_than_others(spark, prose, monkeypatch, chunk):
    """Equal rows, also without id, and different texts of one id; each row loses what it shares with any other."""
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    a, b, c, d = (" ".join(prose(s, 120)) for s in (1, 2, 3, 4))
    rows = [(7, a)] * 500 + [(8, a + " x " + b)] + [(None, c)] * 3 + [(9, b), (9, d), (9, None)]
    got = substring_dedup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r._dedup.n_words, r._dedup.n_removed) for r in got) == Counter({(7, 120, 120): 500, (8, 241, 240): 1, (None, 120, 120): 3, (9, 120, 120): 1, (9, 120, 0): 1, (9, 0, 0): 1})


def test_the_cover_aligns_any_two_places():
    d = substring_dedup.COVER
    assert all(any((i + k) % 21 in d and (j + k) % 21 in d for k in range(21)) for i in range(21) for j in range(21))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(1, 40))
def test_window_hashes_depend_on_the_window_alone(values, size):
    h = np.array(values, np.uint64)
    got = substring_dedup.window_hashes(h, size)
    assert len(got) == max(0, len(h) - size + 1)
    for i in range(len(got)):
        assert got[i] == substring_dedup.window_hashes(h[i : i + size].copy(), size)[0]


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return BENCH_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_contamination_matches_brute_force(spark, documents, prose, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, " ".join(prose(3, 120)[20:45]).upper() + "!"), (2, "one two"), (3, None), (4, "..."), (5, " ".join(prose(77, 30))), (None, " ".join(prose(4, 120)[:12])), (1, " ".join(prose(8, 120)[90:101])), (6, "Ünï")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    patterns = {}
    for name, text in items:
        w = bench_words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[i : i + m]), set()).add("" if name is None else str(name))
    for r in decontaminate.contamination_report(documents, bench).collect():
        w, hit, names = bench_words(r.text), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if found := patterns.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    names |= found
        want = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
        assert (r._hits.n_words, r._hits.n_hit, r._hits.n_items, r._hits.items_sha256, r._hits.contaminated) == want
    assert 3 not in [r.doc_id for r in decontaminate.drop_contaminated(documents, bench).collect()]


def test_long_items_are_cut_without_losing_windows(spark, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    item = prose(5, 700)
    bench = spark.createDataFrame([("long", " ".join(item)), ("short", "only three words")], "item_id string, text string")
    blocks = list(decontaminate.benchmark_blocks(bench))
    assert len(blocks) > 5 and {n for block in blocks for n, _ in block} == {"long", "short"}
    windows = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    assert set().union(*(windows(w) for block in blocks for n, w in block if n == "long")) == windows([w.encode() for w in item])
    docs = spark.createDataFrame([(i, " ".join(["own", *item[i : i + 10], "end"])) for i in range(0, 690, 23)], "doc_id bigint, text string")
    assert all((r._hits.n_hit, r._hits.n_items) == (10, 1) for r in decontaminate.contamination_report(docs, bench).collect())


def test_a_benchmark_beyond_the_bound_is_refused(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BYTES", 10)
    with pytest.raises(ValueError):
        decontaminate.contamination_report(documents, spark.createDataFrame([(1, "long enough text")], "item_id bigint, text string"))


def test_targets_share_out_what_is_cut():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    got = mixing.targets({"a": 10, "b": 1000, "c": 1000})
    assert got["a"] == 30 and got["b"] == pytest.approx(1980 * 2 / 3) and sum(got.values()) == pytest.approx(2010)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mixing_meets_targets_and_repeats_itself(spark, documents):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = mixing.systematic_sample(df).toPandas()
    again = mixing.systematic_sample(df.repartition(7)).toPandas()
    assert first.sort_values("id").copies.tolist() == again.sort_values("id").copies.tolist()
    taken = (first.copies * first["size"]).groupby(first.source).sum()
    goal = first.groupby("source").target.first()
    assert ((taken - goal).abs() <= 60).all() and first.copies.max() <= 3
    assert (first.groupby("source")["size"].sum() == first.groupby("source").source_size.first()).all()
    got = mixing.mix(documents)
    assert got.columns == documents.columns
    wanted = Counter()
    for r in mixing.systematic_sample(documents).collect():
        wanted[r.id, r.size] += r.copies
    found = Counter((r.doc_id, len(words(r.text))) for r in got.collect())
    assert found == Counter({k: v for k, v in wanted.items() if v})


def test_many_items_of_one_suffix_are_found_fast():
    import time

    items = [(f"i{k}", [b"w%d" % (k * 7 % 997), b"v%d" % k, *[b"x"] * 6, b"the", b"end"]) for k in range(30_000)]
    many = decontaminate.Patterns(items + [(f"copy{k}", items[5][1]) for k in range(3000)])
    text = ([b"a"] * 8 + [b"the", b"end"]) * 1000 + items[5][1] + items[29_999][1]
    began = time.perf_counter()
    spans, names = many.search(text)
    assert time.perf_counter() - began < 0.2
    assert spans == [(10_000, 10_010), (10_010, 10_020)] and names == {"i5", "i29999", *(f"copy{k}" for k in range(3000))}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_a_task_of_the_search_takes_one_python_process(spark, sf_dir, prose, monkeypatch, block):
    """Each function in a row has a process of its own, which stays, and then serves other stages and keeps what these load."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.createDataFrame([(1, " ".join(prose(77, 30))), (2, " ".join(prose(78, 12)))], "item_id bigint, text string")
    assert (len(list(decontaminate.benchmark_blocks(bench))) > 1) == (block == 100)
    assert plan_of(decontaminate.drop_contaminated(docs, bench)).count("MapInArrow") == 1


def test_mixing_takes_no_python_process(spark, sf_dir):
    """Rows of Python objects would be turned into Spark's by Python processes of a kind of their own on the executors."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = plan_of(mixing.systematic_sample(docs))
    assert "ExistingRDD" not in plan and "Python" not in plan
