import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from framelake.llm import decontaminate, mixing, quality_rules, simhash
from tests.llm.test_text_operators import bench_words, brute_fingerprint, words


def shares(counts, whole):
    return [x / max(whole, 1) for x in counts]


def brute_histograms(text):
    q, w = quality_rules, words(text)
    rest = re.sub(r"[a-z\x20\x09-\x0D]", "", text)
    classes = [sum(len(x) for x in re.findall(rule, rest)) for rule in q.CHAR_CLASSES.values()]
    solid = sum(map(len, w))
    chars = [*classes, len(rest) - sum(classes), len(text) - solid, solid - len(rest)]
    listed = {x for ws in q.COMMON_WORDS.values() for x in ws}
    return chars, Counter(x.lower() for x in w if x in listed or (x[0].lower() + x[1:] in listed and x == x.capitalize()))


def brute_distance(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2))


def brute_quality(rows):
    q, refs = quality_rules, {}
    for lang, listed in q.COMMON_WORDS.items():
        own = [r.text or "" for r in rows if r.lang == lang]
        n = sum(len(words(t)) for t in own)
        if n >= q.MIN_REFERENCE_WORDS:
            found = [brute_histograms(t) for t in own]
            common = [sum(c[w] for _, c in found) / n for w in listed]
            refs[lang] = shares([sum(c[k] for c, _ in found) for k in range(len(q.KINDS))], sum(map(len, own))), [*common, 1 - sum(common)]
    kept = []
    for r in rows:
        text = r.text or ""
        w, (chars, common) = words(text), brute_histograms(text)
        seen, hit = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        far = False
        if refs and (r.lang is None or r.lang in q.COMMON_WORDS):
            far = min(brute_distance(shares(chars, len(text)), c) for c, _ in refs.values()) > q.MAX_CHAR_DISTANCE
            if len(w) >= q.MIN_COMMON_WORDS:
                own = {lang: [common[x] / len(w) for x in q.COMMON_WORDS[lang]] for lang in refs}
                far |= min(brute_distance([*own[lang], max(0, 1 - sum(own[lang]))], ref) for lang, (_, ref) in refs.items()) > q.MAX_WORD_DISTANCE
        if len(w) >= 50 and 100 * len(hit) <= 50 * len(w) and not far:
            kept.append(r)
    return kept


def brute_near(rows):
    prints = [brute_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[k] = min(r.doc_id, least.get(k, r.doc_id))
    once = {}
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None and r.doc_id == least[k]:
            once[r.doc_id] = r
    return [*once.values(), *(r for r in rows if r.doc_id is None)]


def brute_clean(rows, items):
    patterns = {tuple(w[i : i + min(10, len(w))]) for w in map(bench_words, items) if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(p) for p in patterns}
    return [r for r in rows if not any(tuple(w[i : i + m]) in patterns for w in [bench_words(r.text)] for m in sizes for i in range(len(w) - m + 1))]


def brute_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    goal, out = mixing.targets(sizes), []
    for source, size in sizes.items():
        own = sorted((r for r in rows if r.source == source), key=lambda r: (len(words(r.text)), r.doc_id is not None, r.doc_id))
        u = int(hashlib.md5(f"{mixing.SEED}:{source or ''}".encode()).hexdigest()[:13], 16) / (1 << 52)
        rate = goal[source] / size if size else 0.0
        for k, r in enumerate(own):
            out += [r] * min(3, math.floor(u + rate * (k + 1)) - math.floor(u + rate * k))
    return out


def test_the_pipeline_matches_brute_force(spark, documents, prose, tmp_path):
    """All stages over documents with nulls, copies, repeated rows, very long texts and clashing columns, against plain Python."""
    rows = documents.collect()
    items = [" ".join(prose(3, 120)[20:45]), None, "one two", " ".join(prose(500, 30_000)[9000:9012])]
    documents.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    good = brute_quality(rows)
    one = brute_near(good)
    clean = brute_clean(one, items)
    assert len(rows) > len(good) > len(one) > len(clean) > 0
    whole, want = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), []
    for r in brute_mix(clean):
        ids = np.array(whole.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


def test_the_pipeline_of_an_empty_table(spark, documents, tmp_path):
    none = documents.where("false")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    none.select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_hand_on_documents_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "token_records"]
    before = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, sf_dir))
        assert after.columns == docs.columns
        ids, old = ({r.doc_id for r in x.select("doc_id").collect()} for x in (after, before))
        assert ids <= old
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality_rules.quality_report(before).where("_quality.kept").collect()}
        elif name == "near_dedup":
            found = simhash.near_duplicates(before).collect()
            assert ids == {r.component for r in found} and after.count() == len(ids)
        elif name == "decontaminate":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert old - ids == {r.doc_id for r in decontaminate.contamination_report(before, bench).where("_hits.contaminated").collect()}
        else:
            want = {r.id: r.copies for r in mixing.systematic_sample(before).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
        counts.append(len(ids))
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in before.select("doc_id").collect())
    assert counts[0] > counts[1] > 0
