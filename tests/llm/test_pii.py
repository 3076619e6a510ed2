import hashlib
import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from framelake.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in found.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return sorted((m.start(), n, m.end()) for n, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if valid(kind, m.group()))


def run(spark, texts, **more):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return {r.doc_id: [tuple(s) for s in r._pii] for r in pii.find_personal_data(table, **more).select("doc_id", "_pii").collect()}


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["4111111111111111", "4111 1111-1111 1111", "1", "23", ".", "..", " ", "-", "+", "+1 (555) 010-9999", "a@b.co", "a@b", "@", "x_y%z@q-r.s.t", "10.0.0.1", "256.1.1.1", "001.2.3.4", "1.2.3.4.5.6.7.8", "Ä", "💡", "é.a@b.c_d@e.f", "  ", "(", ")", "word", "\n", "5555555555554444", "0000000000000"]
    texts = [None, "", *("".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 25))) for _ in range(1500))]
    got = run(spark, texts)
    for i, text in enumerate(texts):
        assert [s[:3] for s in got[i] if s[3]] == base(text or ""), text


def test_long_texts_take_linear_time(spark):
    texts = ["@." + "x" * 1_000_000, "@" + "1" * 1_000_000, "a@" * 300_000, "1." * 300_000, "+1" + " " * 1_000_000, "+1 " * 300_000, "1 " * 300_000, ("x" * 70 + "@ ") * 5000, "a1b2c3@" + "._" * 300_000]
    began = time.time()
    got = run(spark, texts)
    assert [len(got[i]) for i in range(len(texts))] == [0, 0, 0, 75_000, 0, 0, 0, 0, 0] and time.time() - began < 60


def test_contexts_discover_further_identifiers(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("river stone garden light paper".split()) for _ in range(n))
    phone = lambda: f"+1 ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"{words(9)} call me at {phone()} today {words(4)}" for _ in range(8)]
    texts += [f"{words(5)} dial my number {phone()} soon" for _ in range(3)]  # too few of their own
    texts += [f"{words(5)} call me at 0151-22334455 today", f"{words(3)} dial my number 0151-22334455 soon", f"{words(4)} dial my number 0160-9988776 soon"]
    texts += [f"{words(8)} page 1048{k} of {words(3)}" for k in range(20)] + [f"write to {words(1)}@localhost now {words(2)}"]
    texts += [texts[0]] * 30 + [f"{words(2)} in room {phone()}. and", f"{words(2)} in room 778899"] * 9  # copies count once: half of the room's instances
    got = run(spark, texts)
    new = {(texts[i][s[0] : s[2]], pii.KINDS[s[1]]) for i in got for s in got[i] if not s[3]}
    assert new == {("0151-22334455", "phone"), ("0160-9988776", "phone")}  # the second by a pattern that the first one supports
    assert all([s[:3] for s in got[i] if s[3]] == base(texts[i]) for i in got)
    assert {texts[i][s[0] : s[2]] for i, spans in run(spark, texts, rounds=1).items() for s in spans if not s[3]} == {"0151-22334455"}


def plain_scores(edges, rounds, support, sure):
    seeds, patterns, keys = defaultdict(lambda: [0, 0, 0, 0]), defaultdict(set), defaultdict(set)
    for pattern, key, *flags in edges:
        patterns[pattern].add(key)
        keys[key].add(pattern)
        seeds[key] = [max(a, b) for a, b in zip(seeds[key], flags, strict=True)]
    conf = {k: list(map(float, seeds[k])) for k in keys}
    for _ in range(rounds):
        score = {p: [sum(conf[k][n] for k in ks) / len(ks) if sum(conf[k][n] >= sure for k in ks) >= support else 0.0 for n in range(4)] for p, ks in patterns.items()}
        for key, ps in keys.items():
            for n in range(4):
                doubt = 1.0
                for p in ps:
                    doubt *= 1 - min(score[p][n], 0.99)
                conf[key][n] = max(float(seeds[key][n]), 1 - doubt)
    return conf


def test_scores_match_plain_python(spark):
    rng = random.Random(8)
    edges = {(p, rng.randint(1, 60)): None for _ in range(400) for p in [rng.randint(1, 30)]}
    kind = {k: rng.choice([0, 1, 2, 3, None, None]) for k in range(1, 61)}
    edges = [(p, k, *(int(kind[k] == n) for n in range(4))) for p, k in edges]
    table = spark.createDataFrame(edges, "pattern bigint, key bigint, " + ", ".join(f"seed_{k} int" for k in pii.KINDS))
    want = plain_scores(edges, 3, 2, 0.4)
    got = {r.key: [r[k] for k in pii.KINDS] for r in pii.score_graph(table, 3, 2, 0.4).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_query_is_native_and_whole(spark, documents, tmp_path):
    documents.withColumn("_row", F.lit(1)).withColumn("_found", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_pii(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
    rows = found.collect()
    assert len(rows) == documents.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and not r.spans for r in rows if r.doc_id in (400, 401, 402))
    whole = pii.find_personal_data(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert whole.columns == [*documents.columns, "_row", "_found", "_pii"] and whole.count() == len(rows)
    assert pii.find_personal_data(documents.limit(0)).count() == 0
