import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from framelake.llm import conversation_repair as C

FORM = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        role, text, kind = told(role), told(text), zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(1 + (kind == 3)):
            yield conv, turn, "user" if kind == 4 else role, text


def faults(rows):
    """The first fault of each of a conversation's rows."""
    seen = set()
    for _, _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        yield "blank" if not end else "duplicate" if (role, text) in seen else "" if end[0] in ".!?" else "truncated"
        seen.add((role, text))


def edits_of(rows, found, gap=1):
    """Every way of editing: cost, audit, initials, repaired rows; up to ``gap`` insertions before each row and at the end."""
    inserts = [w for n in range(gap + 1) for w in product(("user", "assistant"), repeat=n)]
    choices = [[("K", row[2]), ("R", "user"), ("R", "assistant"), ("D", None)] if fault not in ("blank", "duplicate") else [("D", None)] for row, fault in zip(rows, found, strict=True)]
    for gaps in product(inserts, repeat=len(rows) + 1):
        for chosen in product(*choices):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                cost, audit, out = cost + 5 * len(gaps[k]), audit + "I" * len(gaps[k]), out + [f"{r}:" for r in gaps[k]]
                if k < len(rows):
                    edit, role = chosen[k]
                    cost += {"K": 0, "R": 1, "D": 2}[edit] + 5 * (edit != "D" and found[k] == "truncated")
                    audit += edit
                    out += [] if edit == "D" else [f"{role}:{rows[k][3]}"]
            yield cost, audit, out


def by_enumeration(rows, gap=1):
    found = list(faults(rows))
    return min((cost, audit, "\n".join(out)) for cost, audit, out in edits_of(rows, found, gap) if FORM.fullmatch("".join(x.split(":")[0][:1] for x in out)))


def by_relaxing(rows):
    """Least (cost, audit, text so far) for each number of rows taken and state, relaxed until nothing changes."""
    found, after = list(faults(rows)), {(p, c): q for p, c, q in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))}
    best, changed = {(0, 0): (0, "", ())}, True

    def offer(key, value):
        nonlocal changed
        if key not in best or value[:2] < best[key][:2]:
            best[key], changed = value, True

    while changed:
        changed = False
        for (i, p), (cost, audit, out) in list(best.items()):
            for role in ("user", "assistant"):
                if (p, role[0]) in after:
                    offer((i, after[p, role[0]]), (cost + 5, audit + "I", (*out, f"{role}:")))
            if i == len(rows):
                continue
            offer((i + 1, p), (cost + 2, audit + "D", out))
            if found[i] in ("blank", "duplicate"):
                continue
            more, role, text = 5 * (found[i] == "truncated"), rows[i][2], rows[i][3]
            if not role or (p, role[0]) in after:
                offer((i + 1, after[p, role[0]] if role else p), (cost + more, audit + "K", (*out, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if (p, new[0]) in after:
                    offer((i + 1, after[p, new[0]]), (cost + more + 1, audit + "R", (*out, f"{new}:{text}")))
    cost, audit, out = min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)
    return cost, audit, "\n".join(out)


def expected(conversations, ids=None):
    """conv_id to the row of the contract."""
    found = {}
    for conv in ids if ids is not None else {r[0] for r in conversations}:
        rows = [r for r in conversations if r[0] == conv]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        first, turns, initials = list(faults(rows)), {r[1] for r in rows} - {None}, [r[2][:1] for r in rows]
        cost, audit, text = by_relaxing(rows)
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, first.count("blank"), first.count("duplicate"), first.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return found


def some_rows(seed, n, most):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "useless"], ["Fine.", "cut off", "", " \t\n", "Well!", "So? \n", None, "Ä 💡."]
    return [(i, t, rng.choice(roles), rng.choice(texts)) for i in range(n) for t in sorted(rng.choice([None, *range(9)] * 2 + [0]) or 0 for _ in range(rng.randint(1, most)))]


def test_plain_ways_agree():
    for seed in range(60):
        rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in some_rows(seed, 1, 3)]
        assert by_relaxing(rows) == by_enumeration(rows), rows
    for symbols, gap in ((["assistant"], 2), (["system"], 2), (["assistant", "assistant"], 2)):
        rows = [(0, k, role, f"t{k}.") for k, role in enumerate(symbols)]
        assert by_relaxing(rows) == by_enumeration(rows, gap)


def test_every_split_gives_the_same_cells():
    rng = random.Random(3)
    for _ in range(40):
        symbols = "".join(rng.choice("suaeoSUAEOx") for _ in range(rng.randint(2, 12)))
        whole = C.span(symbols)
        assert all(C.combine(C.span(symbols[:k]), C.span(symbols[k:])) == whole for k in range(1, len(symbols)))
        cells = {(i, i + 1): C.row_span(c) for i, c in enumerate(symbols)}  # all spans, all splits, by length
        for n in range(2, len(symbols) + 1):
            for i in range(len(symbols) - n + 1):
                ways = [C.combine(cells[i, k], cells[k, i + n]) for k in range(i + 1, i + n)]
                cells[i, i + n] = [min((w[c] for w in ways if w[c]), default=None) for c in range(len(whole))]
        assert cells[0, len(symbols)] == whole


@pytest.mark.parametrize("block", [C.BLOCK, 3])
def test_report_and_texts_match_brute_force(spark, block):
    rows = some_rows(5, 60, 9) + [(None, t, r, f"{t % 3}.") for t, r in enumerate(["user", "assistant"] * 5)]
    rows += [(100, t, ["user", "assistant", "user"][t % 3], f"Row {t % 40}" + "." * (t % 5 > 0)) for t in range(300)] + [(101, 4, "user", "Again.")] * 40 + [(102, None, "user", None)] * 3
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5).withColumn("hash", F.lit(1)).withColumn("id", F.lit(2)).withColumn("times", F.lit(3))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    report = C.repair_report(table, block)
    got = {r.id: tuple(r)[1:] for r in C.repair_digests(table, report).collect()}
    assert got == expected(plain)
    out = C.repaired_rows(table, report).collect()
    for conv in got:
        text = "\n".join(f"{r.role}:{r.text}" for r in sorted((r for r in out if r.id == conv), key=lambda r: r.place))
        assert hashlib.sha256(text.encode()).hexdigest() == got[conv][-1]


def test_damage_and_all_conversations(spark):
    rows = some_rows(9, 200, 4) + [(None, None, None, None), (None, 3, "user", "Hm.")]
    rows += [(i, t, "user", "Gone.") for i in range(200, 4000) for t in [0] if zlib.crc32(f"{i}:{t}".encode()) % 20 == 0]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in C.all_conversations(table, C.repair_digests(C.damage(table))).collect()}
    assert got == expected(list(damaged(rows)), {r[0] for r in rows})
    assert got[next(r[0] for r in rows if r[3] == "Gone.")] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.all_conversations(table.limit(0), C.repair_digests(C.damage(table.limit(0)))).count() == 0


def test_long_conversations_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        symbols = "".join(random.Random(n).choice("suaeoSUAEOx") for _ in range(n))
        began = time.perf_counter()
        C.cheapest(C.span(symbols))
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1
