import hashlib
import os

import duckdb
import pytest

from framelake.plans import derived
from framelake.plans import queries as media_queries


def plain(x):
    return None if x is None or x != x else int(x) if isinstance(x, float) and x == int(x) else x


@pytest.fixture(scope="session")
def tables(sf_dir):
    found = duckdb.connect()
    for f in os.listdir(sf_dir):
        found.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return found


@pytest.mark.parametrize("name", sorted(media_queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    got = media_queries.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = tables.sql(media_queries.oracle_sql()[name])
    assert columns == sorted(want.columns)
    key = lambda row: tuple(map(str, row))
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    theirs = sorted((tuple(plain(x) for x in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    assert mine == theirs


def test_every_sql_has_a_query_and_the_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_records_are_sorted_over_all_orders(spark, sf_dir, tables):
    files, want = {}, set()
    for customer, order in tables.sql("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderkey").fetchall():
        files.setdefault(customer, []).append(order)
    for customer, found in files.items():
        want |= {(f"cust/{customer}", k, order) for k, order in enumerate(found if customer % 2 else found[:8])}
    got = [(r.path, r.frame_index, r.offset) for r in media_queries.queries()["record_sort"](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want and any(x[2] % 11 == 0 for x in got)


def test_all_frames_become_rgba(spark, sf_dir, tables):
    want, colour = {}, [f"{v * 21 % 256:02X}{(v * 21 + 7) % 256:02X}{(v * 21 + 14) % 256:02X}FF" for v in range(256)]
    for doc, text in tables.sql("SELECT doc_id, text FROM documents").fetchall():
        data = (text or "").encode()
        for k in range(max(-(-len(data) // 256), 1)):
            pixels = data[k * 256 : k * 256 + 256].ljust(256, b"\0")
            want[f"doc/{doc}", k] = hashlib.md5("".join(colour[v] for v in pixels).encode()).hexdigest()
    rows = media_queries.queries()["flc_to_rgba"](spark, sf_dir).collect()
    assert len(rows) == len(want) and {(r.path, r.frame_index): r.rgba_md5 for r in rows} == want


def test_readers_reach_every_byte(spark, sf_dir, tables):
    def folded(data, width, order):
        acc = 0
        for at in range(0, (-(-len(data) // width) + 1) * width, width):
            part = data[at : at + width]
            acc = (acc * 31 + (int.from_bytes(part, order) if len(part) == width else 0)) % 2147483647
        return acc

    readers = [(1, "little"), (2, "little"), (2, "big"), (4, "little"), (4, "big")]
    texts = [(doc, (text or "").encode()) for doc, text in tables.sql("SELECT doc_id, text FROM documents").fetchall()]
    want = sorted((doc, len(data), *[folded(data, *r) for r in readers]) for doc, data in texts)
    assert sorted(tuple(r) for r in media_queries.queries()["byte_readers"](spark, sf_dir).collect()) == want


@pytest.mark.parametrize("name", ["flc_frames", "flc_index", "dpan_frames"])
def test_documents_beyond_a_format_make_several_files(spark, sf_dir, tables, monkeypatch, name):
    monkeypatch.setattr(derived, "FLC_FRAMES", 6)
    monkeypatch.setattr(derived, "DPAN_FRAMES", 5)
    test_query_equals_its_sql(spark, sf_dir, tables, name)


def test_cdxl_files_hold_the_last_bytes(spark):
    docs = spark.createDataFrame([(1, "x" * 255 + "!")], "doc_id bigint, text string")
    content = derived.cdxl_files(docs).collect()[0].content
    assert len(content) == 6 * 84 and content[5 * 84 + 36 : 6 * 84] == b"x" * 15 + b"!" + bytes(32)
