import base64
import gzip
import hashlib
import io
import json
import time
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import common, cotraining, html_extract, line_dedup, token_records, warc_zip, zip_archive
from framelake.llm.dom import parse

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_library(documents):
    whole, mine = Tokenizer.from_file(VOCABULARY), token_records.encoder(VOCABULARY)
    odd = ["ÀÉ ß ẞ İ Σας ΑΣ", "a<|endoftext|>b", "it's 've  12ab,c", "\x1ca\x85b\xa0c", "日本語 テスト", "", "ǅ ŉ ſ ŀl", "don’t…  --- ..,; été,.", "A\x00b"]
    for text in [r.text or "" for r in documents.collect()] + odd:
        assert np.frombuffer(mine(text), mine.width).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_records_round_trip_in_order(spark, documents):
    folder = common.shared_dir(spark)
    index = token_records.write_records(documents, folder, VOCABULARY)
    assert index.count() == documents.count()
    got = token_records.read_records(spark, folder).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and ids.count(10) == 3
    whole, start, texts = Tokenizer.from_file(VOCABULARY), 0, {}
    for r in documents.collect():
        texts.setdefault(r.doc_id, []).append(whole.encode(r.text or "", add_special_tokens=False).ids + [1])
    for r in got:
        found = np.frombuffer(r.ids, "<u4").tolist()
        texts[r.doc_id].remove(found)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(found), zlib.crc32(np.array(found, "<u4").tobytes()))
        start += r.n_tokens
    some = token_records.read_records(spark, folder, index.where("doc_id % 7 = 0").orderBy(F.rand(1)))
    assert {r.doc_id for r in some.collect()} == {i for i in ids if i is not None and i % 7 == 0}
    empty = common.shared_dir(spark)
    token_records.write_records(documents.where("false"), empty, VOCABULARY)
    assert token_records.read_records(spark, empty).collect() == []


def test_what_a_task_holds_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 100)
    texts = ["x" * 60, None, "y" * 60, "", "z" * 500, "w", "é" * 30]
    batch = pa.RecordBatch.from_pylist([{"id": i, "text": t} for i, t in enumerate(texts)])
    parts = list(common.pieces([batch.slice(0, 0), batch], 1))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert len(parts) > 2 and all(sum(len((t or "").encode()) for t in p.column(1).to_pylist()[1:]) <= 100 for p in parts)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("sc", (), {"getCheckpointDir": staticmethod(lambda: type("none", (), {"isEmpty": staticmethod(lambda: True)}))}))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_broken_frames_are_noticed():
    data = token_records.frame(b"payload")
    assert token_records.read_frame(io.BytesIO(data)) == b"payload" and token_records.read_frame(io.BytesIO(b"")) is None
    for at in range(len(data)):
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


def packed(files, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            with z.open(name, "w", **options) as f:
                f.write(data)
        z.comment = b"note PK\5\6 within"
    return out


@pytest.mark.parametrize("limit", [None, 3])
def test_directories_with_and_without_zip64(monkeypatch, limit):
    files = {"a": b"first", "b/é": b"second member", "c": b""}
    if limit:  # makes the writer use the wide forms for small files
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = packed(files, force_zip64=True)
    found = zip_archive.members(out, len(out.getvalue()))
    assert {m.name: zip_archive.read_range(out, zip_archive.stored_at(out, m), m.size) for m in found} == files
    with pytest.raises(ValueError):
        zip_archive.members(io.BytesIO(b"no archive"), 10)


PAGES = [(3, "http://a", "x"), (1, "http://é b", "x"), (2, None, None), (7, "u", ""), (None, "u", "x"), (9, "q", "zé"), (9, "q", "zé"), (None, None, "w"), (None, None, "w"), (10, "v", "long " * 20_000)]


def test_packages_are_closed_by_records_and_other_names_are_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc_zip, "PACKAGE_RECORDS", 3)
    monkeypatch.setattr(warc_zip, "SLICE", 2)
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(10)], "page_id bigint, url string, html string").coalesce(1)
    folder = common.shared_dir(spark)
    assert sorted(r.records for r in warc_zip.write_packages(pages, folder).collect()) == [1, 3, 3, 3]
    assert sorted(r.page_id for r in warc_zip.read_packages(spark, folder).collect()) == list(range(10))
    records = [gzip.compress(warc_zip.warc_record(i, "u", b"x" * i, None, False)) for i in range(4)]
    line = lambda name, at, data: json.dumps({"filename": name, "offset": at, "length": len(data)})
    files = {"archive/a.warc.gz": records[0] + records[1], "archive/b.warc.gz": records[2] + records[3], "indexes/one.jsonl": "\n".join([line("a.warc.gz", 0, records[0]), line("a.warc.gz", len(records[0]), records[1])]).encode(),
             "indexes/two.jsonl": "\n".join([line("b.warc.gz", 0, records[2]), line("b.warc.gz", len(records[2]), records[3])]).encode()}
    (tmp_path / "x.zip").write_bytes(packed(files).getvalue())
    got = warc_zip.read_packages(spark, f"file://{tmp_path}", spark.createDataFrame([("x.zip",)], "package string")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(i, b"x" * i) for i in range(4)]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", 300)
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, first int")
    folder = common.shared_dir(spark)
    assert warc_zip.write_packages(pages, folder).count() > 2
    got = warc_zip.read_packages(spark, folder).collect()
    smallest = {}
    for i, _, html in PAGES:
        if i is not None:
            smallest[html or ""] = min(i, smallest.get(html or "", i))
    want = []
    for i, _, html in PAGES:
        data, first = (html or "").encode(), smallest.get(html or "")
        revisit = first is not None and i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    empty = common.shared_dir(spark)
    warc_zip.write_packages(pages.where("false"), empty)
    assert warc_zip.read_packages(spark, empty).collect() == []


LAYOUT = "<html><head><title>t</title><style>p{}</style></head><body><div class=top>Site name</div><div><span>Menu one</span><span>Menu two</span></div><div class=body><p>%s</p><p>%s</p></div><div>All rights %s</div></body></html>"


def test_wrappers_tell_template_from_content(spark):
    pages = spark.createDataFrame([(i, f"http://host.org/{i}", LAYOUT % (f"story {i} one", f"story {i} two", "reserved")) for i in range(8)], "page_id bigint, url string, html string")
    got = {r.page_id: r.main_text for r in html_extract.main_text(pages).collect()}
    assert got == {i: f"story {i} one\nstory {i} two" for i in range(8)}


def test_copies_of_a_page_are_no_template(spark):
    """Copies vote once: they are no evidence against their own text, nor against that of other pages of the host."""
    story = lambda i: LAYOUT % (f"story {i} one", f"story {i} two", "reserved")
    quoted = story(100).replace("</p></div>", "</p><blockquote>a quote</blockquote></div>")
    rows = [("one.org", story(0), 3), ("many.org", story(0), 12), *(("many.org", story(i), 1) for i in (1, 2, 3)), ("quote.org", quoted, 3), *(("quote.org", story(i), 1) for i in range(8))]
    rows = [(k, f"http://{host}/{k}-{j}", html) for k, (host, html, n) in enumerate(rows) for j in range(n)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {}
    for r in html_extract.main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r.main_text)
    frame = "Site name\nMenu oneMenu two\n%s\nAll rights reserved"
    assert got[0] == [frame % "story 0 one\nstory 0 two"] * 3
    assert got[1] == ["story 0 one\nstory 0 two"] * 12
    assert [got[k] for k in (2, 3, 4)] == [[f"story {i} one\nstory {i} two"] for i in (1, 2, 3)]
    assert got[5] == ["story 100 one\nstory 100 two\na quote"] * 3


def test_named_regions_and_odd_markup(spark):
    rows = [
        (1, None, None), (2, "http://h/x", ""), (3, "http://h/y", '<div class="comments">c</div><p>a &amp; b&nbsp;c<p>d<li>e</li><form>q</form><p'),
        (4, "nohost", "<main><header><h1>T</h1></header><p>x<aside>no</aside>y</p><nav>n</nav></main><div id='side-bar'>s</div><footer>f</footer>"),
        (5, "http://h/z", "<article><p>if a &lt; b<br>then<script>var x='</p>'</script></article><p hidden>no</p><div role=banner>no</div>"), (6, "http://h/w", "<" * 2000 + "<p>" * 2000 + "deep"),
    ]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, _wrap string")
    got = {r.page_id: r.main_text for r in html_extract.main_text(pages).collect()}
    assert got[1] == got[2] == "" and got[3] == "a & b c\nd\ne" and got[4] == "T\nx\ny" and got[5] == "if a < b then" and got[6].endswith("deep")
    assert html_extract.main_text(pages.where("false")).collect() == []


def test_class_names_never_drop_what_holds_the_article(spark):
    rows = [
        (1, "http://h/a", "<div class='layout has-sidebar'><article><div class='article-header'><h1>T</h1></div><p>x</p></article><div class=sidebar>s</div></div>"),
        (2, "http://h/b", "<div id='page menu'><main><p>y</p></main><div class='menu'>m</div></div>"), (3, "http://h/c", "<p>z</p><div class='comments'><article class=comment><p>c</p></article></div>"),
    ]
    got = {r.page_id: r.main_text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "T\nx", 2: "y", 3: "z"}


ARTICLE = "<nav>n %s</nav><article><div class=head><h1>Same title</h1></div><p>lead %s</p><p class=notice>%s</p><div class='related-work'><p>%s</p></div><div class=subscribe-box><p>Get our letter</p></div><div class=comments>c %s</div></article>"


def test_the_wrapper_decides_within_an_article(spark):
    """Marked elements of an article are template where they hardly vary over distinct pages, content where they vary; plain ones are content."""
    rows = [(i, f"http://one.org/{i}", ARTICLE % (i, i, f"note {i}", f"work {i}", i)) for i in range(6)]
    rows += [(10 + i, f"http://two.org/{i}", ARTICLE % (i, i, "Read this", f"work {i}", i)) for i in range(6)]
    rows += [(20, "http://few.org/", ARTICLE % (1, 1, "Read this", "work 1", 1))]
    rows += [(30 + i, "http://near.org/", ARTICLE % (i, 1, "Read this", "work 1", 1)) for i in range(5)]  # one article, other menus
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.main_text.split("\n") for r in html_extract.main_text(pages).collect()}
    assert got[3] == ["Same title", "lead 3", "note 3", "work 3"] and got[13] == ["Same title", "lead 3", "work 3"]
    whole = ["Same title", "lead 1", "Read this", "work 1", "Get our letter"]
    assert got[20] == whole and all(got[30 + i] == whole for i in range(5))


def test_wide_and_deep_pages_are_matched_in_time():
    wide = [html_extract.skeleton(parse("<body>" + f"<{a}>x</{a}><{b}>y</{b}>" * 10_000)) for a, b in (("p", "h2"), ("h2", "p"))]
    began = time.time()
    html_extract.fold(*wide)
    assert len(html_extract.align(*wide)) == 4 and time.time() - began < 5
    deep = html_extract.skeleton(parse("<div>" * 5000 + "x"))
    html_extract.fold(deep, html_extract.skeleton(parse("<div>" * 4000 + "y")))
    assert len(html_extract.align(deep, deep)) == html_extract.MAX_DEPTH + 1
    many = html_extract.skeleton(parse("<body>"))
    for i in range(200):
        html_extract.fold(many, html_extract.skeleton(parse("".join(f"<div class={chr(97 + i % 26)}{chr(97 + k)}><p>x</p></div>" for k in range(i % 26 + 1)))))
    assert sum(1 for _ in many.walk()) <= html_extract.MAX_NODES


def test_a_page_that_is_all_template_keeps_its_text(spark):
    pages = spark.createDataFrame([(i, "http://host.org/", f"<div>Frame</div><p>{'own ' + str(i) if i else ''}</p>") for i in range(5)], "page_id bigint, url string, html string")
    got = {r.page_id: r.main_text for r in html_extract.main_text(pages).collect()}
    assert got == {0: "Frame"} | {i: f"own {i}" for i in range(1, 5)}


def test_a_host_of_many_layouts_is_folded_in_parts(spark):
    page = lambda i: f"<div>Site name</div>{''.join(f'<{t}>a {i} {k}</{t}>' for k, t in enumerate('p h2 p h3 pre dl'.split()) if i >> k & 1)}<p>own {i}</p>"
    pages = spark.createDataFrame([(i, "http://host.org/", page(i)) for i in range(64)], "page_id bigint, url string, html string")
    assert html_extract.induce_wrappers(pages).count() == 1
    got = {r.page_id: r.main_text for r in html_extract.main_text(pages).collect()}
    assert all(got[i].endswith(f"own {i}") and "Site name" not in got[i] and got[i].count("a ") == bin(i).count("1") for i in range(64))


BODY = "Some long body text of the page, with several words in it."
NAMED_PAGES = {
    "a form around the page": (f'<form id="aspnetForm"><article>{BODY}</article></form>', BODY),
    "a form with fields": (f'<form><input value="x"><article><h1>T</h1>{BODY}</article></form>', f"T\n{BODY}"),
    "a form with an article in an aside": (f"<form><aside><article>{BODY}</article></aside></form><p>own</p>", "own"),
    "a layout class": (f'<div class="layout has-sidebar"><div class="content">{BODY}</div><div class="sidebar">menu</div></div>', BODY),
    "a state class": (f'<div class="post comments-open"><p>{BODY}</p></div>', BODY),
    "a topic class": (f'<div class="topic social science"><p>{BODY}</p></div>', BODY),
    "a tag class": (f'<div class="story tags-news"><p>{BODY}</p></div><div>x</div>', f"{BODY}\nx"),
    "body text of an article": (f'<article><h1>T</h1><div class="tags search">{BODY}</div></article>', f"T\n{BODY}"),
    "comments within": (f'<article><h1>T</h1><p>{BODY}</p><div class="comment-list">{BODY * 4}</div></article>', f"T\n{BODY}"),
    "adverts within": (f'<article><h1>T</h1><p>{BODY}</p><p class="ad">buy</p><div class="ad-slot">x</div><div class="newsletter-signup">s</div><div class="related-work">R</div></article>', f"T\n{BODY}\nR"),
    "long comments beside": (f'<div><p>{BODY}</p><div id="comments">{BODY * 3}</div></div>', BODY),
    "nothing but a named region": (f'<div class="comments">{BODY}</div>', BODY),
}


@pytest.mark.parametrize("case", NAMED_PAGES)
def test_names_lose_no_page(case):
    page, want = NAMED_PAGES[case]
    assert html_extract.extract(parse(page)) == want


def test_the_wrapper_changes_the_answer(spark):
    """Pages that no tag or name tells apart: without the wrapper their template would be text."""
    page = lambda i: f"<div class='xa'><p>All rights are ours.</p></div><div class='xb'><p>Story {i} of its own.</p></div><div class='xc'><span>Site number one</span></div>"
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.org/{i}", page(i)) for i in range(12)], "page_id bigint, url string, html string")
    assert {r.page_id: r.main_text for r in html_extract.main_text(pages).collect()} == {i: f"Story {i} of its own." for i in range(12)}
    assert html_extract.extract(parse(page(1))) == "All rights are ours.\nStory 1 of its own.\nSite number one"


def test_tree_matching_keeps_order():
    a, b = (html_extract.skeleton(parse(x)) for x in ("<div><p>1</p><h2>x</h2><p>2</p></div>", "<div><h2>y</h2><p>3</p><ul></ul></div>"))
    score, pairs = html_extract.tree_match(a, b)
    assert score == 4 and [(x.label, y.label) for x, y in pairs] == [("#root", "#root"), ("div", "div"), ("h2", "h2"), ("p", "p")]
    html_extract.fold(a, b)
    assert [k.label for k in a.kids[0].kids] == ["p", "h2", "p", "ul"]


def test_boilerplate_lines_match_brute_force(spark):
    rows = [(i, f"http://H{i % 2}.org/p", f"<nav>menu<br>top {i % 3}</nav><p>story {i}</p><script>x</script><p>story {i}</p>") for i in range(40)] + [(90, None, "<p>menu"), (91, "http://h0.org", None), (92, "http://single.org", "menu")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, lines int")
    got = {r.id: (r.n_lines, r.n_dropped, r.lines) for r in line_dedup.drop_boilerplate(pages, ratio=0.5, min_pages=3).collect()}
    for i in range(40):
        assert got[i] == (4, 1, [f"top {i % 3}", f"story {i}", f"story {i}"])
    assert got[90] == (1, 0, ["menu"]) and got[91] == (0, 0, []) and got[92] == (1, 0, ["menu"])
    copies = pages.union(pages.where("page_id = 0")).union(pages.where("page_id = 0"))  # rows of one page are no evidence
    rows = line_dedup.drop_boilerplate(copies, ratio=0.5, min_pages=3).where("id = 0").collect()
    assert [(r.n_lines, r.n_dropped) for r in rows] == [(4, 1)] * 3
    odd = spark.createDataFrame([(i, "http://o.org", f"<p>same</p><p>own {i}</p><script>leak {i}") for i in range(4)], "page_id bigint, url string, html string")
    assert sorted(r.lines for r in line_dedup.drop_boilerplate(odd, ratio=0.5, min_pages=3).collect()) == [[f"own {i}"] for i in range(4)]
    assert line_dedup.drop_boilerplate(pages.where("false")).collect() == []


def test_cotraining_reaches_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = cotraining.fit(docs, labels.where("doc_id % 4 != 0"))
    held = labels.where("doc_id % 4 = 0")
    got = cotraining.score(docs, model).join(held, F.col("id") == F.col("doc_id")).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() >= 0.9
    assert cotraining.score(docs, model).count() == docs.count()


def test_pseudo_labels_are_the_surest_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(5)
    weights = [rng.normal(0, 3, n + 1).astype(np.float32) for n in (cotraining._TEXT, cotraining._META)]
    most = (5, 9)
    inputs = cotraining._inputs(docs, "doc_id", "text")
    got = cotraining._best(inputs.repartition(5).mapInArrow(cotraining._candidates(weights, [(1.0, 0.0), (1.0, 0.0)], most), "view int, label int, margin double, id bigint"), most)
    want = []
    for view in (0, 1):
        margins = []
        for r in docs.collect():
            x = cotraining.content_view(r.text) if view == 0 else cotraining.metadata_view(r.lang, r.source, r.n_chars)
            margins.append((round(float(cotraining.logits(x[None], weights[view])[0]), 3), r.doc_id))
        floor = np.log(cotraining.SURE / (1 - cotraining.SURE))
        want += [(view, 0, i) for m, i in sorted(margins)[:5] if m <= -floor] + [(view, 1, i) for m, i in sorted((-m, i) for m, i in margins)[:9] if -m >= floor]
    assert got == sorted(want) and got


def test_exchange_does_not_harm(spark):
    """The registered setting against no exchange, on a quarter of the labels that neither has seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 4 = 0").collect()}
    found = []
    for rounds in (0, cotraining.ROUNDS):
        model = cotraining.fit(docs, labels.where("doc_id % 4 != 0"), rounds=rounds)
        rows = [r for r in cotraining.score(docs.where("doc_id % 4 = 0"), model).collect() if r.id in held]
        right = sum((r.score >= 0.5) == (held[r.id] == 1) for r in rows)
        found.append((right, sum(r.kept for r in rows if held[r.id] == 0)))
    (plain, plain_kept), (right, kept) = found
    assert right >= plain and kept <= plain_kept and right > 0.98 * len(held)


def test_a_lesson_is_taken_only_if_the_combined_loss_falls():
    rng = np.random.default_rng(5)
    y = np.r_[np.ones(30), np.zeros(30)]
    views = [np.c_[y + rng.normal(0, 0.4, 60), rng.normal(0, 1, 60)].astype(np.float32) for _ in (0, 1)]
    fits = [cotraining.calibrated(v, cotraining.fit_view(list(v), y, []), y) for v in views]
    want = np.mean([np.logaddexp(0, -o if one else o) for one, o in zip(y, fits[0][1] + fits[1][1], strict=True)])
    assert abs(cotraining.loss_of([odds for _, odds in fits], y) - want) < 1e-9
    wrong = [(x, 1.0 - one) for x, one in zip(views[0], y, strict=True)] * 20  # a teacher that is always wrong
    taught = cotraining.calibrated(views[0], cotraining.fit_view(list(views[0]), y, wrong), y)
    assert cotraining.loss_of([taught[1], fits[1][1]], y) > cotraining.loss_of([odds for _, odds in fits], y)


def test_line_ratio_decides_from_small_hosts_on(spark):
    """On a host of 20 pages the least number decides, on one of 2,000 the share."""
    html = lambda *xs: "".join(f"<p>{x}</p>" for x in xs)
    rows = [(i, "http://small.example/", html(f"own {i}", *["menu"] * (i < 3), *["pair"] * (i < 2))) for i in range(20)]
    rows += [(1000 + i, "http://large.example/", html(f"own {i}", *["banner"] * (i < 201), *["often"] * (i < 200), *["thrice"] * (i < 3))) for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.id: r.lines for r in line_dedup.drop_boilerplate(pages).collect()}
    assert got[0] == ["own 0", "pair"] and got[19] == ["own 19"] and got[1000] == ["own 0", "often", "thrice"] and got[1150] == ["own 150", "often"]


def test_cotraining_is_the_same_for_any_partitioning_and_takes_repeated_ids(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(10, 0), (9999, 1), (200, 1), (201, 0)], "doc_id bigint, quality int")
    runs = [cotraining.fit(d, labels, rounds=1, added=10) for d in (documents, documents.repartition(7))]
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip((runs[0].text, runs[0].meta), (runs[1].text, runs[1].meta), strict=True))
    rows = cotraining.score(documents, runs[0]).collect()
    assert len(rows) == documents.count() and len({r.score for r in rows if r.id == 10}) <= 3 and all(0 <= r.score <= 1 for r in rows)
    none = documents.where("false")
    assert cotraining.score(none, cotraining.fit(none, labels)).collect() == []


def test_nothing_to_learn_from(spark, documents):
    none = spark.createDataFrame([(1, None), (2, 5), (None, 1)], "doc_id bigint, quality int")
    got = cotraining.score(documents, cotraining.fit(documents, none)).collect()
    assert len(got) == documents.count() and {r.score for r in got} == {0.5}
