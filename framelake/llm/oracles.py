"""DuckDB SQL for those corpus queries that SQL can express, written from their contracts.

Not here: token ids (3), the classifier (4), fingerprints and their closure (9), scored contexts (12).
"""

from __future__ import annotations

from framelake.llm import mixing, quality_rules

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The pages of the test tables hold their text in one article element.
HTML_EXTRACT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|\z)', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '</?(?:p|h[1-6]|div|ul|ol|li|section|blockquote)(?:\s[^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d"""

SUBSTRING_DEDUP = f"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM l),
v AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS run FROM w),
h AS (SELECT doc_id, p, md5(array_to_string(run, ' ')) AS h FROM v WHERE len(run) = 35),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, p + k AS p FROM r, range(35) t(k)),
k AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN k ON k.doc_id = l.doc_id"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(d, {5 * g + 1}, 5))::BIGINT >> {s}) % 32 + 1 AS INTEGER), 1)" for g in range(8) for s in (15, 10, 5, 0))

WARC_ZIP = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), s AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS d, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM s"""

#: Its own patterns and values; those of the operator are not used.
LINE_DEDUP = r"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '') AS host,
  regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?(</(script|style)\s*>|\z)', ' ', 'g'), '(?s)<!--.*?(-->|\z)', ' ', 'g') AS t FROM pages),
q AS (SELECT page_id, host, regexp_replace(regexp_replace(t, '(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM p),
l AS (SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines FROM q),
e AS (SELECT page_id, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l),
u AS (SELECT DISTINCT host, lines FROM l WHERE host IS NOT NULL),
h AS (SELECT host, count(*) AS pages FROM u GROUP BY host),
b AS (SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM u) x JOIN h USING (host) GROUP BY host, line, pages HAVING count(*) >= 3 AND count(*) > 0.1 * pages),
k AS (SELECT page_id, string_agg(e.line, chr(10) ORDER BY i) AS kept, count(*) AS n FROM e LEFT JOIN b ON b.host = e.host AND b.line = e.line WHERE b.line IS NULL GROUP BY page_id)
SELECT l.page_id, l.host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN k ON k.page_id = l.page_id"""

DECONTAMINATE = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
ip AS (SELECT item, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item, m, array_to_string(ws[s:s + m - 1], ' ') AS run FROM ip),
l AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM l),
v AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM w),
x AS (SELECT doc_id, p, m, item FROM v, (SELECT DISTINCT m FROM pat) q JOIN pat USING (m) WHERE len(v.run) >= q.m AND array_to_string(v.run[1:q.m], ' ') = pat.run),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + k AS p FROM x, range(10) t(k) WHERE k < m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM x) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM l LEFT JOIN hit ON hit.doc_id = l.doc_id LEFT JOIN it ON it.doc_id = l.doc_id"""

#: Sources in order of cap over weight: those before the first that its share does not fill are capped.
MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST({mixing.MAX_REPEATS} * size AS DOUBLE) AS cap FROM s),
o AS (SELECT *, row_number() OVER q AS k, CAST(sum(size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w WINDOW q AS (ORDER BY cap / w, i)),
f AS (SELECT arg_min(rest, k) AS rest, arg_min(open, k) AS open, min(k) AS k FROM o WHERE rest * w / open <= cap),
t AS (SELECT o.source, o.size AS source_size, CASE WHEN o.k < f.k THEN cap ELSE f.rest * w / f.open END AS target FROM o, f),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY d.size, doc_id) - 1 AS n,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.source, '')), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE AS u FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(u + rate * (n + 1)) - floor(u + rate * n), {mixing.MAX_REPEATS}) AS BIGINT) * size AS taken FROM r"""


#: CRC-32 by a table of 256 steps, which the query works out itself.
CRC32 = """
RECURSIVE step AS (SELECT i AS b, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8)"""


def crc32(text: str) -> str:
    """The CRC-32 of a text's bytes, where ``crc`` of ``CRC32`` is joined in as one row."""
    octets = f"list_transform(range(CAST(strlen({text}) AS BIGINT)), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])), 4294967295)"


RESAMPLING = rf"""
WITH {CRC32},
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
w AS (SELECT doc_id, unnest(ws) AS word FROM d),
v AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, count(*) AS s, 0 AS t FROM w GROUP BY word UNION ALL SELECT word, 0, count(*) FROM b GROUP BY word) GROUP BY word),
h AS (SELECT word, v.s, v.t, {crc32("word")} % 10000 AS bucket FROM v, crc),
k AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM h GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM v) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM v) + 10000)))) AS BIGINT) AS gain FROM k),
f AS (SELECT doc_id, sum(gain) AS weight FROM w JOIN h ON h.word = w.word JOIN g ON g.bucket = h.bucket GROUP BY doc_id),
x AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN f ON f.doc_id = d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS docs FROM x WHERE n_features >= 20)
SELECT x.*, CASE WHEN r.n <= r.docs * 10 // 100 THEN CAST(r.n AS BIGINT) END AS rank FROM x LEFT JOIN r ON r.doc_id = x.doc_id"""


def _repair() -> str:
    """The least edits row by row, by states: a plain path beside the operator's spans."""

    def plus(cell: str, cost: str, initial: str, line: str | None = None) -> str:
        return f"{{'c': {cell}.c + {cost}, 'a': {cell}.a || '{initial}', 't': {f'list_append({cell}.t, {line})' if line else f'{cell}.t'}}}"

    user, assistant, never = "'user:'", "'assistant:'", "{'c': 1000000, 'a': '', 't': []::VARCHAR[]}"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    put = lambda x, role: plus(x, "5", "I", role)
    closed = f"x0 AS c0, x1 AS c1, {least('x2', put('x0', user), put('x1', user), put('x3', user))} AS c2, {least('x3', put('x2', assistant), put(put('x0', user), assistant), put(put('x1', user), assistant))} AS c3"
    drop = lambda x: plus(x, "2", "D")
    keep = lambda x, initial: f"CASE WHEN NOT gone AND init = '{initial}' THEN {plus(x, 'more', 'K', 'line')} ELSE {never} END"
    turn = lambda x, role: f"CASE WHEN NOT gone THEN {plus(x, '(1 + more)', 'R', f'{role} || body')} ELSE {never} END"
    user_from = [w for x in ("c0", "c1", "c3") for w in (keep(x, "u"), turn(x, user))]
    steps = [least(drop("c0"), keep("c0", "")), least(drop("c1"), keep("c0", "s"), keep("c1", "")), least(drop("c2"), keep("c2", ""), *user_from), least(drop("c3"), keep("c3", ""), keep("c2", "a"), turn("c2", assistant))]
    return rf"""
WITH {CRC32},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
m AS (SELECT name, {crc32("name")} % 20 AS kind FROM (SELECT DISTINCT name FROM o), crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM o JOIN m ON m.name = o.name, range(2) r(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
e AS (SELECT *, role[1:1] AS init, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER w AS i, lag(role[1:1]) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM e),
f AS (SELECT conv_id, turn, i, init, before, role || ':' || text AS line, text AS body, body = '' OR again AS gone, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM r),
n AS (SELECT *, CASE WHEN truncated THEN 5 ELSE 0 END AS more FROM f),
g AS (SELECT conv_id, max(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(i > 1 AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY conv_id),
walk AS (SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS x0, {never} AS x1, {never} AS x2, {never} AS x3 FROM g
  UNION ALL SELECT q.conv_id, CAST(n.i AS INTEGER), {", ".join(steps)} FROM (SELECT conv_id, i, {closed} FROM walk) q JOIN n ON n.conv_id IS NOT DISTINCT FROM q.conv_id AND n.i = q.i + 1),
last AS (SELECT conv_id, {least("c0", "c3")} AS best FROM (SELECT conv_id, {closed} FROM walk JOIN g USING (conv_id) WHERE walk.i = g.rows))
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id = a.conv_id LEFT JOIN last ON last.conv_id = a.conv_id"""


def _quality() -> str:
    q = quality_rules
    count = lambda rule: f"length(rest) - length(regexp_replace(rest, '{rule}', '', 'g'))"
    classes = [*(count(rule) for rule in q.CHAR_CLASSES.values())]
    lists = " UNION ALL ".join(f"SELECT '{lang}' AS ref, unnest({words!r}) AS word" for lang, words in q.COMMON_WORDS.items())
    langs = ", ".join(f"'{x}'" for x in q.COMMON_WORDS)
    js = lambda p, r: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {r}) / 2)) ELSE 0 END + CASE WHEN {r} > 0 THEN {r} * log2({r} / (({p} + {r}) / 2)) ELSE 0 END"
    kinds = range(len(q.KINDS))
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
l AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws, regexp_replace(t, '[a-z\x20\x09-\x0D]+', '', 'g') AS rest, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM l),
tri AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM w),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(run, ' ')) AS n FROM tri WHERE len(run) = 3) WHERE n > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + k AS p FROM rep, range(3) t(k)) GROUP BY doc_id),
b AS (SELECT l.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST({count(r"[#*$%&|<>]+")} AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS whole, [{", ".join(classes)}] AS k, length(rest) AS rest FROM l LEFT JOIN cov ON cov.doc_id = l.doc_id),
c AS (SELECT doc_id, lang, n_words, whole, k || [rest - list_sum(k), whole - word_chars, word_chars - rest] AS c FROM b),
cr AS (SELECT lang AS ref, sum(n_words) AS n, sum(whole) AS whole, {", ".join(f"sum(c[{i + 1}]) AS s{i}" for i in kinds)} FROM c WHERE lang IN ({langs}) GROUP BY lang HAVING sum(n_words) >= {q.MIN_REFERENCE_WORDS}),
dc AS (SELECT doc_id, min(sqrt(greatest(({" + ".join("(" + js(f"(c[{i + 1}] / greatest(c.whole, 1))", f"(s{i} / cr.whole)") + ")" for i in kinds)}) / 2, 0))) AS dist FROM c, cr GROUP BY doc_id),
ref AS ({lists}),
wc AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, lower(word) AS word FROM w WHERE word IN (SELECT word FROM ref UNION SELECT upper(word[1]) || word[2:] FROM ref)) GROUP BY doc_id, word),
qn AS (SELECT ref.ref, ref.word, coalesce(sum(wc.n), 0) / any_value(cr.n) AS q FROM ref JOIN cr ON cr.ref = ref.ref LEFT JOIN (SELECT wc.*, lang FROM wc JOIN d ON d.doc_id = wc.doc_id) wc ON wc.word = ref.word AND wc.lang = ref.ref GROUP BY ref.ref, ref.word),
pr AS (SELECT c.doc_id, qn.ref, qn.q, coalesce(wc.n, 0) / greatest(c.n_words, 1) AS p FROM c CROSS JOIN qn LEFT JOIN wc ON wc.doc_id = c.doc_id AND wc.word = qn.word),
ps AS (SELECT doc_id, ref, sum({js("p", "q")}) AS part, greatest(1 - sum(p), 0) AS p, greatest(1 - sum(q), 0) AS q FROM pr GROUP BY doc_id, ref),
dw AS (SELECT doc_id, min(sqrt(greatest((part + {js("p", "q")}) / 2, 0))) AS dist FROM ps GROUP BY doc_id),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, lang IS NULL OR lang IN ({langs}) AS known FROM b)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(known AND n_words >= {q.MIN_WORDS} AND dc.dist > {q.MAX_CHAR_DISTANCE}, false) AND NOT coalesce(known AND n_words >= {q.MIN_COMMON_WORDS} AND dw.dist > {q.MAX_WORD_DISTANCE}, false) AS kept
FROM f LEFT JOIN dc ON dc.doc_id = f.doc_id LEFT JOIN dw ON dw.doc_id = f.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_html_extract": HTML_EXTRACT, "op2_substring_dedup": SUBSTRING_DEDUP, "op5_warc_zip": WARC_ZIP, "op6_line_dedup": LINE_DEDUP, "op7_decontaminate": DECONTAMINATE, "op8_mixing": MIXING,
        "op10_quality_rules": _quality(), "op11_conversation_repair": _repair(), "op13_resampling": RESAMPLING,
    }
