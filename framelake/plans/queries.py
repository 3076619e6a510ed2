"""The registered media queries: each binds an operator to a table, or to containers that Spark derives from one.

The SQL that DuckDB runs for a query stands beside it, written from the table and not from the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import binary, colour, timing
from framelake.operators import anim_delta, audio, chunks, folds, frame_index, frames, iff, probe, seek, seq, smk, timeline, write_ops
from framelake.plans import derived
from framelake.sources import media

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

PERIOD, FRAMES = 33_000, 900


def query(sql: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: a user is a session, and media time runs from the user's first event, an hour a millisecond."""
    events = _table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min("ts").alias("t0"))
    return events.join(first, "user_id").select("user_id", "event_id", "ts", "event_type", F.expr("timestampdiff(MICROSECOND, t0, ts) div 3600").alias("media_time_us"))


_TICKS = "SELECT user_id, event_id, ts, event_type, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)) AS raw_us, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 3600 AS media_time_us FROM events"


@query(f"""
WITH t AS ({_TICKS}), f AS (SELECT *, media_time_us // {PERIOD} AS frame_index FROM t),
g AS (SELECT *, lag(frame_index) OVER w AS before FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, media_time_us, frame_index, frame_index < {FRAMES} AND frame_index IS DISTINCT FROM before AS rendered,
       frame_index >= {FRAMES} AND coalesce(before < {FRAMES}, true) AS eos FROM g""")
def timeline_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.present_asof(ticks(spark, sf_dir), ["user_id"], ["ts", "event_id"], "media_time_us", F.lit(PERIOD), F.lit(FRAMES))
    return rows.select("user_id", "event_id", "media_time_us", "frame_index", "rendered", "eos")


@query(f"""
WITH t AS ({_TICKS}), f AS (SELECT *, (media_time_us % ({PERIOD} * {FRAMES})) // {PERIOD} AS frame_index FROM t)
SELECT user_id, event_id, frame_index, frame_index IS DISTINCT FROM lag(frame_index) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rendered FROM f""")
def timeline_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.present_asof(ticks(spark, sf_dir), ["user_id"], ["ts", "event_id"], "media_time_us", F.lit(PERIOD), F.lit(FRAMES), loop=True)
    return rows.select("user_id", "event_id", "frame_index", "rendered")


@query(f"""
WITH t AS ({_TICKS}), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM t),
g AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE media_time_us // {PERIOD} END AS frame_index FROM f)
SELECT user_id, event_id, frame_index, frame_index < {FRAMES} AND frame_index IS DISTINCT FROM lag(frame_index) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rendered FROM g""")
def timeline_fresh_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.player_parity(ticks(spark, sf_dir), ["user_id"], ["ts", "event_id"], "media_time_us", F.lit(PERIOD), F.lit(FRAMES))
    return rows.select("user_id", "event_id", "frame_index", "rendered")


@query(f"""
WITH t AS ({_TICKS}), d AS (SELECT *, media_time_us - coalesce(lag(media_time_us) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS dt FROM t)
SELECT user_id, event_id, CAST(sum(CASE WHEN event_type <> 'error' AND dt >= 0 THEN dt ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS clock_us FROM d""")
def clock_realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    deltas = ticks(spark, sf_dir).withColumn("dt", F.col("media_time_us") - F.coalesce(F.lag("media_time_us").over(w), F.lit(0)))
    rows = timeline.realtime_clock(deltas, ["user_id"], ["event_id"], "dt", F.col("event_type") == "error")
    return rows.select("user_id", "event_id", F.col("media_time_us").alias("clock_us"))


@query("""
SELECT l_orderkey, l_linenumber, CAST((l_partkey * 1000003) % 4000000 - 500000 AS BIGINT) AS pts,
  least(greatest(CAST((l_partkey * 1000003) % 4000000 - 500000 AS BIGINT), 0) // 33000, 60) AS frame_index,
  l_suppkey % 70 <= 60 AS can_seek FROM lineitem""")
def seek_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts, count = ((F.col("l_partkey") * 1000003) % 4000000 - 500000).cast("bigint"), F.lit(60)
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", pts.alias("pts"), timing.frame_at(pts, F.lit(PERIOD), count).alias("frame_index"), timing.can_seek(F.col("l_suppkey") % 70, count).alias("can_seek"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 200 AS v, l_suppkey % 60 AS d, l_partkey % 401 - 200 AS inc FROM lineitem)
SELECT l_orderkey, l_linenumber, v * 1000000 // 70 AS fli, v * 1000 AS flc, CASE WHEN inc > 0 THEN inc * 1000 WHEN inc < 0 THEN -inc * 10 ELSE 100000 END AS smk,
  v * 10000 // 60 AS seq, CASE WHEN d = 0 THEN 1 ELSE d END * 1000000 // 60 AS anim, CAST(83333 AS BIGINT) AS cdxl,
  CAST(floor(1000000 / CASE WHEN v = 0 THEN 12.0::DOUBLE ELSE 50.0::DOUBLE / v END) AS BIGINT) AS yafa,
  1000000 // CASE WHEN d = 0 THEN 18 ELSE d END AS dpan, CASE WHEN d = 0 THEN NULL ELSE (v + 1) * 1000000 // d END AS bink FROM s""")
def frame_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, d, inc = F.col("l_partkey") % 200, F.col("l_suppkey") % 60, F.col("l_partkey") % 401 - 200
    periods = {"fli": timing.fli_period(v), "flc": timing.flc_period(v), "smk": timing.smk_period(inc), "seq": timing.seq_period(v), "anim": timing.anim_period(d), "cdxl": timing.cdxl_period(),
               "yafa": timing.yafa_period(v), "dpan": timing.dpan_period(d), "bink": timing.bink_period(d, v + 1)}
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[p.alias(n) for n, p in periods.items()])


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 64 AS INTEGER) AS v, CAST(l_suppkey % 8 AS INTEGER) AS s, CAST(l_partkey % 4096 AS INTEGER) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, v * 4 + v // 16 AS six, s * 32 + s * 4 + s // 2 AS three, (w // 256) * 17 AS r, (w // 16 % 16) * 17 AS g, (w % 16) * 17 AS b,
  (w + 15) // 16 * 2 AS pitch FROM c""")
def colour_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s, w = ((F.col(c) % n).cast("int") for c, n in (("l_partkey", 64), ("l_suppkey", 8), ("l_partkey", 4096)))
    rgb = colour.rgb12(w)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", colour.scale_6_to_8(v).alias("six"), colour.scale_3_to_8(s).alias("three"), *[rgb[c].alias(c) for c in "rgb"], colour.bitplane_pitch(w).alias("pitch"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS INTEGER) AS y, CAST(l_suppkey % 256 AS INTEGER) AS u, CAST((l_partkey * 7) % 256 AS INTEGER) AS v FROM lineitem),
k AS (SELECT *, (298 * (y - 16) + 409 * (v - 128) + 128) >> 8 AS r0, (298 * (y - 16) - 100 * (u - 128) - 208 * (v - 128) + 128) >> 8 AS g0, (298 * (y - 16) + 516 * (u - 128) + 128) >> 8 AS b0 FROM c)
SELECT l_orderkey, l_linenumber, least(greatest(r0, 0), 255) AS r, least(greatest(g0, 0), 255) AS g, least(greatest(b0, 0), 255) AS b FROM k""")
def yuv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = colour.yuv_to_rgb(*((F.col(c) * k % 256).cast("int") for c, k in (("l_partkey", 1), ("l_suppkey", 1), ("l_partkey", 7))))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[rgb[c].alias(c) for c in "rgb"])


@query("""
WITH p AS (SELECT CAST(i AS INTEGER) AS i, CAST((i * 7) % 256 AS INTEGER) AS r, CAST((i * 11) % 256 AS INTEGER) AS g, CAST((i * 13) % 256 AS INTEGER) AS b FROM range(32) t(i)),
q AS (SELECT * FROM p UNION ALL SELECT i + 32, r // 2, g // 2, b // 2 FROM p)
SELECT p_partkey, i AS idx, r, g, b FROM part JOIN q ON i = p_size % 64""")
def palette_half_bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A palette of 32 entries and their half-brights, looked up by index: 64 rows, so the join is broadcast."""
    entry = lambda i: F.struct(*[((i * k) % 256).cast("int").alias(c) for c, k in (("r", 7), ("g", 11), ("b", 13))])
    palette = colour.half_bright(F.transform(F.sequence(F.lit(0), F.lit(31)), entry))
    entries = spark.range(1).select(F.posexplode(palette).alias("idx", "c"))
    parts = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 64).alias("idx"))
    return parts.join(F.broadcast(entries), "idx").select("p_partkey", "idx", "c.r", "c.g", "c.b")


# How files of the formats begin; 9 is a later format that is not read.
_MAGIC = {0: "4142434412AF", 1: "4142434411AF", 2: "534D4B32", 3: "534D4B34", 4: "FEDB", 5: "464F524D00000000414E494D", 6: "464F524D0000000059414641",
          7: "4C504620000000000000000000000000414E494D40010001", 8: "42494B69", 9: "4B423269", 10: ""}
_CODEC = {0: "flc", 1: "flc", 2: "smk", 3: "smk", 4: "atari_seq", 5: "amiga_anim", 6: "yafa", 7: "dpan", 8: "bink"}


@query("SELECT doc_id, CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CODEC.items()) + " END AS codec, CAST(strlen(text) + CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN {len(v) // 2}" for k, v in _MAGIC.items()) + " END AS BIGINT) AS n_bytes FROM documents")
def sniff_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind magic numbers of the formats, or none, told apart by content."""
    magic = F.create_map(*[x for k, v in _MAGIC.items() for x in (F.lit(k), F.lit(v))])
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.unhex(F.element_at(magic, (F.col("doc_id") % 11).cast("int"))), F.encode("text", "utf-8")).alias("content"))
    n = F.length("content").cast("bigint")
    return rows.select("doc_id", media.codec_of(F.col("content"), n).alias("codec"), n.alias("n_bytes"))


def _read_sql() -> str:
    """Each reader's values over a text and what lies past its end, folded; a text is split into words of the reader's width."""
    word = {"u8": "x", "u16le": "substr(x, 3, 2) || substr(x, 1, 2)", "u16be": "x", "u32le": "substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)", "u32be": "x"}
    fold = lambda name, w: f"list_reduce(list_transform(regexp_extract_all(h, '.{{{2 * w}}}'), lambda x: ('0x' || {word[name]})::BIGINT) || list_transform(range(CAST(ceil(n / {w}.0) AS BIGINT) - n // {w} + 1), lambda z: 0::BIGINT), lambda a, v: (a * 31 + v) % 2147483647, 0::BIGINT) AS {name}"
    return f"WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id, n AS n_bytes, {', '.join(fold(k, w) for k, w in (('u8', 1), ('u16le', 2), ('u16be', 2), ('u32le', 4), ('u32be', 4)))} FROM d"


@query(_read_sql())
def byte_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader over the whole text, from end to end in steps of its own width and once past the end: the values read, as a polynomial of 31 modulo 2 ** 31 - 1."""
    readers = {"u8": (1, True), "u16le": (2, True), "u16be": (2, False), "u32le": (4, True), "u32be": (4, False)}
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    return rows.select("doc_id", F.length("data").cast("bigint").alias("n_bytes"), *[binary.words_folded(F.col("data"), *r).alias(name) for name, r in readers.items()])


_OPS = "SELECT event_id, ts, user_id AS file, event_id % 16 AS place, CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 256 END AS v, event_id % 7 = 0 AS clear, (event_id * 37) % 65536 AS word, event_id % 3 > 0 AS swaps FROM events"


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as write operations: a user is a file of 16 places, in order of time."""
    e, u, i = _table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id")
    return e.select("event_id", "ts", u.alias("file"), (i % 16).alias("place"), F.when(F.coalesce(F.col("event_type") == "error", F.lit(False)), None).otherwise(u % 256).alias("v"),
        (i % 7 == 0).alias("clear"), ((i * 37) % 65536).alias("word"), (i % 3 > 0).alias("swaps"))


@query(f"WITH o AS ({_OPS}) SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY file, place ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pixel FROM o")
def fold_copy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.carry(_ops(spark, sf_dir), ["file", "place"], ["ts", "event_id"], "v").select("event_id", "pixel")


@query(f"""WITH o AS ({_OPS}), s AS (SELECT *, sum(CAST(clear AS INTEGER)) OVER (PARTITION BY file, place ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM o)
SELECT event_id, bit_xor(word) OVER (PARTITION BY file, place, segment ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS folded FROM s""")
def fold_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.xor_fold(_ops(spark, sf_dir), ["file", "place"], ["ts", "event_id"], "word", "clear").select("event_id", "folded")


@query(f"WITH o AS ({_OPS}) SELECT event_id, CAST(coalesce(sum(CAST(swaps AS INTEGER)) OVER (PARTITION BY file ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS BIGINT) AS buffer FROM o")
def fold_double_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.double_buffer(_ops(spark, sf_dir), ["file"], ["ts", "event_id"], "swaps").select("event_id", "buffer")


@query(f"WITH o AS ({_OPS}) SELECT event_id, CAST((sum(word - 32768) OVER (PARTITION BY file ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 65536 + 65536) % 65536 AS BIGINT) AS sample FROM o")
def fold_dpcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ops(spark, sf_dir).withColumn("delta", F.col("word") - 32768)
    return folds.running_sum(rows, ["file"], ["ts", "event_id"], "delta", 16).select("event_id", "sample")


@query(f"""WITH o AS ({_OPS}), h AS (SELECT event_id, file, word % 4 AS op, word // 4 % 16 AS n FROM o), k AS (SELECT *, n * 17 AS x FROM h)
SELECT event_id, coalesce(last_value(CASE op WHEN 0 THEN n * 3 WHEN 2 THEN x END IGNORE NULLS) OVER w, 0) AS r,
  coalesce(last_value(CASE op WHEN 0 THEN n * 5 WHEN 3 THEN x END IGNORE NULLS) OVER w, 0) AS g, coalesce(last_value(CASE op WHEN 0 THEN n * 7 WHEN 1 THEN x END IGNORE NULLS) OVER w, 0) AS b
FROM k WINDOW w AS (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def fold_ham(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.call_function("div", F.col("word"), F.lit(4)) % 16
    rows = _ops(spark, sf_dir).select("event_id", "file", (F.col("word") % 4).alias("op"), n.alias("n"))
    held = {"r": F.col("n") * 3, "g": F.col("n") * 5, "b": F.col("n") * 7}
    return folds.ham(rows, ["file"], "event_id", "op", F.col("n") * 17, held, {"r": 0, "g": 0, "b": 0}).select("event_id", "r", "g", "b")


@query("SELECT l_orderkey, CAST(bit_or(CAST(l_partkey % 2 AS BIGINT) << CAST(l_linenumber AS INTEGER)) AS BIGINT) AS value FROM lineitem GROUP BY l_orderkey")
def planes_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 2).alias("bit"))
    return folds.planes_to_pixels(bits, ["l_orderkey"], "l_linenumber", "bit")


def _sorted_records(orders: DataFrame) -> DataFrame:
    """Orders as records of a customer's file, numbered in order but for a gap at 8 in every other file, out of order in the table."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = orders.withColumn("n", n).withColumn("frame", F.col("n") + F.when((F.col("n") >= 8) & (F.col("o_custkey") % 2 == 0), 1).otherwise(0))
    records = rows.select(F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")).alias("path"), "frame", F.col("o_orderkey").alias("offset"), F.lit(0).alias("size"))
    return frame_index.dense_records(records).select("path", "frame_index", "offset")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame FROM orders)
SELECT 'cust/' || o_custkey AS path, CAST(CASE WHEN frame >= 8 AND o_custkey % 2 = 0 THEN frame + 1 ELSE frame END AS INTEGER) AS frame_index, o_orderkey AS "offset" FROM r WHERE o_custkey % 2 = 1 OR frame < 8""")
def record_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_records(_table(spark, sf_dir, "orders"))


def _padded_sql() -> str:
    """Documents as bytes padded to n whole frames."""
    return f"SELECT doc_id, 'doc/' || doc_id AS path, greatest(CAST(ceil(strlen(text) / {float(derived.SIZE)}) AS BIGINT), 1) AS n, rpad(hex(encode(text)), CAST(greatest(CAST(ceil(strlen(text) / {float(derived.SIZE)}) AS BIGINT), 1) * {2 * derived.SIZE} AS INTEGER), '0') AS x FROM documents"


def _flc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.flc_files(_table(spark, sf_dir, "documents"))


def _one_start(rows: DataFrame, *flags: str) -> DataFrame:
    """``flags`` unset where a document's further files begin, which is no start of the document."""
    begins = F.col("frame_index") % derived.FLC_FRAMES == 0
    return rows.withColumns({f: F.col(f) & ((F.col("frame_index") == 0) | ~begins) for f in flags})


def _with_codec(files: DataFrame) -> DataFrame:
    return files.withColumn("codec", media.codec_of(F.col("content"), F.length("content").cast("bigint")))


_EVERY = "WITH d AS ({padded}), f AS (SELECT path, n, x, unnest(range(n)) AS k FROM d)"


@query(f"""WITH d AS ({_padded_sql()})
SELECT path, 'flc' AS codec, 32 AS width, 8 AS height, CAST(n AS INTEGER) AS frame_count, 'indexed8' AS format, n * 33000 AS duration_us, CAST(33000 AS BIGINT) AS frame_period_us,
  0 AS audio_track_count, 0 AS audio_rate, 0 AS audio_channels, 0 AS audio_bits, CAST(NULL AS VARCHAR) AS error FROM d""")
def flc_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.containers(_flc(spark, sf_dir))


@query(f"""{_EVERY.format(padded=_padded_sql())}, p AS (SELECT path, CAST(k AS INTEGER) AS frame_index, substr(x, CAST(k * 512 + 1 AS INTEGER), 512) AS h FROM f)
SELECT path, frame_index, md5(h) AS pixels_md5, frame_index = 0 AS keyframe, frame_index = 0 AS palette_changed,
  ('0x' || substr(h, 1, 2))::BIGINT + ('0x' || substr(h, 257, 2))::BIGINT + ('0x' || substr(h, 511, 2))::BIGINT AS checksum FROM p""")
def flc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as FLC files (raw, run and changed-byte frames in turn) and decoded again."""
    rows = _one_start(derived.joined(frames.decode_frames(_with_codec(_flc(spark, sf_dir)), palette=False), derived.FLC_FRAMES), "keyframe", "palette_changed")
    return rows.select("path", "frame_index", F.md5(F.hex("pixels")).alias("pixels_md5"), "keyframe", "palette_changed", timeline.frame_checksum(F.col("pixels")).alias("checksum"))


@query(f"""WITH d AS ({_padded_sql()}), c AS (
SELECT path, 'COLOR_256' AS type_name, 1 AS n_chunks, 772 AS n_bytes FROM d UNION ALL SELECT path, 'COPY', (n + 2) // 3, (n + 2) // 3 * 256 FROM d
UNION ALL SELECT path, 'BRUN', (n + 1) // 3, (n + 1) // 3 * 272 FROM d UNION ALL SELECT path, 'LC', n // 3, n // 3 * 284 FROM d)
SELECT path, type_name, CAST(n_chunks AS BIGINT) AS n_chunks, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN n_bytes >= 1048576 THEN n_bytes // 1048576 || ' MiB' WHEN n_bytes >= 1024 THEN n_bytes // 1024 || ' KiB' ELSE n_bytes || ' B' END AS shown,
  CAST(row_number() OVER (PARTITION BY path ORDER BY n_bytes DESC, n_chunks DESC, type_name) AS INTEGER) AS rank FROM c WHERE n_chunks > 0""")
def flc_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = chunks.top_chunks(chunks.chunk_census(chunks.flc_chunks(_flc(spark, sf_dir))))
    return top.select("path", "type_name", "n_chunks", "n_bytes", timing.byte_size(F.col("n_bytes")).alias("shown"), "rank")


@query(f"{_EVERY.format(padded=_padded_sql())} SELECT path, CAST(k AS INTEGER) AS frame_index, k * 33000 AS pts_us, CAST(33000 AS BIGINT) AS duration_us, k = 0 AS keyframe_flag FROM f")
def flc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _flc(spark, sf_dir)
    rows = frame_index.with_times(frame_index.flc_index(files), media.containers(files))
    rows = _one_start(derived.joined(rows, derived.FLC_FRAMES, pts_us=derived.FLC_FRAMES * PERIOD), "keyframe_flag")
    return rows.select("path", "frame_index", "pts_us", "duration_us", "keyframe_flag")


@query(f"""{_EVERY.format(padded=_padded_sql())}, p AS (SELECT path, CAST(k AS INTEGER) AS frame_index, list_transform(regexp_extract_all(substr(x, CAST(k * 512 + 1 AS INTEGER), 512), '..'), lambda y: ('0x' || y)::BIGINT) AS vs FROM f)
SELECT path, frame_index, md5(array_to_string(list_transform(vs, lambda v: printf('%02X%02X%02XFF', v * 21 % 256, (v * 21 + 7) % 256, (v * 21 + 14) % 256)), '')) AS rgba_md5 FROM p""")
def flc_to_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of each file through its palette, with alpha."""
    return _rgba(frames.decode_frames(_with_codec(_flc(spark, sf_dir))))


def _rgba(rows: DataFrame) -> DataFrame:
    """Decoded frames through their palette, with alpha, in expressions."""
    rows = derived.joined(rows, derived.FLC_FRAMES)
    rgba = colour.convert_pixels(F.col("pixels"), F.col("palette"), F.col("format"), "rgba8888")
    return rows.select("path", "frame_index", F.md5(F.hex(rgba)).alias("rgba_md5"))


@query(f"""WITH d AS ({_padded_sql()}), f AS (SELECT path, x, unnest(range((n * 256 + 47) // 48)) AS k FROM d)
SELECT path, CAST(k AS INTEGER) AS frame_index, CAST(192 AS BIGINT) AS rate, 1 AS channels, md5(rpad(substr(x, CAST(k * 96 + 65 AS INTEGER), 32), 32, '0')) AS pcm_md5 FROM f""")
def cdxl_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdxl_audio(derived.cdxl_files(_table(spark, sf_dir, "documents")))


def _cdxl_audio(files: DataFrame) -> DataFrame:
    rows = audio.cdxl_audio(files)
    return rows.select("path", "frame_index", "rate", "channels", F.md5(F.hex("pcm")).alias("pcm_md5"))


@query(f"""WITH d AS ({_padded_sql()}), f AS (SELECT path, x, unnest(range((n * 256 + 47) // 48)) AS k FROM d),
b AS (SELECT path, k, unnest(range(32)) AS i, rpad(substr(x, CAST(k * 96 + 1 AS INTEGER), 64), 64, '0') AS h FROM f), v AS (SELECT path, k, i, ('0x' || substr(h, CAST(i * 2 + 1 AS INTEGER), 2))::BIGINT AS byte FROM b)
SELECT path, CAST(k AS INTEGER) AS frame_index, CAST(sum(bit_count(byte)) AS BIGINT) AS set_pixels, CAST(sum(byte * (i + 1)) AS BIGINT) AS weighted FROM v GROUP BY path, k""")
def cdxl_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdxl_frames(derived.cdxl_files(_table(spark, sf_dir, "documents")))


def _cdxl_frames(files: DataFrame) -> DataFrame:
    """One-plane pictures: the pixels that are set, and the packed bytes again, weighted by place."""
    rows = frames.decode_frames(_with_codec(files), palette=False)
    rows = rows.select("path", "frame_index", F.hex(colour.pixels_to_bits(F.col("pixels"))).alias("bits"), F.length(F.replace(F.hex("pixels"), F.lit("0"), F.lit(""))).cast("bigint").alias("ones"))
    # summed as columns and not by a lambda, which Spark would interpret
    weighted = sum((F.conv(F.substring("bits", i * 2 + 1, 2), 16, 10).cast("bigint") * (i + 1) for i in range(32)), F.lit(0).cast("bigint"))
    return rows.select("path", "frame_index", F.col("ones").alias("set_pixels"), weighted.alias("weighted"))


@query(f"""{_EVERY.format(padded=_padded_sql())} SELECT path, CAST(k AS INTEGER) AS frame_index, md5(substr(x, CAST(k * 512 + 1 AS INTEGER), 512)) AS pixels_md5, CAST(NULL AS VARCHAR) AS error FROM f""")
def dpan_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.joined(frames.decode_frames(_with_codec(derived.dpan_files(_table(spark, sf_dir, "documents"))), palette=False), derived.DPAN_FRAMES)
    return rows.select("path", "frame_index", F.md5(F.hex("pixels")).alias("pixels_md5"), "error")


@query(f"""{_EVERY.format(padded=_padded_sql())}, p AS (SELECT path, k, n, k // 200 AS page, k % 200 AS r FROM f)
SELECT path, CAST(k AS INTEGER) AS frame_index, 2816 + page * 65536 + 8 + least(200, n - page * 200) * 2 + r * 263 AS "offset", CAST(263 AS BIGINT) AS size FROM p""")
def dpan_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets run on through the files of a very long document, as if their pages followed each other."""
    rows = frame_index.dpan_index(derived.dpan_files(_table(spark, sf_dir, "documents")))
    return derived.joined(rows, derived.DPAN_FRAMES, offset=256 * 65536).select("path", "frame_index", "offset", "size")


_LINES = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey % 64 + 4 AS size FROM lineitem"


@query(f"""WITH l AS ({_LINES}), s AS (SELECT *, size // 4 * 4 AS bytes FROM l)
SELECT 'order/' || l_orderkey AS path, CAST(k AS INTEGER) AS frame_index, CAST(104 + 5 * n + coalesce(sum(bytes) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(bytes AS BIGINT) AS size, k = 0 OR size % 2 = 1 AS keyframe_flag FROM s""")
def smk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.index_files(_table(spark, sf_dir, "lineitem"), "smk")
    return frame_index.smk_index(files).select("path", "frame_index", "offset", "size", "keyframe_flag")


@query(f"""WITH l AS ({_LINES}), s AS (SELECT *, size // 2 * 2 AS bytes FROM l)
SELECT 'order/' || l_orderkey AS path, CAST(k AS INTEGER) AS frame_index, CAST(44 + 4 * (n + 1) + coalesce(sum(bytes) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(bytes AS BIGINT) AS size, k = 0 AS keyframe_flag, CAST(1001 * 1000000 // 30000 * k AS BIGINT) AS pts_us FROM s""")
def bink_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.index_files(_table(spark, sf_dir, "lineitem"), "bink")
    rows = frame_index.timed(frame_index.bink_index(media.containers(files, keep=("path", "content")), ("frame_period_us",)))
    return rows.select("path", "frame_index", "offset", "size", "keyframe_flag", "pts_us")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey * 100 // (1 + l_suppkey % 2) * 1000000 // 22050 AS duration_us, (l_partkey * 1000 * 22050 // 1000000) * (1 + l_suppkey % 2) AS at_byte,
  l_partkey * 100 * 1000000 // (22050 * (1 + l_suppkey % 2) * 2) AS clock_us, (l_partkey % 256 - 128) / 128.0::DOUBLE AS sample FROM lineitem""")
def pcm_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rate, channels = F.col("l_partkey") * 100, F.lit(22050), 1 + F.col("l_suppkey") % 2
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", timing.pcm_duration(n, rate, channels).alias("duration_us"), timing.pcm_offset(F.col("l_partkey") * 1000, rate, channels).alias("at_byte"),
        timing.audio_clock(n, rate, channels, F.lit(16)).alias("clock_us"), timing.pcm_float(F.col("l_partkey") % 256 - 128).alias("sample"))


@query("""
SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_partkey % 30 AS BIGINT) AS slot, p.p_name AS sound, least(l.l_quantity / 32.0::DOUBLE, 1.0) AS volume
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey % 30 WHERE l.l_partkey % 30 > 0""")
def sound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sound controls, parts as the bank of sounds of one file."""
    lines, parts = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    one = F.lit("clip").alias("path")
    controls = lines.select(one, F.col("l_orderkey").alias("frame_index"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 30).alias("sound"), (F.col("l_quantity") * 2).alias("volume"), F.lit(1).alias("repeats"))
    bank = parts.select(one, F.col("p_partkey").alias("slot"), F.col("p_name").alias("sound_bytes"))
    rows = audio.sound_events(controls, bank)
    return rows.select(F.col("frame_index").alias("l_orderkey"), F.col("seq").alias("l_linenumber"), "slot", F.col("sound_bytes").alias("sound"), "volume")


@query("""
WITH r AS (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS voice FROM events) SELECT event_id, user_id, voice FROM r WHERE voice <= 16""")
def event_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 16 sounds at once: a limit of the operator itself."""
    return audio.cap_events(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "voice")


@query(f"""WITH f AS (SELECT 'flc' AS codec, 'doc/' || doc_id AS path, greatest(CAST(ceil(strlen(text) / 256.0) AS BIGINT), 1) AS n FROM documents
UNION ALL SELECT 'cdxl', 'doc/' || doc_id, (greatest(CAST(ceil(strlen(text) / 256.0) AS BIGINT), 1) * 256 + 47) // 48 FROM documents
UNION ALL SELECT 'smk', 'order/' || l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey)
SELECT codec, CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS frames, CAST(sum(greatest(n, 1) * CASE codec WHEN 'smk' THEN 19200 ELSE 256 END) AS BIGINT) AS pixels FROM f GROUP BY codec""")
def files_by_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lines = (_table(spark, sf_dir, n) for n in ("documents", "lineitem"))
    files = derived.flc_files(docs).union(derived.cdxl_files(docs)).union(derived.index_files(lines, "smk"))
    found = media.containers(files)
    pixels = F.greatest(F.col("frame_count"), F.lit(1)).cast("bigint") * F.col("width") * F.col("height")
    return found.groupBy("codec").agg(F.count("*").alias("files"), F.sum("frame_count").alias("frames"), F.sum(pixels).alias("pixels"))


def _anim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.anim_files(_table(spark, sf_dir, "documents"))


#: In an ANIM file: what stands before the first frame, the first frame, a later one, and what lies before their pictures.
_BANK_BYTES, _FIRST, _LATER, _HEAD_FIRST, _HEAD_LATER = 12 + 84, 406, 356, 126, 76


@query(f"""{_EVERY.format(padded=_padded_sql())} SELECT path, CAST(k AS INTEGER) AS frame_index, CAST(CASE WHEN k = 0 THEN {_BANK_BYTES + _HEAD_FIRST} ELSE {_BANK_BYTES + _FIRST + _HEAD_LATER} + (k - 1) * {_LATER} END AS BIGINT) AS "offset",
  CAST(256 AS BIGINT) AS size, k = 0 AS keyframe_flag, CAST(16 AS BIGINT) AS sound_bytes, CASE WHEN n > 1 THEN 33333 ELSE 16666 END * k AS pts_us, CAST(CASE WHEN n > 1 THEN 33333 ELSE 16666 END AS BIGINT) AS duration_us FROM f""")
def anim_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iff.anim_index(_anim(spark, sf_dir))


@query("""SELECT 'doc/' || doc_id AS path, CAST(32 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, CAST(8 AS BIGINT) AS planes, '000000FF8040' AS cmap, CAST(2048 AS BIGINT) AS camg,
  CAST(8 AS BIGINT) AS audio_bits, CAST(8000 AS BIGINT) AS audio_rate, CAST(2 AS BIGINT) AS audio_channels FROM documents""")
def anim_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iff.anim_headers(_anim(spark, sf_dir)).withColumn("cmap", F.hex("cmap"))


@query(f"""{_EVERY.format(padded=_padded_sql())}, s AS (SELECT path, k, substr(x, CAST(k * 512 + 1 AS INTEGER), 32) AS h FROM f)
SELECT path, CAST(k AS INTEGER) AS frame_index, CAST(8000 AS BIGINT) AS rate, CAST(2 AS BIGINT) AS channels, array_to_string(list_transform(range(8), lambda i: substr(h, CAST(i * 2 + 1 AS INTEGER), 2) || substr(h, CAST(i * 2 + 17 AS INTEGER), 2)), '') AS pcm FROM s""")
def anim_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iff.anim_pcm(_anim(spark, sf_dir)).withColumn("pcm", F.hex("pcm"))


@query(f"""{_EVERY.format(padded=_padded_sql())}
SELECT path, CAST(k AS INTEGER) AS frame_index, CAST(k % 5 AS BIGINT) AS slot, '464F524D0000001438535658424F445900000008' || repeat('0' || (k % 5), 8) AS sound, least((32 + k % 64) / 64.0::DOUBLE, 1.0) AS volume, CAST(1 AS BIGINT) AS repeats FROM f WHERE k % 5 BETWEEN 1 AND 3""")
def anim_sound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's sound controls against its own bank; those that name no sound of it are dropped."""
    files = _anim(spark, sf_dir)
    rows = audio.sound_events(iff.anim_controls(files), iff.sound_bank(files))
    return rows.select("path", "frame_index", "slot", F.hex("sound_bytes").alias("sound"), "volume", "repeats")


@query(f"""{_EVERY.format(padded=_padded_sql())} SELECT path, CAST(k AS INTEGER) AS frame_index, 42 + CASE WHEN n % 2 = 0 THEN 8 + 4 * n ELSE 0 END + k * 256 AS "offset", CAST(256 AS BIGINT) AS size, k * 40000 AS pts_us, CAST(40000 AS BIGINT) AS duration_us FROM f""")
def yafa_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = iff.yafa_index(derived.yafa_files(_table(spark, sf_dir, "documents")))
    return derived.joined(rows, derived.FLC_FRAMES).select("path", "frame_index", "offset", "size", "pts_us", "duration_us")


@query("""
WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), b AS (SELECT l_orderkey, unnest(range(l_orderkey % 3)) AS t FROM o)
SELECT 'order/' || l_orderkey AS path, 'smk' AS codec, 0 AS track, CAST(22050 AS BIGINT) AS rate, 2 AS channels, 16 AS bits, true AS packed, CAST(NULL AS BIGINT) AS track_id, CAST(NULL AS BIGINT) AS max_bytes FROM o WHERE l_orderkey % 2 = 1
UNION ALL SELECT 'order/' || l_orderkey, 'bink', CAST(t AS INTEGER), 11025 * (t + 1), CASE WHEN t = 0 THEN 2 ELSE 1 END, CASE WHEN t = 0 THEN 16 ELSE 8 END, true, t + 7, t + 1000 FROM b""")
def audio_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound tracks of Smacker and Bink files; every order has a file of either kind."""
    lines = _table(spark, sf_dir, "lineitem")
    return media.audio_tracks(derived.index_files(lines, "smk", "bink", tracks=True))


@query("""
WITH d AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: reverse(lpad(bin(('0x' || b)::BIGINT), 8, '0'))), '') AS bits FROM documents),
c AS (SELECT doc_id, length(bits) AS n, list_transform(regexp_extract_all(bits, '.{1,11}'), lambda s: list_sum(list_transform(range(length(s)), lambda i: CASE WHEN substr(s, CAST(i + 1 AS INTEGER), 1) = '1' THEN 1::BIGINT << CAST(i AS INTEGER) ELSE 0 END))::BIGINT) AS codes FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bits, list_reduce(codes, lambda a, v: (a * 31 + v) % 2147483647, 0::BIGINT) AS folded FROM c""")
def bit_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 11 bits over the whole text, the last one filled with zeros, as a polynomial of 31 modulo 2 ** 31 - 1."""

    rows = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    return rows.select("doc_id", (F.length("data") * 8).cast("bigint").alias("n_bits"), binary.codes_folded(F.col("data"), 11).alias("folded"))


@query(f"""
WITH o AS ({_OPS}), p AS (SELECT event_id, ts, file, word, event_id % 4 AS plane FROM o),
s AS (SELECT event_id, {", ".join(f"bit_xor(CASE WHEN plane = {k} THEN word ELSE 0 END) OVER w AS p{k}" for k in range(4))} FROM p WINDOW w AS (PARTITION BY file ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, array_to_string(list_transform(range(16), lambda x: {" + ".join(f"((p{k} >> CAST(15 - x AS INTEGER)) & 1) * {1 << k}" for k in range(4))}), ',') AS pixels FROM s""")
def seq_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as XOR words on a screen of four planes, and the screen's 16 pixels after each."""
    rows = _ops(spark, sf_dir).withColumn("plane", F.col("event_id") % 4)
    rows = folds.xor_planes(rows, ["file"], ["ts", "event_id"], "word", "plane", 4)
    pixels = folds.words_to_chunky([F.col(f"plane{k}") for k in range(4)])
    return rows.select("event_id", F.array_join(F.transform(pixels, lambda x: x.cast("string")), ",").alias("pixels"))


@query(f"""
WITH t AS ({_TICKS}), d AS (SELECT user_id, event_id, ts, event_type, media_time_us, coalesce(media_time_us - lag(media_time_us) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS dt FROM t),
c AS (SELECT *, CASE event_type WHEN 'error' THEN 'pause' WHEN 'signup' THEN 'resume' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'rewind' ELSE 'seek' END END AS control FROM d),
p AS (SELECT *, coalesce(last_value(CASE control WHEN 'pause' THEN true WHEN 'resume' THEN false END IGNORE NULLS) OVER w, false) AS paused, count(CASE WHEN control IN ('rewind', 'seek') THEN 1 END) OVER w AS part FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, paused, CAST(coalesce(first_value(CASE control WHEN 'rewind' THEN 0 WHEN 'seek' THEN event_id * 1000 END) OVER v, 0) + sum(CASE WHEN control IS NULL AND NOT paused AND dt >= 0 THEN dt ELSE 0 END) OVER v AS BIGINT) AS clock_us
FROM p WINDOW v AS (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def transport_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors pause, signups go on, purchases seek or rewind; the other events are ticks."""
    e, w = F.col("event_type"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = ticks(spark, sf_dir).withColumn("dt", F.coalesce(F.col("media_time_us") - F.lag("media_time_us").over(w), F.lit(0)))
    control = F.when(e == "error", "pause").when(e == "signup", "resume").when(e == "purchase", F.when(F.col("event_id") % 3 == 0, "rewind").otherwise("seek"))
    rows = rows.drop("media_time_us").withColumns({"control": control, "to": F.col("event_id") * 1000})
    rows = timeline.transport_clock(rows, ["user_id"], ["ts", "event_id"], "dt", "control", "to")
    return rows.select("user_id", "event_id", "paused", F.col("media_time_us").alias("clock_us"))


@query(f"""WITH c AS (SELECT doc_id, CASE doc_id % 11 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _CODEC.items())} END AS codec FROM documents), n AS (SELECT doc_id, 'open/' || codec || '/' || doc_id AS name FROM c WHERE codec IS NOT NULL)
SELECT doc_id, name FROM n WHERE regexp_matches(name, '^open/(smk|bink)/.*[02468]$')""")
def files_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files picked by a pattern of their names, which is what the operator is for."""
    rows = sniff_codecs(spark, sf_dir).where("codec IS NOT NULL").withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    return media.named(rows, "^open/(smk|bink)/.*[02468]$", "open").select("doc_id", "name")


@query(f"""{_EVERY.format(padded=_padded_sql())}, p AS (SELECT path, CAST(k AS INTEGER) AS frame_index, CASE WHEN k % 3 = 2 AND k % 5 = 4 THEN repeat('00', 256) ELSE substr(x, CAST(k * 512 + 1 AS INTEGER), 512) END AS h FROM f)
SELECT path, frame_index, md5(h) AS pixels_md5, md5(array_to_string(list_transform(range(768), lambda i: printf('%02X', (i * 7 % 64) * 4 + (i * 7 % 64) // 16)), '')) AS palette_md5 FROM p""")
def flc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLC files with changed words, black frames and a palette of six bits a colour."""
    rows = frames.decode_frames(_with_codec(derived.flc_files(_table(spark, sf_dir, "documents"), words=True)))
    return derived.joined(rows, derived.FLC_FRAMES).select("path", "frame_index", F.md5(F.hex("pixels")).alias("pixels_md5"), F.md5(F.hex("palette")).alias("palette_md5"))


@query(f"""{_EVERY.format(padded=_padded_sql())} SELECT path, CAST(k AS INTEGER) AS frame_index, CASE WHEN k = 0 THEN 1 ELSE 0 END AS seq, md5(substr(x, CAST(k * 512 + 1 AS INTEGER), 512)) AS payload_md5 FROM f WHERE k % 3 = 0""")
def flc_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads of the raw pictures, behind the palette in a first frame."""
    rows = derived.joined(chunks.payloads(_flc(spark, sf_dir), ("COPY",)), derived.FLC_FRAMES)
    return rows.select("path", "frame_index", "seq", F.md5(F.hex("payload")).alias("payload_md5"))


@query(f"""{_EVERY.format(padded=_padded_sql())} SELECT path, CAST(k AS INTEGER) AS frame_index, 128 + 4 * n + k * 384 AS "offset", CAST(384 AS BIGINT) AS size, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS raw_flags, k % 4 = 0 AS keyframe_flag FROM f""")
def seq_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_index.seq_index(derived.seq_files(_table(spark, sf_dir, "documents"))).select("path", "frame_index", "offset", "size", "raw_flags", "keyframe_flag")


@query(f"""WITH d AS ({_padded_sql()}), f AS (SELECT path, x, unnest(range((n * 256 + 143) // 144)) AS k FROM d),
b AS (SELECT path, k, array_to_string(list_transform(regexp_extract_all(rpad(substr(x, CAST(k * 288 + 1 AS INTEGER), 256), 256, '0'), '..'), lambda h: lpad(bin(('0x' || h)::BIGINT), 8, '0')), '') AS bits FROM f)
SELECT path, CAST(k AS INTEGER) AS frame_index, md5(array_to_string(list_transform(range(256), lambda i: '0' || printf('%X', {" + ".join(f"CAST(substr(bits, CAST({p * 256} + i + 1 AS INTEGER), 1) AS BIGINT) * {1 << p}" for p in range(4))})), '')) AS pixels_md5 FROM b""")
def cdxl_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDXL files of four planes, as pixels."""
    rows = frames.decode_frames(_with_codec(derived.cdxl_files(_table(spark, sf_dir, "documents"), planes=4)), palette=False)
    return rows.select("path", "frame_index", F.md5(F.hex("pixels")).alias("pixels_md5"))


_LIT = derived.SEQ_LITERAL - 1


@query(f"""{_EVERY.format(padded=_padded_sql())}, c AS (SELECT path, k, k // 4 AS segment, k * 5 % 40 AS x, k % 20 AS y0, substr(x, CAST(k * 512 + 1 AS INTEGER), 512) AS h FROM f),
r AS (SELECT path, k, segment, x // 16 AS first, x % 16 AS s, y0, h, unnest(range(CASE WHEN x % 16 > 0 THEN 48 ELSE 32 END)) AS pos FROM c),
w AS (SELECT path, k, segment, y0 + pos % 16 AS y, first + pos // 16 AS col, {", ".join(f"CASE WHEN pos < 32 THEN ('0x' || substr(h, CAST(least({32 * p} + pos, {_LIT}) * 4 + 1 AS INTEGER), 4))::BIGINT ELSE 0 END >> CAST(s AS INTEGER) AS l{p}, CASE WHEN s > 0 AND pos >= 16 THEN (('0x' || substr(h, CAST(least({32 * p} + pos - 16, {_LIT}) * 4 + 1 AS INTEGER), 4))::BIGINT << CAST(16 - s AS INTEGER)) & 65535 ELSE 0 END AS r{p}" for p in range(4))} FROM r),
b AS (SELECT path, k, y, col, {", ".join(f"bit_xor(l{p} | r{p}) OVER v AS p{p}" for p in range(4))} FROM w WINDOW v AS (PARTITION BY path, segment, y, col ORDER BY k ROWS UNBOUNDED PRECEDING)),
q AS (SELECT path, k, count(*) AS places, sum({" + ".join(f"(((p0 >> {15 - i}) & 1) + 2 * ((p1 >> {15 - i}) & 1) + 4 * ((p2 >> {15 - i}) & 1) + 8 * ((p3 >> {15 - i}) & 1)) * (y * 320 + col * 16 + {i + 1})" for i in range(16))}) AS weighted FROM b GROUP BY path, k)
SELECT path, CAST(k AS INTEGER) AS frame_index, CAST(places AS BIGINT) AS places, CAST(weighted AS BIGINT) AS weighted FROM q""")
def seq_cels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cels of SEQ files, run-length coded, moving, and XOR with the screen: the touched pixels of each frame, weighted by place."""
    shown = seq.seq_shown(derived.seq_cel_files(_table(spark, sf_dir, "documents")))
    return shown.select("path", "frame_index", F.size("places").cast("bigint").alias("places"), binary.placed("places", "pixels", 16).alias("weighted"))


@query(f"""{_EVERY.format(padded=_padded_sql())}, c AS (SELECT path, k, list_transform(regexp_extract_all(substr(x, CAST(k * 512 + 1 AS INTEGER), 64), '.{{{{4}}}}'), lambda w: ('0x' || w)::BIGINT) AS ws FROM f)
SELECT path, CAST(k AS INTEGER) AS frame_index, array_to_string(list_transform(ws, lambda w: {" || '.' || ".join(f"(((w >> {n}) % 8) * 36 + ((w >> {n}) % 8) // 2)" for n in (8, 4, 0))}), ' ') AS colours FROM c""".replace("{{4}}", "{4}"))
def seq_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen colours of each cel, as red.green.blue."""
    colours = seq.seq_palettes(seq.seq_cels(derived.seq_cel_files(_table(spark, sf_dir, "documents"))))
    shown = F.array_join(F.transform("palette", lambda c: F.concat_ws(".", c["r"].cast("string"), c["g"].cast("string"), c["b"].cast("string"))), " ")
    return colours.select("path", "frame_index", shown.alias("colours"))


@query(f"""{_EVERY.format(padded=_padded_sql())}, p AS (SELECT path, CAST(k AS INTEGER) AS frame_index, CASE WHEN k % 3 = 2 AND k % 5 = 4 THEN repeat('00', 256) ELSE substr(x, CAST(k * 512 + 1 AS INTEGER), 512) END AS h FROM f)
SELECT path, frame_index, 32 AS width, 8 AS height, md5(h) AS pixels_md5 FROM p""")
def flc_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as FLC files, these as write operations, and their replay: the pictures that decoding gives."""
    ops = write_ops.write_ops(derived.flc_files(_table(spark, sf_dir, "documents"), words=True))
    return derived.joined(write_ops.replay(ops), derived.FLC_FRAMES).select("path", "frame_index", "width", "height", F.md5(F.hex("pixels")).alias("pixels_md5"))


@query(f"""{_EVERY.format(padded=_padded_sql())}, k AS (SELECT path, k, CASE k % 3 WHEN 0 THEN 'copy' WHEN 1 THEN 'copy' ELSE CASE WHEN k % 5 = 4 THEN 'fill' ELSE 'copy' END END AS op FROM f)
SELECT path, op, CAST(count(*) * 8 AS BIGINT) AS writes, CAST(count(*) * 256 AS BIGINT) AS written FROM k GROUP BY path, op""")
def flc_write_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and how much the operations of each file write."""
    ops = write_ops.write_ops(derived.flc_files(_table(spark, sf_dir, "documents"), words=True)).where("op IN ('copy', 'fill', 'fill_words')")
    size = F.col("count") * F.when(F.col("op") == "fill_words", 2).otherwise(1)
    rows = ops.withColumn("path", F.substring_index("path", "#", 1)).groupBy("path", "op")
    return rows.agg(F.count("*").alias("writes"), F.sum(size).cast("bigint").alias("written"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_suppkey % 9 AS target, l_partkey % 8 AS cursor,
  CASE l_orderkey % 3 WHEN 0 THEN 'bink' WHEN 1 THEN 'cdxl' ELSE 'flc' END AS codec FROM lineitem),
a AS (SELECT r.*, key.k AS keyframe FROM r ASOF LEFT JOIN (SELECT l_orderkey, k FROM r WHERE l_partkey % 3 = 0) key ON key.l_orderkey = r.l_orderkey AND key.k <= r.target),
b AS (SELECT *, target <= n AS can_seek, CASE WHEN codec = 'cdxl' THEN target WHEN target >= cursor THEN cursor WHEN codec = 'bink' THEN coalesce(keyframe, 0) ELSE 0 END AS start FROM a)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(target AS BIGINT) AS frame_index, can_seek, CAST(CASE WHEN can_seek THEN start END AS BIGINT) AS replay_from, CAST(CASE WHEN can_seek THEN target - start END AS BIGINT) AS replay_frames FROM b""")
def seek_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order as a seek within the order's file, a frame a line, of which some are keyframes."""
    w = Window.partitionBy("l_orderkey")
    rows = _table(spark, sf_dir, "lineitem").withColumns({"k": F.row_number().over(w.orderBy("l_linenumber", "l_partkey")) - 1, "frame_count": F.count("*").over(w)})
    path = F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path")
    codec = F.when(F.col("l_orderkey") % 3 == 0, "bink").when(F.col("l_orderkey") % 3 == 1, "cdxl").otherwise("flc").alias("codec")
    requests = rows.select("l_orderkey", "l_linenumber", "l_partkey", path, codec, "frame_count", (F.col("l_partkey") % 8).alias("cursor"), (F.col("l_suppkey") % 9).cast("bigint").alias("frame_index"))
    keyframes = rows.where("l_partkey % 3 = 0").select(path, F.col("k").alias("frame_index"))
    return seek.replay_ranges(requests, keyframes).select("l_orderkey", "l_linenumber", "l_partkey", "frame_index", "can_seek", "replay_from", "replay_frames")


@query(f"""
WITH d AS ({_padded_sql()}), r AS (SELECT doc_id, path, x, (n * 256 + 47) // 48 * 16 AS held, doc_id * 104729 % 2000000 AS begin_us FROM d), b AS (SELECT *, begin_us * 192 // 1000000 AS low, least((begin_us + 1500000) * 192 // 1000000, held) AS high FROM r)
SELECT path, CAST(begin_us AS BIGINT) AS begin_us, array_to_string(list_transform(range(CAST(low AS BIGINT), CAST(greatest(high, low) AS BIGINT)), lambda j: rpad(substr(x, CAST((48 * (j // 16) + 32 + j % 16) * 2 + 1 AS INTEGER), 2), 2, '0')), '') AS pcm FROM b""")
def pcm_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second and a half of each document's CDXL sound, from a time of its own on, whatever chunks that lies in."""
    docs = _table(spark, sf_dir, "documents")
    begin = (F.col("doc_id") * 104729 % 2000000).cast("bigint")
    requests = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), begin.alias("begin_us"), (begin + 1500000).alias("end_us"))
    return audio.pcm_between(audio.cdxl_audio(derived.cdxl_files(docs)), requests).select("path", "begin_us", F.hex("pcm").alias("pcm"))


@query(f"""
WITH RECURSIVE t AS ({_TICKS}), s AS (SELECT user_id, event_id, media_time_us AS start, CASE WHEN event_id % 97 = 0 THEN 4000000000000000000 ELSE media_time_us + event_id % 40 * 10000 END AS stop, event_type = 'error' AND event_id % 5 = 0 AS clear, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM t),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS i, []::BIGINT[] AS sounding, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS INTEGER) AS voice FROM (SELECT DISTINCT user_id FROM s)
  UNION ALL SELECT q.user_id, q.i, CASE WHEN clear THEN []::BIGINT[] WHEN takes THEN list_append(left_on, stop) ELSE left_on END, q.event_id, CASE WHEN takes THEN CAST(len(left_on) + 1 AS INTEGER) END
  FROM (SELECT s.*, list_filter(w.sounding, lambda e: e > s.start) AS left_on, NOT clear AND stop > start AND len(list_filter(w.sounding, lambda e: e > s.start)) < 16 AS takes FROM w JOIN s ON s.user_id = w.user_id AND s.i = w.i + 1) q)
SELECT user_id, event_id, voice FROM w WHERE voice IS NOT NULL""")
def sound_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sounds of some length, some without end; some errors are seeks, which silence all. Sixteen may sound at once."""
    rows = ticks(spark, sf_dir).select("user_id", "event_id", "ts", F.col("media_time_us").alias("start"), F.when(F.col("event_id") % 97 > 0, F.col("event_id") % 40 * 10000).alias("length"), ((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("clear"))
    return audio.voices(rows, "user_id", ["ts", "event_id"], "start", "length", "clear").select("user_id", "event_id", "voice")


def _probe_sql() -> str:
    """A row a file: by codec its size, frames, format, period and sound."""
    docs = [("flc", 32, 8, "n", "indexed8", "33000", (0, 0, 0, 0)), ("cdxl", 32, 8, "(n * 256 + 47) // 48", "indexed8", "83333", (1, 192, 1, 8)), ("dpan", 32, 8, "n", "indexed8", "100000", (0, 0, 0, 0)), ("atari_seq", 320, 200, "n", "indexed8", "5500", (0, 0, 0, 0)),
            ("amiga_anim", 32, 8, "n", "rgb888", "CASE WHEN n > 1 THEN 33333 ELSE 16666 END", (1, 8000, 2, 8)), ("yafa", 32, 8, "n", "indexed8", "40000", (0, 0, 0, 0))]
    row = lambda source, codec, w, h, n, form, period, sound: f"SELECT path, '{codec}' AS codec, {w} AS width, {h} AS height, CAST({n} AS INTEGER) AS frame_count, '{form}' AS format, CAST({period} * ({n}) AS BIGINT) AS duration_us, CAST({period} AS BIGINT) AS frame_period_us, " + ", ".join(f"CAST({x} AS INTEGER) AS {c}" for x, c in zip(sound, ("audio_track_count", "audio_rate", "audio_channels", "audio_bits"), strict=True)) + f", CAST(NULL AS VARCHAR) AS error FROM {source}"
    odd, some = (lambda x: f"CASE WHEN l_orderkey % 2 = 1 THEN {x} ELSE 0 END"), (lambda x: f"CASE WHEN l_orderkey % 3 > 0 THEN {x} ELSE 0 END")
    parts = [row("d", *x) for x in docs] + [row("o", "smk", 160, 120, "n", "indexed8", "100000", (odd(1), odd(22050), odd(2), odd(16))), row("o", "bink", 320, 200, "n", "rgb888", "33366", ("l_orderkey % 3", some(11025), some(2), some(16)))]
    return f"WITH d AS ({_padded_sql()}), o AS (SELECT l_orderkey, 'order/' || l_orderkey AS path, count(*) AS n FROM lineitem GROUP BY l_orderkey) " + " UNION ALL ".join(parts)


@query(_probe_sql())
def probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all eight formats: every document in six of them, every order in the other two."""
    docs, lines = (_table(spark, sf_dir, n) for n in ("documents", "lineitem"))
    files = [build(docs) for build in (derived.flc_files, derived.cdxl_files, derived.dpan_files, derived.seq_files, derived.anim_files, derived.yafa_files)]
    files.append(derived.index_files(lines, "smk", "bink", tracks=True))
    whole = files[0]
    for more in files[1:]:
        whole = whole.union(more)
    return probe.probe(whole)


@query(f"""{_EVERY.format(padded=_padded_sql())}, s AS (SELECT path, k, regexp_extract_all(substr(x, CAST(k * 512 + 1 AS INTEGER), 64), '..') AS bytes FROM f WHERE k % 2 = 0)
SELECT path, CAST(k AS INTEGER) AS frame_index, 0 AS track, 11025 AS rate, 1 AS channels, array_to_string(list_transform(bytes, lambda b: printf('%02X', xor(('0x' || b)::BIGINT, 128))), '') AS pcm FROM s""")
def smk_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw sound of Smacker files, behind a palette in some frames and before the picture in all."""
    parts = smk.smk_parts(derived.smk_files(_table(spark, sf_dir, "documents")))
    return smk.smk_pcm(parts).withColumn("pcm", F.hex("pcm"))


@query(f"""WITH RECURSIVE d AS ({_padded_sql()}), f AS (SELECT path, x, unnest(range(n)) AS k FROM d),
b AS (SELECT path, k, k // 3 AS i, list_transform(range(6), lambda j: ('0x' || substr(x, CAST(k * 512 + j * 2 + 1 AS INTEGER), 2))::BIGINT) AS v FROM f WHERE k % 3 = 0),
m AS (SELECT path, k, i, v[1] % 64 + 1 AS kept, v[2] % 64 + 1 AS copied, v[3] % 128 AS source, -1 - {" - ".join(f"((v[{j}] % 64) * 4 + (v[{j}] % 64) // 16) * {w}" for j, w in ((4, 65536), (5, 256), (6, 1)))} AS colour FROM b),
c AS (SELECT path, k, i, list_transform(range(256), lambda e: CASE WHEN e < kept THEN e WHEN e < kept + copied THEN source + e - kept WHEN e = kept + copied THEN colour ELSE e END) AS map FROM m),
w AS (SELECT path, k, i, list_transform(map, lambda x: CASE WHEN x < 0 THEN -1 - x ELSE 0 END) AS palette FROM c WHERE i = 0
  UNION ALL SELECT c.path, c.k, c.i, list_transform(c.map, lambda x: CASE WHEN x < 0 THEN -1 - x ELSE w.palette[x + 1] END) FROM w JOIN c ON c.path = w.path AND c.i = w.i + 1)
SELECT path, CAST(k AS INTEGER) AS frame_index, md5(array_to_string(palette, ',')) AS palette_md5 FROM w""")
def smk_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palettes of Smacker files, each from the changes to the one before."""
    parts = smk.smk_parts(derived.smk_files(_table(spark, sf_dir, "documents")))
    shown = F.md5(F.array_join(F.transform("palette", lambda c: c.cast("string")), ","))
    return smk.smk_palettes(parts).select("path", "frame_index", shown.alias("palette_md5"))


@query(f"""{_EVERY.format(padded=_padded_sql())}, c AS (SELECT path, k, k // 9 AS segment, k % 9 = 0 AS body, k % 9 > 0 AND k % 7 < 6 AS swaps, substr(x, CAST(k * 512 + 1 AS INTEGER), 512) AS h FROM f),
s AS (SELECT *, coalesce(sum(CAST(swaps AS INTEGER)) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS shown FROM c),
p AS (SELECT path, k, segment, body, shown, h, b AS buffer, y, col FROM s, range(2) r(b), range(8) v(y), range(4) w(col) WHERE (body OR b = shown) AND (body OR y <> 5)),
v AS (SELECT path, k, segment, shown, buffer, y, col, {", ".join(f"CASE WHEN body THEN ('0x' || substr(h, CAST((y * 32 + {4 * p} + col) * 2 + 1 AS INTEGER), 2))::BIGINT WHEN (k + {p}) % 2 = 0 THEN ('0x' || substr(h, CAST(({32 * p} + col * 8 + least(y, 5)) * 2 + 1 AS INTEGER), 2))::BIGINT END AS q{p}" for p in range(8))} FROM p),
l AS (SELECT path, k, shown, buffer, y, col, {", ".join(f"coalesce(last_value(q{p} IGNORE NULLS) OVER o, 0) AS p{p}" for p in range(8))} FROM v WINDOW o AS (PARTITION BY path, segment, buffer, y, col ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT path, CAST(k AS INTEGER) AS frame_index, CAST(any_value(buffer) AS INTEGER) AS buffer, CAST(count(*) AS BIGINT) AS places,
  CAST(sum({" + ".join("(" + " + ".join(f"((p{p} >> {7 - i}) & 1) * {1 << p}" for p in range(8)) + f") * (y * 32 + col * 8 + {i + 1})" for i in range(8))}) AS BIGINT) AS weighted FROM l WHERE buffer = shown GROUP BY path, k""")
def anim_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ANIM files of whole pictures and byte-vertical deltas over two buffers: the touched pixels of each frame, weighted by place."""
    shown = anim_delta.anim_shown(derived.anim_delta_files(_table(spark, sf_dir, "documents")))
    return shown.select("path", "frame_index", "buffer", F.size("places").cast("bigint").alias("places"), binary.placed("places", "pixels", 8).alias("weighted"))
