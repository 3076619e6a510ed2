"""Line dedup by site-relative frequency, in DataFrame expressions only.

The lines of a page are its text between block tags. For each host, the distinct pages that contain a line are divided
by the host's distinct pages; a line on ``MIN_PAGES`` of them at least and on a share above ``MAX_RATIO`` is dropped
from all its pages. Pages with the same lines in the same order count once, so copies of a page are no evidence against
its text. The share decides on every host of thirty pages or more (``MIN_PAGES / MAX_RATIO``); below, the least number of
pages is the stricter one, so that two near copies on a small host don't take each other's lines.

Counting is a grouped sum, so a host of a third of all pages costs no more than others. The boilerplate lines have a
row each and meet the pages' lines, exploded to hashes and places, in a join by host and line, which Spark can
broadcast or split; what comes back to a page is the places of its dropped lines.

Lines are compared within a host by 64-bit hash, pages by a hash of theirs. Defined results: null or empty html has no
lines; a page without host keeps all its lines; an unclosed script or style runs to the end of the page; repeated rows
each get their lines; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import WORD_GAP, materialize

MAX_RATIO, MIN_PAGES = 0.1, 3

# What is no text, what ends a line, and the remaining markup.
UNSEEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
LINE_END = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
MARKUP = r"<[^>]*>"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)"


def page_lines(html: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " "), LINE_END, "\n"), MARKUP, "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.btrim(F.regexp_replace(x, WORD_GAP, " ")))
    return F.filter(lines, lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit(""))


def boilerplate(rows: DataFrame, ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host`` and ``line``, the hash of a boilerplate line of it, from rows of ``host`` and ``hashes`` (of a page's lines)."""
    distinct = rows.where("host IS NOT NULL").select("host", F.xxhash64("hashes").alias("page"), F.array_distinct("hashes").alias("lines")).dropDuplicates(["host", "page"])
    pages = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    seen = distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return seen.join(pages, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line")


def drop_boilerplate(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``id``, ``host``, ``n_lines``, ``n_dropped`` and the kept ``lines`` of each page."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), host_of(F.col(url)).alias("host"), page_lines(F.col(html)).alias("lines"))
    rows = materialize(rows.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x))))
    # written first: with its size known, Spark broadcasts it if it is small, and else splits the join's frequent lines
    fixed = materialize(boilerplate(rows.select("host", "hashes"), ratio, min_pages))
    places = rows.where("host IS NOT NULL").select("row", "host", F.posexplode("hashes").alias("at", "line"))
    gone = places.join(fixed, ["host", "line"], "left_semi").groupBy("row").agg(F.collect_list("at").alias("gone"))
    joined = rows.drop("hashes").join(materialize(gone), "row", "left")
    n = F.size("lines")
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda k: F.get("lines", k))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left)
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint")
    return joined.select("id", "host", n.cast("bigint").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("lines"))
