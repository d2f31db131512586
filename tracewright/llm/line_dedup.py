"""Line removal by site-relative frequency, with DataFrame functions only.

For each host, the pages holding a line are divided by the host's pages; lines above a ratio
are boilerplate of that site and leave its pages, while the same line stays on other sites. A line must stand
on two pages at least: one page has nothing to be compared with.

Lines are compared by a 128-bit digest, and counted after a partial count in each task, so a
host with a third of all pages, or a line that all of them hold, costs one row a task. What a
host drops is bounded by its pages' lines, not by its pages: lines on more than ``ratio`` of
the pages are fewer than the mean lines a page / ratio. That small list meets the texts in
one join by host, which Spark may broadcast or split where a host is hot.

Defined results: pages of a null host form no site and keep all lines; a null text has no
lines; each row counts as a page; an empty table gives an empty result; the result has the
columns named below only, so clashing names in the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import materialize

HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|article|section|nav|header|footer|title|body|html|head|main|aside|pre|blockquote)\b[^>]*>"
TAG = r"<[^>]*>"
BLANKS = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """Host of an address in lower case; null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def visible_lines(html: Column) -> Column:
    """Lines of a page as block elements divide it, trimmed, without empty ones."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    t = F.regexp_replace(F.regexp_replace(t, BLOCK, "\n"), TAG, "")
    return text_lines(t)


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(rows: DataFrame, ratio: float) -> DataFrame:
    """host, keys: digests of the lines to drop there. rows: host, lines."""
    known = rows.where(F.col("host").isNotNull())
    pages = materialize(known.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1"), "line-hosts")
    lines = known.select("host", F.explode(F.transform(F.array_distinct("lines"), _key)).alias("key"))
    counts = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    frequent = counts.join(pages, "host").where(F.col("n") > ratio * F.col("pages"))
    return materialize(frequent.groupBy("host").agg(F.collect_set("key").alias("keys")), "line-drops")


def dedup_lines(
    pages: DataFrame, host: Column, lines: Column, ratio: float = 0.3, id_col: str = "page_id"
) -> DataFrame:
    """id, host, n_lines, n_dropped and the text that is left."""
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), lines.alias("lines"))
    drops = boilerplate(rows.select("host", "lines"), ratio)
    left = rows.join(drops, "host", "left").select(
        id_col, "host", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("keys").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("keys"), _key(x)))).alias("left"),
    )
    return left.select(id_col, "host", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("text"))
