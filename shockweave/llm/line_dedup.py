"""Boilerplate lines by their frequency within a site.

A page's text is cut into lines at block tags and line breaks. For each host the pages that
contain a line are divided by the host's pages; lines above the ratio are dropped from all
pages of the host. All of it is built-in functions: pages that hold a line are counted with
partial sums, so a host or a line with a large share of the rows is added up before it is
shuffled, and lines travel as two 64-bit hashes.

Defined results: a page whose url is null or has no host keeps all lines; null html has
none; a line that is in fewer than ``min_pages`` pages of its host stays, whatever its
ratio; repeated rows and rows without page_id are pages like any other; a table without
rows gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockweave.storage import cut

RATIO = 0.3
MIN_PAGES = 3
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|"
    r"ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>|\n"
)
TAG = r"<[^>]*>"
BLANK = r"[ \t\r\f]+"


def page_lines(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host`` (null if there is none), ``lines``: the visible lines without outer blanks."""
    line = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, TAG, ""), BLANK, " "))
    seen = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), UNSEEN, " ")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.expr(f"nullif(regexp_extract(lower(cast(url as string)), r'{HOST}', 1), '')").alias("host"),
        F.filter(F.transform(F.split(seen, BREAK), line), lambda x: x != "").alias("lines"),
    )


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id``, ``host``, ``n_lines``, ``n_dropped``, ``text``: the lines that stay."""
    rows = cut(page_lines(pages).withColumn("_row", F.monotonically_increasing_id()))
    named = [F.xxhash64("host", "line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g")]
    sites = rows.where("host is not null")
    held = (
        sites.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .select(*named, "host")
        .groupBy("h", "g").agg(F.count("*").alias("pages"), F.min("host").alias("host"))
        .where(F.col("pages") >= min_pages)
    )
    totals = sites.groupBy("host").agg(F.count("*").alias("total"))
    common = held.join(totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("total")).select("h", "g")
    dropped = (
        sites.select("_row", "host", F.posexplode("lines").alias("pos", "line"))
        .select("_row", "pos", *named)
        .join(common, ["h", "g"], "left_semi")
        .groupBy("_row").agg(F.collect_list("pos").alias("out"))
    )
    kept = F.filter("lines", lambda x, i: ~F.array_contains(F.coalesce("out", F.array().cast("array<int>")), i))
    return rows.join(dropped, "_row", "left").select(
        "page_id", "host",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("text"),
    )


ORACLE = rf"""
WITH seen AS (
  SELECT row_number() OVER () AS r, page_id,
         nullif(regexp_extract(lower(url), '{HOST}', 1), '') AS host,
         regexp_split_to_array(regexp_replace(coalesce(html, ''), '{UNSEEN}', ' ', 'g'), '{BREAK.replace(chr(92) + "n", chr(10))}') AS pieces
  FROM pages),
cleaned AS (
  SELECT r, page_id, host,
         list_filter(list_transform(pieces, lambda x: trim(regexp_replace(regexp_replace(x, '{TAG}', '', 'g'), '{BLANK}', ' ', 'g'), ' ')), lambda x: x <> '') AS lines
  FROM seen),
exploded AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cleaned),
held AS (SELECT host, line, count(DISTINCT r) AS pages FROM exploded WHERE host IS NOT NULL GROUP BY host, line),
totals AS (SELECT host, count(*) AS total FROM cleaned GROUP BY host),
common AS (SELECT host, line FROM held JOIN totals USING (host) WHERE pages >= {MIN_PAGES} AND pages > {RATIO} * total),
marked AS (SELECT e.*, c.line IS NOT NULL AS gone FROM exploded e LEFT JOIN common c ON e.host = c.host AND e.line = c.line),
summed AS (SELECT r, count(*) FILTER (WHERE gone) AS n_dropped,
                  string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY r)
SELECT page_id, host, len(lines) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(text, '') AS text
FROM cleaned LEFT JOIN summed USING (r)
"""
