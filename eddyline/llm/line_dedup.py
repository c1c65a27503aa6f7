"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a site if it stands on more than ``ratio`` of the
site's pages, and on ``min_pages`` pages at least (so that small sites keep
their lines).  Lines are compared without leading and trailing blanks and
count once per page; blank lines are neither counted nor dropped.

Scale: pages are counted per (site, 128-bit line key) with a partial sum
before the shuffle, so text is not shuffled to count it.  A site has at most
(distinct lines per page, on average) / ``ratio`` boilerplate lines whatever
its number of pages, so they travel back to the pages as one array per site;
that join is broadcast or split at a hot site by the adaptive plan.

Defined cases: null text stays null with no lines; a null site is a site of
its own; repeated rows are pages of their own; an empty table gives an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import fresh, load_table, prepare

BLANKS = " \t\r"

# HTML elements that end a line of text.
BLOCK_TAGS = ("html|head|body|title|nav|ul|ol|li|div|article|section|header|footer|"
              "h[1-6]|p|br|table|tr|td|th|pre|blockquote")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK = rf"(?i)</?({BLOCK_TAGS})\b[^<>]*>"
TAG = r"<[^<>]*>"


def url_host(url: str | Column) -> Column:
    """Lower-case host of an absolute URL; empty if there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def html_lines(html: str | Column) -> Column:
    """Page markup as text: block elements end a line, other tags go."""
    shown = F.regexp_replace(html, F.lit(HIDDEN), F.lit(""))
    return F.regexp_replace(F.regexp_replace(shown, F.lit(BLOCK), F.lit("\n")), F.lit(TAG), F.lit(""))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def drop_site_boilerplate(pages: DataFrame, site: Column, text_col: str, ratio: float = 0.1,
                          min_pages: int = 3) -> DataFrame:
    """``pages`` with ``text_col`` less its boilerplate lines, and two more
    columns (``n_lines`` with a word, ``n_dropped``; an underscore is added
    where ``pages`` has such a name)."""
    names = pages.columns
    own = {n: fresh(n, names) for n in ("_site", "_lines", "_bad", "n_lines", "n_dropped")}
    s, ls, bad = own["_site"], own["_lines"], own["_bad"]
    rows = pages.withColumns({s: site, ls: F.split(text_col, "\n")})
    bare = F.filter(F.transform(ls, _bare), lambda x: x != "")

    keys = rows.select(F.col(s).alias("site"),
                       F.explode(F.array_distinct(F.transform(bare, _key))).alias("key"))
    seen = keys.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    totals = rows.groupBy(F.col(s).alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    often = (seen.alias("x").join(totals.alias("t"), F.col("x.site").eqNullSafe(F.col("t.site")))
             .filter(F.col("n").cast("double") > F.lit(float(ratio)) * F.col("pages").cast("double")))
    per_site = often.groupBy(F.col("x.site").alias("site")).agg(F.collect_list("key").alias("keys"))

    joined = rows.join(per_site.select(F.col("site").alias(bad + "s"), F.col("keys").alias(bad)),
                       F.col(s).eqNullSafe(F.col(bad + "s")), "left")
    stays = lambda x: (_bare(x) == "") | ~F.array_contains(F.col(bad), _key(_bare(x)))
    kept = F.when(F.col(bad).isNull(), F.col(ls)).otherwise(F.filter(ls, stays))
    with_word = lambda c: F.coalesce(
        F.size(F.filter(c, lambda x: _bare(x) != "")).cast("long"), F.lit(0).cast("long"))
    out = joined.withColumn(bad + "k", kept).withColumns({
        own["n_lines"]: F.when(F.col(ls).isNull(), F.lit(0)).otherwise(with_word(F.col(ls))).cast("long"),
        own["n_dropped"]: F.when(F.col(ls).isNull(), F.lit(0)).otherwise(
            F.size(ls) - F.size(bad + "k")).cast("long"),
        text_col: F.when(F.col(ls).isNotNull(), F.array_join(bad + "k", "\n"))})
    return out.select(*[F.col(f"`{n}`") for n in names], own["n_lines"], own["n_dropped"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = load_table(spark, sf_dir, "pages").select(
        "page_id", url_host("url").alias("host"), html_lines("html").alias("text"))
    return drop_site_boilerplate(pages, F.col("host"), "text").select(
        "page_id", "host", "n_lines", "n_dropped", "text")


ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'),
           '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g') AS text,
         row_number() OVER () AS rid FROM pages),
l AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
k AS (SELECT rid, host, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
n AS (SELECT host, bare, count(DISTINCT rid) AS n FROM k WHERE bare <> '' GROUP BY 1, 2),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
b AS (SELECT n.host, bare FROM n JOIN t ON n.host IS NOT DISTINCT FROM t.host
      WHERE n >= 3 AND CAST(n AS DOUBLE) > CAST(0.1 AS DOUBLE) * CAST(pages AS DOUBLE)),
m AS (SELECT k.*, b.bare IS NOT NULL AS bad FROM k LEFT JOIN b
      ON k.host IS NOT DISTINCT FROM b.host AND k.bare = b.bare),
g AS (SELECT rid, count(*) FILTER (WHERE bare <> '') AS n_lines,
             count(*) FILTER (WHERE bad) AS n_dropped,
             string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad) AS text
      FROM m GROUP BY rid)
SELECT page_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text
FROM p LEFT JOIN g USING (rid)
"""
