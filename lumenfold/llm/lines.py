"""Boilerplate lines by their frequency within a site.

A line is boilerplate on a site if it is on at least ``MIN_PAGES`` of its pages and on more than
``RATIO`` of them. Pages of one site with equal texts count as one page, so a much-copied
document is not boilerplate by itself. Built from DataFrame functions only.

The boilerplate set of a site has at most (distinct lines per page) / ``RATIO`` lines, as every
such line takes a share ``RATIO`` of the site's pages, so it travels as one small array per
site: the documents are never exploded and regrouped, and their texts are shuffled only if the
sites' sets together exceed the broadcast bound.

Defined results: lines are compared without surrounding blanks, blank lines are never dropped;
null text stays null with no lines, empty text has none; a null site is the site of empty name;
repeated rows are each cleaned; an empty table gives no rows; documents that lose nothing keep
their text as it is; other columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, materialize, read

RATIO = 0.1
MIN_PAGES = 3
SALTS = 32

_BLANKS = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _line_key(line: Column) -> Column:
    """96 bits of a line, null for a blank one."""
    bare = F.trim(line, F.lit(_BLANKS))
    return F.when(F.length(bare) > 0, F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site, pages, key, n`` of every line above the ratio."""
    pages = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("site"),
        F.xxhash64(text).alias("page"),
        F.col(text).alias("text"),
    )
    totals = pages.select("site", "page").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select(
        "site", "page", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _line_key))).alias("key")
    ).where("key is not null")
    counts = (
        lines.groupBy("site", "key", "page")
        .agg(F.lit(1).alias("one"))
        .groupBy("site", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
    )
    return counts.join(totals, "site").where(F.col("n") > ratio * F.col("pages")).select("site", "pages", "key", "n")


COUNTS = ("n_lines", "n_dropped")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, names: tuple[str, str] = COUNTS) -> DataFrame:
    """``docs`` with cleaned texts and two more columns, ``names``: the number of lines and of those dropped.
    Like-named columns are replaced."""
    docs = docs.drop(*names)
    site_, drop_, salt_, lines_, kept_ = fresh(docs, "__site", "__drop", "__salt", "__lines", "__kept")
    sets = boilerplate(docs, host, text, ratio, min_pages).groupBy("site").agg(F.collect_set("key").alias(drop_))
    sets = materialize(sets.withColumnRenamed("site", site_), "boilerplate")
    held = sets.agg(F.coalesce(F.sum(F.size(drop_) + 4), F.lit(0))).first()[0]
    placed = docs.withColumn(site_, F.coalesce(F.col(host).cast("string"), F.lit("")))
    if held <= BROADCAST_ROWS:
        joined = placed.join(F.broadcast(sets), site_, "left")
    else:
        # Each site's set in SALTS copies, so that a site with a third of all pages is spread.
        salted = sets.withColumn(salt_, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = placed.withColumn(salt_, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, [site_, salt_], "left")
    lines = F.when(F.length(text) > 0, F.split(text, "\n"))
    kept = F.filter(lines_, lambda x: ~F.coalesce(F.array_contains(drop_, _line_key(x)), F.lit(False)))
    joined = joined.withColumn(lines_, lines)
    joined = joined.withColumn(kept_, F.when(F.col(drop_).isNotNull(), kept).otherwise(F.col(lines_)))
    n = F.coalesce(F.size(lines_).cast("long"), F.lit(0))
    lost = F.coalesce((F.size(lines_) - F.size(kept_)).cast("long"), F.lit(0))
    cleaned = F.when(lost > 0, F.array_join(kept_, "\n")).otherwise(F.col(text))
    return joined.select(
        *(cleaned.alias(c) if c == text else F.col(c) for c in docs.columns),
        F.when(F.col(lines_).isNull(), F.lit(0)).otherwise(n).alias(names[0]),
        F.when(F.col(lines_).isNull(), F.lit(0)).otherwise(lost).alias(names[1]),
    )


def without_boilerplate(docs: DataFrame, host: str = "source") -> DataFrame:
    """Documents with cleaned texts; columns as given, ``n_chars`` (if there) counted anew where
    lines were dropped."""
    names = tuple(fresh(docs, *COUNTS))
    out = drop_boilerplate(docs, host, names=names)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(source, '') AS site,
         CASE WHEN text IS NULL OR text = '' THEN NULL ELSE string_split(text, chr(10)) END AS ls
  FROM documents
), pages AS (
  SELECT DISTINCT site, text FROM d WHERE text IS NOT NULL
), totals AS (
  SELECT site, count(*) AS pages FROM pages GROUP BY site
), lines AS (
  SELECT site, text, unnest(list_distinct(list_transform(string_split(text, chr(10)),
         lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))))) AS line
  FROM pages
), boiler AS (
  SELECT l.site, l.line FROM lines l JOIN totals t ON l.site = t.site
  WHERE l.line <> '' GROUP BY l.site, l.line, t.pages
  HAVING count(*) >= {MIN_PAGES} AND count(*) > CAST({RATIO} AS DOUBLE) * t.pages
), sets AS (
  SELECT site, list(line) AS drops FROM boiler GROUP BY site
), cut AS (
  SELECT d.*, CASE WHEN drops IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(drops,
         trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) END AS kept
  FROM d LEFT JOIN sets ON d.site = sets.site
)
SELECT doc_id, source,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN coalesce(len(ls) - len(kept), 0) > 0 THEN coalesce(array_to_string(kept, chr(10)), '') ELSE text END AS text
FROM cut
"""
