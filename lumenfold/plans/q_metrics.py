"""Metric queries: parsing, macro averages, ranks, surface metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import names
from lumenfold.operators import metrics, nn

from .tables import PARTS_SQL, backbone, dist_sql, donor, read


def parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric files named from events: a scene and a method from the user, the value from ``props``; keys
    other than ``k`` are missing, and every 11th file is malformed."""
    e = read(spark, sf_dir, "events")
    name = F.concat(F.lit("eval/a_b/scene_"), (F.col("user_id") % 7).cast("string"), F.lit("_m"), (F.col("event_id") % 3).cast("string"), F.lit("_metrics.json"))
    path = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("x/m"), (F.col("event_id") % 3).cast("string"), F.lit("_metrics.json"))).otherwise(name)
    text = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.col("props"))
    scene, method = names.metric_stem(F.col("path"))
    rows = e.select("event_id", path.alias("path"), text.alias("text"))
    # Malformed text gives null fields, never an error.
    value = F.from_json("text", "k double, missing double", {"mode": "PERMISSIVE"})
    rows = rows.select(scene.alias("scene"), method.alias("method"), value.alias("v"))
    return rows.groupBy("scene", "method").agg(
        F.count(F.lit(1)).alias("files"), F.count("v.k").alias("parsed"), F.round(F.avg("v.k"), 6).alias("mean_k"), F.count("v.missing").alias("with_missing")
    )


PARSE_SQL = """
WITH f AS (
  SELECT CASE WHEN user_id % 5 = 0 THEN 'm' || (event_id % 3) ELSE 'scene_' || (user_id % 7) || '_m' || (event_id % 3) END AS stem,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events
), g AS (
  SELECT coalesce(nullif(array_to_string(list_slice(string_split(stem, '_'), 1, len(string_split(stem, '_')) - 1), '_'), ''), 'scene') AS scene,
         list_extract(string_split(stem, '_'), -1) AS method, k FROM f
)
SELECT scene, method, count(*) AS files, count(k) AS parsed, round(avg(k), 6) AS mean_k, CAST(0 AS BIGINT) AS with_missing FROM g GROUP BY scene, method
"""


def _facts(spark: SparkSession, sf_dir: str, scene: str = "l_returnflag", method: str = "l_linestatus") -> DataFrame:
    """Scene and method means of line items in the role of metric files; one cell lacks a metric."""
    cells = read(spark, sf_dir, "lineitem").groupBy(F.expr(scene).alias("scene"), F.expr(method).alias("method")).agg(
        F.avg(F.col("l_discount") / 10).alias("Acc"), F.avg(F.col("l_tax") / 10).alias("Comp"), F.avg((F.col("l_discount") + F.col("l_tax")) / 20).alias("C-L1"),
        F.avg(F.col("l_quantity") / 50).alias("NC"), F.avg(F.col("l_extendedprice") / 110000).alias("F-score"),
    )
    long = cells.unpivot(["scene", "method"], ["Acc", "Comp", "C-L1", "NC", "F-score"], "metric", "value")
    return long.where("not (scene in ('A', 's1') and method in ('O', 'm1') and metric = 'NC')")


def _facts_sql(scene: str, method: str) -> str:
    return f"""
cells AS (
  SELECT {scene} AS scene, {method} AS method, avg(l_discount / 10) AS "Acc", avg(l_tax / 10) AS "Comp",
         avg((l_discount + l_tax) / 20) AS "C-L1", avg(l_quantity / 50) AS "NC", avg(l_extendedprice / 110000) AS "F-score"
  FROM lineitem GROUP BY 1, 2
),
long AS (
  SELECT * FROM (UNPIVOT cells ON "Acc", "Comp", "C-L1", "NC", "F-score" INTO NAME metric VALUE value)
  WHERE NOT (scene IN ('A', 's1') AND method IN ('O', 'm1') AND metric = 'NC')
),
d AS (SELECT * FROM (VALUES ('Acc', 100.0, false), ('Comp', 100.0, false), ('C-L1', 100.0, false), ('NC', 1.0, true), ('F-score', 1.0, true)) t(metric, scale, higher)),
allm AS (
  SELECT scene, method, metric, value, false AS is_total FROM long
  UNION ALL
  SELECT 'AVG', c.method, d.metric, avg(coalesce(l.value, 0)), true FROM cells c CROSS JOIN d
  LEFT JOIN long l ON l.scene = c.scene AND l.method = c.method AND l.metric = d.metric GROUP BY c.method, d.metric
)
"""


_FACTS = _facts_sql("l_returnflag", "l_linestatus")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.in_display_units(metrics.macro_average(_facts(spark, sf_dir)))
    return m.select("scene", "method", "metric", F.round("shown", 6).alias("shown"), "is_total")


MACRO_SQL = f"""
WITH {_FACTS}
SELECT scene, method, a.metric, round(value * CAST(scale AS DOUBLE), 6) AS shown, is_total FROM allm a JOIN d ON d.metric = a.metric
"""


def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.rank_methods(metrics.macro_average(_facts(spark, sf_dir)).select("scene", "method", "metric", "value"))
    return r.select("scene", "metric", "method", F.col("rank").cast("long").alias("rank"))


RANK_SQL = f"""
WITH {_FACTS}
SELECT scene, a.metric, method, row_number() OVER (PARTITION BY scene, a.metric ORDER BY CASE WHEN higher THEN -value ELSE value END, method) AS rank
FROM allm a JOIN d ON d.metric = a.metric
"""


def chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.surface_metrics(donor(spark, sf_dir), backbone(spark, sf_dir), 0.05, normals=True)
    return m.select(*(F.round(c, 8).alias(c) for c in ("accuracy", "completion", "chamfer_l1", "precision", "recall", "f_score", "normal_consistency")))


def _one_way(a: str, b: str) -> str:
    return f"""
SELECT dist, ac FROM (
  SELECT {dist_sql(a, b)} AS dist, abs({a}.nx * {b}.nx + {a}.ny * {b}.ny + {a}.nz * {b}.nz) AS ac,
         row_number() OVER (PARTITION BY {a}.pid ORDER BY {dist_sql(a, b)}, {b}.pid) AS rn FROM {a} CROSS JOIN {b}) WHERE rn = 1
"""


CHAMFER_SQL = f"""
WITH {PARTS_SQL}, one AS ({_one_way("dn", "bb")}), two AS ({_one_way("bb", "dn")}),
s AS (SELECT avg(dist) AS a, avg(CASE WHEN dist < CAST(0.05 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS p, avg(ac) AS n FROM one),
t AS (SELECT avg(dist) AS c, avg(CASE WHEN dist < CAST(0.05 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS r, avg(ac) AS n2 FROM two)
SELECT round(a, 8) AS accuracy, round(c, 8) AS completion, round((a + c) / 2, 8) AS chamfer_l1, round(p, 8) AS precision, round(r, 8) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 8) AS f_score, round((n + n2) / 2, 8) AS normal_consistency FROM s, t
"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.error_summary(nn.nearest(donor(spark, sf_dir), backbone(spark, sf_dir)))
    return s.select(*(F.round(c, 8).alias(c) for c in s.columns))


ERRORS_SQL = f"""
WITH {PARTS_SQL}, one AS ({_one_way("dn", "bb")})
SELECT round(median(dist) * 100, 8) AS median_cm, round(avg(dist) * 100, 8) AS mean_cm, round(quantile_cont(dist, 0.9) * 100, 8) AS p90_cm FROM one
"""

QUERIES = {
    "q10_metric_parse": parse,
    "q11_metric_macro_avg": macro,
    "q12_metric_rank": rank,
    "q14_chamfer_fscore": chamfer,
    "q14b_error_summary": errors,
}
ORACLE_SQL = {
    "q10_metric_parse": PARSE_SQL,
    "q11_metric_macro_avg": MACRO_SQL,
    "q12_metric_rank": RANK_SQL,
    "q14_chamfer_fscore": CHAMFER_SQL,
    "q14b_error_summary": ERRORS_SQL,
}
