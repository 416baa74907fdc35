"""The jobs as queries on the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import collate_results, ingest_captures
from lumenfold import scratch
from lumenfold.operators import metrics
from lumenfold.plans import q_frames

CLIP_NUMBERS = ("median_sharpness", "total_motion")


def job1_ingest_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one folder with one checkpoint; the second finds nothing new."""
    at = scratch.folder(spark, "job1")
    for _ in range(2):
        # As a pattern, which may name a single file, too.
        ingest_captures.run(spark, f"{sf_dir}/events.parquet*", f"{at}/out", f"{at}/checkpoint")
    return ingest_captures.result(spark, f"{at}/out").select(
        "video", F.col("frame").alias("event_id"), "i", "selected", "reason", "analysed_frames", "selected_frames", "dropped_blur", "dropped_redundant",
        *(F.round(c, 4).alias(c) for c in CLIP_NUMBERS),
    )


JOB1_SQL = f"""
WITH RECURSIVE {q_frames._ORDERED}, {q_frames._selection_sql(12, q_frames._ORDERED_TOTAL)},
n AS (SELECT user_id AS video, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
r AS (
  SELECT video, count(*) AS analysed_frames, count(CASE WHEN selected THEN 1 END) AS selected_frames,
    count(CASE WHEN NOT selected AND reason LIKE '%sharpness%' THEN 1 END) AS dropped_blur,
    count(CASE WHEN NOT selected AND reason LIKE '%redundant%' THEN 1 END) AS dropped_redundant,
    round(max(med), 4) AS median_sharpness, round(sum(motion), 4) AS total_motion
  FROM lab GROUP BY video
)
SELECT lab.video, n.event_id, lab.i, lab.selected, lab.reason, r.* EXCLUDE (video)
FROM lab JOIN n ON n.video = lab.video AND n.i = lab.i JOIN r ON r.video = lab.video
"""


def job2_collate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one folder; the second replaces what the first wrote by the same."""
    at = scratch.folder(spark, "job2")
    for _ in range(2):
        collate_results.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{at}/out")
    out = collate_results.result(spark, f"{at}/out")
    return out.select("scene", "method", "metric", F.round("value", 9).alias("value"), F.round("shown", 7).alias("shown"), F.col("rank").cast("long").alias("rank"), "is_total")


_NAMED = f"coalesce(nullif(trim({{}}), ''), '{collate_results.UNNAMED}')"
_DESCRIPTORS = ", ".join(f"('{key}', {scale}, {'true' if higher else 'false'})" for key, _, scale, higher in metrics.DESCRIPTORS)
JOB2_SQL = f"""
WITH d AS (SELECT doc_id AS item, text, {_NAMED.format("source")} AS scene, {_NAMED.format("lang")} AS method FROM documents),
l AS (
  SELECT doc_id AS item, coalesce(bool_and(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1
),
f AS (SELECT scene, method, row_number() OVER (PARTITION BY text ORDER BY item NULLS LAST, scene, method) AS k FROM d WHERE trim(text) <> ''),
o AS (SELECT scene, method, count(*) AS own FROM f WHERE k = 1 GROUP BY 1, 2),
c AS (
  SELECT d.scene, d.method, count(*) AS items, count(l.item) AS labelled,
         count(CASE WHEN l.good THEN 1 END) AS good, count(CASE WHEN l.bad THEN 1 END) AS bad
  FROM d LEFT JOIN l ON l.item = d.item GROUP BY 1, 2
),
w AS (
  SELECT c.scene, c.method, CASE WHEN labelled > 0 THEN CAST(bad AS DOUBLE) / labelled END AS acc,
         1 - CAST(coalesce(own, 0) AS DOUBLE) / items AS comp, CASE WHEN labelled > 0 THEN CAST(good AS DOUBLE) / labelled END AS nc
  FROM c LEFT JOIN o ON o.scene = c.scene AND o.method = c.method
),
v AS (
  SELECT * FROM (
    SELECT scene, method, 'Acc' AS metric, acc AS value FROM w UNION ALL SELECT scene, method, 'Comp', comp FROM w
    UNION ALL SELECT scene, method, 'C-L1', (acc + comp) / 2 FROM w UNION ALL SELECT scene, method, 'NC', nc FROM w
    UNION ALL SELECT scene, method, 'F-score', CASE WHEN 1 - comp + nc > 0 THEN 2 * (1 - comp) * nc / (1 - comp + nc) WHEN nc IS NOT NULL THEN 0 END FROM w
  ) WHERE value IS NOT NULL
),
m AS (SELECT * FROM (VALUES {_DESCRIPTORS}) t(metric, scale, higher)),
e AS (
  SELECT scene, method, metric, value, false AS is_total FROM v
  UNION ALL
  SELECT '{metrics.TOTAL}', w.method, m.metric, avg(coalesce(v.value, 0)), true FROM w CROSS JOIN m
  LEFT JOIN v ON v.scene = w.scene AND v.method = w.method AND v.metric = m.metric GROUP BY w.method, m.metric
)
SELECT scene, method, e.metric, round(value, 9) AS value, round(value * CAST(scale AS DOUBLE), 7) AS shown,
       row_number() OVER (PARTITION BY scene, e.metric, is_total ORDER BY CASE WHEN higher THEN -round(value, 12) ELSE round(value, 12) END, method) AS rank, is_total
FROM e JOIN m ON m.metric = e.metric
"""

QUERIES = {"job1_ingest_captures": job1_ingest_captures, "job2_collate_results": job2_collate_results}
ORACLE_SQL = {"job1_ingest_captures": JOB1_SQL, "job2_collate_results": JOB2_SQL}
