"""Surface queries: nearest neighbours, gap filling, transfer, components, mesh cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import scratch
from lumenfold.functions import color
from lumenfold.operators import graph, mesh, metrics, nn

from .tables import PARTS_SQL, backbone, dist_sql, donor, points

TAU = 0.05


def nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nn.nearest(donor(spark, sf_dir), backbone(spark, sf_dir))
    return n.select(F.col("qid").alias("pid"), F.col("pid").alias("near"), F.round("dist", 9).alias("dist"))


_NEAR = f"""
{PARTS_SQL},
pairs AS (SELECT dn.pid, bb.pid AS near, {dist_sql("dn", "bb")} AS dist FROM dn CROSS JOIN bb),
nn AS (SELECT pid, near, dist FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, near) AS rn FROM pairs) WHERE rn = 1)
"""
NN_SQL = f"WITH {_NEAR} SELECT pid, near, round(dist, 9) AS dist FROM nn"


def nn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nn.k_nearest(donor(spark, sf_dir), backbone(spark, sf_dir), 3, "grid")
    return n.select(F.col("qid").alias("pid"), "rank", F.col("pid").alias("near"), F.round("dist", 9).alias("dist"))


NN_GRID_SQL = f"""
WITH {PARTS_SQL},
pairs AS (SELECT dn.pid, bb.pid AS near, {dist_sql("dn", "bb")} AS dist FROM dn CROSS JOIN bb),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, near) AS rn FROM pairs)
SELECT pid, CAST(rn AS INTEGER) AS rank, near, round(dist, 9) AS dist FROM r WHERE rn <= 3
"""


def nn_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = nn.fuse_diagnostics(donor(spark, sf_dir), backbone(spark, sf_dir), TAU)
    return d.select(
        "backbone_pts", "donor_pts", *(F.round(c, 9).alias(c) for c in ("donor_nn_p25_m", "donor_nn_median_m", "donor_nn_p75_m")),
        "donor_gapfill_pts", F.round("donor_gapfill_frac", 9).alias("donor_gapfill_frac"),
    )


DIAG_SQL = f"""
WITH {_NEAR}
SELECT (SELECT count(*) FROM bb) AS backbone_pts, count(*) AS donor_pts,
       round(quantile_cont(dist, 0.25), 9) AS donor_nn_p25_m, round(quantile_cont(dist, 0.5), 9) AS donor_nn_median_m,
       round(quantile_cont(dist, 0.75), 9) AS donor_nn_p75_m,
       count(CASE WHEN dist > CAST({TAU} AS DOUBLE) THEN 1 END) AS donor_gapfill_pts,
       round(avg(CASE WHEN dist > CAST({TAU} AS DOUBLE) THEN 1.0 ELSE 0.0 END), 9) AS donor_gapfill_frac
FROM nn
"""


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn.gap_points(donor(spark, sf_dir), backbone(spark, sf_dir), TAU, "grid").select("pid", *(F.round(c, 9).alias(c) for c in "xyz"))


_GAP = f"NOT EXISTS (SELECT 1 FROM {{base}} b WHERE {dist_sql('d', 'b')} <= CAST({{tau}} AS DOUBLE))"
GAP_SQL = f"""
WITH {PARTS_SQL}
SELECT pid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM dn d WHERE {_GAP.format(base="bb", tau=TAU)}
"""


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = nn.fuse(backbone(spark, sf_dir), donor(spark, sf_dir), TAU)
    return f.select("pid", "part", *(F.round(color.clip(F.col(c)), 9).alias(c) for c in "rgb"))


CONSENSUS_SQL = f"""
WITH {PARTS_SQL},
u AS (SELECT *, 'backbone' AS part FROM bb UNION ALL SELECT *, 'donor' AS part FROM dn d WHERE {_GAP.format(base="bb", tau=TAU)})
SELECT pid, part, round(greatest(0, least(1, r)), 9) AS r, round(greatest(0, least(1, g)), 9) AS g, round(greatest(0, least(1, b)), 9) AS b FROM u
"""


def void_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    by = [p.where(F.col("label") % 3 == k) for k in range(3)]
    return nn.void_fill(by[0], [("second", by[1], 0.05), ("third", by[2], 0.08)]).select("pid", "part")


VOID_SQL = f"""
WITH {PARTS_SQL},
base AS (SELECT * FROM p WHERE label % 3 = 0),
s AS (SELECT * FROM p d WHERE label % 3 = 1 AND {_GAP.format(base="base", tau=0.05)}),
bs AS (SELECT * FROM base UNION ALL SELECT * FROM s),
t AS (SELECT * FROM p d WHERE label % 3 = 2 AND {_GAP.format(base="bs", tau=0.08)})
SELECT pid, 'base' AS part FROM base UNION ALL SELECT pid, 'second' AS part FROM s UNION ALL SELECT pid, 'third' AS part FROM t
"""


def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nn.transfer(donor(spark, sf_dir), backbone(spark, sf_dir), "rgb")
    w = color.ramp(F.col("dist"), 0.03)
    return t.select(
        "pid", F.round("dist", 9).alias("dist"),
        *(F.round(color.clip(color.blend(F.col(f"near_{c}"), g, w)), 9).alias(c) for c, g in zip("rgb", color.NEUTRAL)),
        (F.col("dist") <= 0.03).alias("observed"),
    )


_W = "greatest(0, least(1, (nn.dist - CAST(0.03 AS DOUBLE)) / (2 * CAST(0.03 AS DOUBLE))))"
TRANSFER_SQL = f"""
WITH {_NEAR}
SELECT nn.pid, round(nn.dist, 9) AS dist,
{", ".join(f"round(greatest(0, least(1, bb.{c} * (1 - {_W}) + CAST({g} AS DOUBLE) * {_W})), 9) AS {c}" for c, g in zip("rgb", color.NEUTRAL))},
       nn.dist <= CAST(0.03 AS DOUBLE) AS observed
FROM nn JOIN bb ON bb.pid = nn.near
"""

RADIUS = 0.04


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return graph.label_all(p.select("pid"), nn.pairs_within(p, RADIUS)).select("pid", "component")


_CC = f"""
p AS MATERIALIZED (SELECT * FROM (WITH {PARTS_SQL} SELECT * FROM p)),
e AS MATERIALIZED (SELECT a.pid AS a, b.pid AS b FROM p a JOIN p b ON a.pid <> b.pid AND {dist_sql("a", "b")} <= CAST({RADIUS} AS DOUBLE)),
walk AS (SELECT pid AS a, pid AS b FROM p UNION SELECT w.a, e.b FROM walk w JOIN e ON w.b = e.a),
cc AS (SELECT a AS pid, min(b) AS component FROM walk GROUP BY a)
"""
COMPONENTS_SQL = f"WITH RECURSIVE {_CC} SELECT pid, component FROM cc"


def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest component by count and by the sum of a size."""
    p = points(spark, sf_dir)
    c = scratch.table(graph.label_all(p.select("pid", F.abs("s0").alias("area")), nn.pairs_within(p, RADIUS)), "labels")
    t = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    best = lambda v: F.max_by("component", F.struct(v, (-F.col("component")).alias("neg")))
    return t.agg(best("n").alias("by_count"), F.max("n").alias("count"), best("area").alias("by_area"), F.round(F.max("area"), 6).alias("area"))


LARGEST_SQL = f"""
WITH RECURSIVE {_CC},
t AS (SELECT component, count(*) AS n, sum(abs(p.s0)) AS area FROM cc JOIN p USING (pid) GROUP BY component)
SELECT (SELECT component FROM t ORDER BY n DESC, component LIMIT 1) AS by_count, max(n) AS count,
       (SELECT component FROM t ORDER BY area DESC, component LIMIT 1) AS by_area, round(max(area), 6) AS area FROM t
"""


def _triangles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A triangle of each point with its two nearest others."""
    p = points(spark, sf_dir)
    n = nn.k_nearest(p, p, 2, skip_self=True).groupBy("qid").pivot("rank", [1, 2]).agg(F.first("pid"))
    return n.select(F.col("qid").alias("tid"), F.col("qid").alias("a"), F.col("1").alias("b"), F.col("2").alias("c")), p.withColumnRenamed("pid", "vid")


def mesh_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, vertices = _triangles(spark, sf_dir)
    raw = scratch.table(raw, "raw")
    t = scratch.table(mesh.clean_triangles(raw), "clean")
    used, kept = mesh.drop_unreferenced(t, vertices.where("label < 9"))
    w = mesh.watertight(t)
    counts = raw.agg(F.count(F.lit(1)).alias("raw_triangles"))
    counts = counts.join(t.agg(F.count(F.lit(1)).alias("triangles")), F.lit(True)).join(kept.agg(F.count(F.lit(1)).alias("vertices")), F.lit(True))
    counts = counts.join(used.agg(F.count(F.lit(1)).alias("kept_triangles")), F.lit(True))
    return counts.join(w, F.lit(True)).select("raw_triangles", "triangles", "vertices", "kept_triangles", "edges", "open_edges", "watertight")


_TRI = f"""
{PARTS_SQL},
r AS (SELECT a.pid, b.pid AS near, row_number() OVER (PARTITION BY a.pid ORDER BY {dist_sql("a", "b")}, b.pid) AS rn
      FROM p a JOIN p b ON a.pid <> b.pid),
raw AS (SELECT pid AS tid, pid AS a, max(CASE WHEN rn = 1 THEN near END) AS b, max(CASE WHEN rn = 2 THEN near END) AS c FROM r WHERE rn <= 2 GROUP BY pid),
clean AS (SELECT tid, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY list_sort([a, b, c]) ORDER BY tid) AS rn FROM raw
          WHERE a <> b AND b <> c AND c <> a) WHERE rn = 1)
"""
MESH_SQL = f"""
WITH {_TRI},
v AS (SELECT pid FROM p WHERE label < 9),
used AS (SELECT DISTINCT unnest([a, b, c]) AS pid FROM clean),
eg AS (SELECT least(u, w) AS u, greatest(u, w) AS w, count(*) AS n FROM
        (SELECT a AS u, b AS w FROM clean UNION ALL SELECT b, c FROM clean UNION ALL SELECT c, a FROM clean) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM raw) AS raw_triangles, (SELECT count(*) FROM clean) AS triangles,
       (SELECT count(*) FROM v WHERE pid IN (SELECT pid FROM used)) AS vertices,
       (SELECT count(*) FROM clean WHERE a IN (SELECT pid FROM v) AND b IN (SELECT pid FROM v) AND c IN (SELECT pid FROM v)) AS kept_triangles,
       count(*) AS edges, count(CASE WHEN n <> 2 THEN 1 END) AS open_edges, count(CASE WHEN n <> 2 THEN 1 END) = 0 AS watertight FROM eg
"""


def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = _triangles(spark, sf_dir)
    t = scratch.table(mesh.clean_triangles(t), "clean")
    return mesh.vertex_normals(t, v.select("vid", "x", "y", "z")).select(F.col("vid").alias("pid"), *(F.round(f"n{c}", 5).alias(f"n{c}") for c in "xyz"))


def _cross_sql(i: int, j: int, k: str) -> str:
    c = "xyz"
    return f"((b.{c[i]} - a.{c[i]}) * (c.{c[j]} - a.{c[j]}) - (b.{c[j]} - a.{c[j]}) * (c.{c[i]} - a.{c[i]})) AS n{k}"


_VN = f"""
{_TRI},
f AS (SELECT t.a AS va, t.b AS vb, t.c AS vc, {_cross_sql(1, 2, "x")}, {_cross_sql(2, 0, "y")}, {_cross_sql(0, 1, "z")}
      FROM clean t JOIN p a ON a.pid = t.a JOIN p b ON b.pid = t.b JOIN p c ON c.pid = t.c),
e AS (SELECT unnest([va, vb, vc]) AS pid, nx, ny, nz FROM f),
s AS (SELECT pid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM e GROUP BY pid),
u AS (SELECT pid, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM s),
vn AS (SELECT p.pid, coalesce(CASE WHEN l > 0 THEN u.nx / l ELSE 0 END, 0) AS nx, coalesce(CASE WHEN l > 0 THEN u.ny / l ELSE 0 END, 0) AS ny,
       coalesce(CASE WHEN l > 0 THEN u.nz / l ELSE 0 END, 0) AS nz, p.x, p.y, p.z FROM p LEFT JOIN u ON u.pid = p.pid)
"""
NORMALS_SQL = f"WITH {_VN} SELECT pid, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz FROM vn"


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t, v = _triangles(spark, sf_dir)
    return scratch.table(mesh.clean_triangles(t), "clean"), v


def back_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = _mesh(spark, sf_dir)
    seen = mesh.cull_back_faces(t, mesh.vertex_normals(t, v.select("vid", "x", "y", "z")), (0.1, 0.2, 2.0))
    return seen.select("tid", F.round("facing", 5).alias("facing"), F.round("shade", 5).alias("shade"))


def _mean3(c: str) -> str:
    return f"(a.{c} + b.{c} + c.{c}) / 3"


BACK_FACE_SQL = f"""
WITH {_VN},
m AS (SELECT t.tid, {_mean3("nx")} AS nx, {_mean3("ny")} AS ny, {_mean3("nz")} AS nz, CAST(0.1 AS DOUBLE) - {_mean3("x")} AS ex, CAST(0.2 AS DOUBLE) - {_mean3("y")} AS ey, 2 - {_mean3("z")} AS ez
      FROM clean t JOIN vn a ON a.pid = t.a JOIN vn b ON b.pid = t.b JOIN vn c ON c.pid = t.c),
g AS (SELECT tid, (nx * ex + ny * ey + nz * ez) / greatest(sqrt(ex * ex + ey * ey + ez * ez), CAST(1e-9 AS DOUBLE)) AS facing FROM m)
SELECT tid, round(facing, 5) AS facing, round(greatest(CAST(0.15 AS DOUBLE), least(1, facing)), 5) AS shade FROM g WHERE facing > 0
"""


def largest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of the largest cluster by area and by count."""
    t, v = _mesh(spark, sf_dir)
    return (
        mesh.largest_component(t, v, "area").select("tid", F.lit("area").alias("by"))
        .unionByName(mesh.largest_component(t, v, "count").select("tid", F.lit("count").alias("by")))
    )


LARGEST_CLUSTER_SQL = f"""
WITH RECURSIVE tri AS MATERIALIZED (SELECT * FROM (WITH {_TRI} SELECT clean.*, sqrt(cx * cx + cy * cy + cz * cz) / 2 AS area FROM clean JOIN (
   SELECT t.tid AS k, {_cross_sql(1, 2, "x").replace("AS nx", "AS cx")}, {_cross_sql(2, 0, "y").replace("AS ny", "AS cy")}, {_cross_sql(0, 1, "z").replace("AS nz", "AS cz")}
   FROM clean t JOIN p a ON a.pid = t.a JOIN p b ON b.pid = t.b JOIN p c ON c.pid = t.c) ON k = tid)),
eg AS (SELECT tid, least(u, w) AS u, greatest(u, w) AS w FROM (SELECT tid, a AS u, b AS w FROM tri UNION ALL SELECT tid, b, c FROM tri UNION ALL SELECT tid, c, a FROM tri)),
ad AS MATERIALIZED (SELECT DISTINCT x.tid AS s, y.tid AS t FROM eg x JOIN eg y ON x.u = y.u AND x.w = y.w AND x.tid <> y.tid),
walk AS (SELECT tid AS s, tid AS t FROM tri UNION SELECT walk.s, ad.t FROM walk JOIN ad ON ad.s = walk.t),
cc AS MATERIALIZED (SELECT s AS tid, min(t) AS component FROM walk GROUP BY s),
sz AS (SELECT component, count(*) AS n, sum(area) AS area FROM cc JOIN tri USING (tid) GROUP BY component)
SELECT tid, 'area' AS by FROM cc WHERE component = (SELECT component FROM sz ORDER BY area DESC, component LIMIT 1)
UNION ALL SELECT tid, 'count' FROM cc WHERE component = (SELECT component FROM sz ORDER BY n DESC, component LIMIT 1)
"""


def trim_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles left by a density trim, and triangles whose vertices were put on a coarse lattice and merged."""
    t, v = _mesh(spark, sf_dir)
    trimmed, kept = mesh.trim_density(t, v.withColumn("density", F.col("r")), 0.1)
    coarse = v.select("vid", *(F.round(c, 1).alias(c) for c in "xyz"))
    merged, left = mesh.merge_duplicate_vertices(t, coarse)
    return (
        trimmed.select(F.lit("trim").alias("kind"), "tid", "a", "b", "c")
        .unionByName(kept.select(F.lit("kept").alias("kind"), F.col("vid").alias("tid"), *(F.lit(0).cast("long").alias(k) for k in "abc")))
        .unionByName(merged.select(F.lit("merge").alias("kind"), "tid", "a", "b", "c"))
        .unionByName(left.select(F.lit("left").alias("kind"), F.col("vid").alias("tid"), *(F.lit(0).cast("long").alias(k) for k in "abc")))
    )


TRIM_MERGE_SQL = f"""
WITH {_TRI},
k AS (SELECT pid FROM p WHERE r >= (SELECT quantile_cont(r, 0.1) FROM p)),
l AS (SELECT pid, round(x, 1) + 0 AS x, round(y, 1) + 0 AS y, round(z, 1) + 0 AS z FROM p),
g AS (SELECT x, y, z, min(pid) AS t FROM l GROUP BY x, y, z),
m AS (SELECT l.pid, g.t FROM l JOIN g ON g.x = l.x AND g.y = l.y AND g.z = l.z)
SELECT 'trim' AS kind, tid, a, b, c FROM clean WHERE a IN (SELECT pid FROM k) AND b IN (SELECT pid FROM k) AND c IN (SELECT pid FROM k)
UNION ALL SELECT 'kept', pid, 0, 0, 0 FROM k
UNION ALL SELECT 'merge', tid, x.t, y.t, z.t FROM clean JOIN m x ON x.pid = a JOIN m y ON y.pid = b JOIN m z ON z.pid = c
UNION ALL SELECT 'left', t, 0, 0, 0 FROM g
"""


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of vertex clustering: cell means with colours, and the triangles that are left."""
    t, v = _mesh(spark, sf_dir)
    faces, cells = mesh.cluster_vertices(t, v.select("vid", *"xyz", *"rgb"), 0.2, (-1.0, -1.0, -1.0))
    zero = [F.lit(0).cast("long").alias(k) for k in "abc"]
    return (
        cells.select(F.lit("v").alias("kind"), F.col("vid").alias("id"), *zero, *(F.round(c, 8).alias(c) for c in ("x", "y", "z", "r")))
        .unionByName(faces.select(F.lit("t").alias("kind"), F.col("tid").alias("id"), "a", "b", "c", *(F.lit(0.0).alias(c) for c in ("x", "y", "z", "r"))))
    )


_CELL = ", ".join(f"CAST(floor(({c} + 1) / CAST(0.2 AS DOUBLE)) AS BIGINT) AS i{c}" for c in "xyz")
CLUSTER_SQL = f"""
WITH {_TRI},
q AS (SELECT *, {_CELL} FROM p),
g AS (SELECT ix, iy, iz, min(pid) AS t, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(r) AS r FROM q GROUP BY ix, iy, iz),
m AS (SELECT q.pid, g.t FROM q JOIN g ON g.ix = q.ix AND g.iy = q.iy AND g.iz = q.iz),
n AS (SELECT tid, x.t AS a, y.t AS b, z.t AS c FROM clean JOIN m x ON x.pid = a JOIN m y ON y.pid = b JOIN m z ON z.pid = c),
o AS (SELECT *, row_number() OVER (PARTITION BY list_sort([a, b, c]) ORDER BY tid) AS rn FROM n WHERE a <> b AND b <> c AND c <> a)
SELECT 'v' AS kind, t AS id, 0 AS a, 0 AS b, 0 AS c, round(x, 8) AS x, round(y, 8) AS y, round(z, 8) AS z, round(r, 8) AS r FROM g
UNION ALL SELECT 't', tid, a, b, c, 0, 0, 0, 0 FROM o WHERE rn = 1
"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = nn.nearest(donor(spark, sf_dir), backbone(spark, sf_dir))
    return metrics.observed_share(d, 0.03).select("observed", "unobserved", F.round("observed_pct", 8).alias("observed_pct"))


OBSERVED_SQL = f"""
WITH {_NEAR}
SELECT count(CASE WHEN dist <= CAST(0.03 AS DOUBLE) THEN 1 END) AS observed, count(CASE WHEN NOT dist <= CAST(0.03 AS DOUBLE) THEN 1 END) AS unobserved,
       round(100 * avg(CASE WHEN dist <= CAST(0.03 AS DOUBLE) THEN 1 ELSE 0 END), 8) AS observed_pct FROM nn
"""

QUERIES = {
    "q05_nn_distance": nn_distance,
    "q05b_knn_grid": nn_grid,
    "q06_nn_diagnostics": nn_diagnostics,
    "q07_gap_fill": gap_fill,
    "q08_consensus_cloud": consensus,
    "q09_multi_donor_void_fill": void_fill,
    "q13_color_transfer": transfer,
    "q27_components": components,
    "q27b_largest_component": largest,
    "q28_mesh_clean": mesh_clean,
    "q28b_vertex_normals": vertex_normals,
    "q28c_back_faces": back_faces,
    "q28d_largest_cluster": largest_cluster,
    "q28e_trim_and_merge": trim_and_merge,
    "q28f_vertex_clustering": clustered,
    "q13b_observed_share": observed,
}
ORACLE_SQL = {
    "q05_nn_distance": NN_SQL,
    "q05b_knn_grid": NN_GRID_SQL,
    "q06_nn_diagnostics": DIAG_SQL,
    "q07_gap_fill": GAP_SQL,
    "q08_consensus_cloud": CONSENSUS_SQL,
    "q09_multi_donor_void_fill": VOID_SQL,
    "q13_color_transfer": TRANSFER_SQL,
    "q27_components": COMPONENTS_SQL,
    "q27b_largest_component": LARGEST_SQL,
    "q28_mesh_clean": MESH_SQL,
    "q28b_vertex_normals": NORMALS_SQL,
    "q28c_back_faces": BACK_FACE_SQL,
    "q28d_largest_cluster": LARGEST_CLUSTER_SQL,
    "q28e_trim_and_merge": TRIM_MERGE_SQL,
    "q28f_vertex_clustering": CLUSTER_SQL,
    "q13b_observed_share": OBSERVED_SQL,
}
