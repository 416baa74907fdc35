"""Mesh queries: quadric edge collapse, holes, normals carried along a spanning forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import scratch
from lumenfold.operators import collapse, holes, mesh, nn, orient

from .q_surface import _TRI, _mesh
from .tables import POINTS_SQL, dist_sql, points
from .tables import frames as clip

D = "CAST({} AS DOUBLE)".format
XYZ = "xyz"
ROW = 20  # frames of a clip that make a row of the grid

# ---------------------------------------------------------------- a grid of clips and frames


def _grid(spark: SparkSession, sf_dir: str, closed: bool) -> tuple[DataFrame, DataFrame]:
    """(triangles, vertices): a vertex for each of a clip's first frames, its height their value; ``closed`` joins the
    last clip and frame to the first ones."""
    v = clip(spark, sf_dir).where(F.col("frame_idx") < ROW)
    v = scratch.table(v.select((F.col("video") * ROW + F.col("frame_idx")).alias("vid"), F.col("video").cast("double").alias("x"), F.col("frame_idx").cast("double").alias("y"), (F.col("signal") / 200).alias("z")), "grid")
    n = F.broadcast(v.agg((F.max("x") + 1).cast("long").alias("n")))
    cell = v.join(n, F.lit(True)).select("vid", "n", (F.col("vid") / ROW).cast("long").alias("i"), (F.col("vid") % ROW).alias("j"))
    if not closed:
        cell = cell.where(f"i < n - 1 and j < {ROW - 1}")
    at = lambda i, j: (F.col("i") + i) % F.col("n") * ROW + (F.col("j") + j) % ROW
    pair = F.explode(F.array(*(F.struct((F.col("vid") * 2 + k).alias("tid"), at(0, 0).alias("a"), b.alias("b"), c.alias("c")) for k, (b, c) in enumerate(((at(1, 0), at(1, 1)), (at(1, 1), at(0, 1)))))))
    return scratch.table(cell.select(pair.alias("t")).select("t.*"), "cells"), v


# ---------------------------------------------------------------- edge collapse


def quadrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of a mesh with the place and cost of its collapse."""
    t, v = _mesh(spark, sf_dir)
    e = collapse.edge_costs(t, collapse.vertex_quadrics(t, v.select("vid", *XYZ)))
    return e.select("u", "v", "faces", *(F.round(f"p_{c}", 5).alias(f"p_{c}") for c in XYZ), F.round(F.col("cost") * 1e6, 3).alias("cost"))


def _outer(n: tuple[str, ...], w: str) -> str:
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    return ", ".join(f"{w} * {n[i]} * {n[j]} AS q{k}" for k, (i, j) in enumerate(pairs))


def _cost_sql(x: str, y: str, z: str) -> str:
    return f"({x} * (q0 * {x} + 2 * (q1 * {y} + q2 * {z} + q3)) + {y} * (q4 * {y} + 2 * (q5 * {z} + q6)) + {z} * (q7 * {z} + 2 * q8) + q9)"


def _side(i: str, j: str) -> str:
    ends = ", ".join(f"{i}{c} AS s{c}, {j}{c} AS e{c}" for c in XYZ)
    return f"SELECT least(v{i}, v{j}) AS u, greatest(v{i}, v{j}) AS v, nx, ny, nz, {ends} FROM f"


_QS = ", ".join(f"sum(q{k}) AS q{k}" for k in range(10))
_PULL = [f"{D(collapse.PULL)} * area * {x}" for x in ("1", "0", "0", "-p.x", "1", "0", "-p.y", "1", "-p.z", "(p.x * p.x + p.y * p.y + p.z * p.z)")]
QUADRIC_SQL = f"""
WITH {_TRI},
g AS (SELECT t.a AS va, t.b AS vk, t.c AS vc, a.x AS ax, a.y AS ay, a.z AS az, b.x AS kx, b.y AS ky, b.z AS kz, c.x AS cx, c.y AS cy, c.z AS cz
      FROM clean t JOIN p a ON a.pid = t.a JOIN p b ON b.pid = t.b JOIN p c ON c.pid = t.c),
w AS (SELECT *, (ky - ay) * (cz - az) - (kz - az) * (cy - ay) AS mx, (kz - az) * (cx - ax) - (kx - ax) * (cz - az) AS my, (kx - ax) * (cy - ay) - (ky - ay) * (cx - ax) AS mz FROM g),
f AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) / 2 AS area, mx / sqrt(mx * mx + my * my + mz * mz) AS nx, my / sqrt(mx * mx + my * my + mz * mz) AS ny, mz / sqrt(mx * mx + my * my + mz * mz) AS nz
      FROM w WHERE mx * mx + my * my + mz * mz > 0),
own AS (SELECT unnest([va, vk, vc]) AS pid, area, {_outer(("nx", "ny", "nz", "d"), "area")} FROM (SELECT *, -(nx * ax + ny * ay + nz * az) AS d FROM f)),
side AS ({_side("a", "k")} UNION ALL {_side("k", "c")} UNION ALL {_side("c", "a")}),
lone AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY u, v) AS n FROM side) WHERE n = 1),
up AS (SELECT u, v, sx, sy, sz, (ey - sy) * nz - (ez - sz) * ny AS ux, (ez - sz) * nx - (ex - sx) * nz AS uy, (ex - sx) * ny - (ey - sy) * nx AS uz FROM lone),
rim AS (SELECT unnest([u, v]) AS pid, {D(0)} AS area, {_outer(("ux", "uy", "uz", "d"), D(collapse.BORDER))} FROM (SELECT *, -(ux * sx + uy * sy + uz * sz) AS d FROM up)),
tot AS (SELECT pid, sum(area) AS area, {_QS} FROM (SELECT * FROM own UNION ALL SELECT * FROM rim) GROUP BY pid),
vq AS (SELECT p.pid, p.x, p.y, p.z, {", ".join(f"q{k} + {x} AS q{k}" for k, x in enumerate(_PULL))}
       FROM (SELECT p.pid, p.x, p.y, p.z, coalesce(area, 0) AS area, {", ".join(f"coalesce(q{k}, 0) AS q{k}" for k in range(10))} FROM p LEFT JOIN tot ON tot.pid = p.pid) p),
ed AS (SELECT least(i, j) AS u, greatest(i, j) AS v, count(*) AS faces FROM (SELECT a AS i, b AS j FROM clean UNION ALL SELECT b, c FROM clean UNION ALL SELECT c, a FROM clean) GROUP BY 1, 2),
eq AS (SELECT u, v, faces, a.x AS ux, a.y AS uy, a.z AS uz, b.x AS vx, b.y AS vy, b.z AS vz, {", ".join(f"a.q{k} + b.q{k} AS q{k}" for k in range(10))}
       FROM ed JOIN vq a ON a.pid = u JOIN vq b ON b.pid = v),
dt AS (SELECT *, q0 * (q4 * q7 - q5 * q5) + q1 * (q2 * q5 - q1 * q7) + q2 * (q1 * q5 - q2 * q4) AS det, (q0 + q4 + q7) / 3 AS t FROM eq),
op AS (SELECT *, (ux + vx) / 2 AS hx, (uy + vy) / 2 AS hy, (uz + vz) / 2 AS hz,
  CASE WHEN det > {D("1e-9")} * t * t * t THEN -((q4 * q7 - q5 * q5) * q3 + (q2 * q5 - q1 * q7) * q6 + (q1 * q5 - q2 * q4) * q8) / det END AS ox,
  CASE WHEN det > {D("1e-9")} * t * t * t THEN -((q2 * q5 - q1 * q7) * q3 + (q0 * q7 - q2 * q2) * q6 + (q1 * q2 - q0 * q5) * q8) / det END AS oy,
  CASE WHEN det > {D("1e-9")} * t * t * t THEN -((q1 * q5 - q2 * q4) * q3 + (q1 * q2 - q0 * q5) * q6 + (q0 * q4 - q1 * q1) * q8) / det END AS oz FROM dt),
pk AS (SELECT *, coalesce((ox - hx) * (ox - hx) + (oy - hy) * (oy - hy) + (oz - hz) * (oz - hz) <= (ux - vx) * (ux - vx) + (uy - vy) * (uy - vy) + (uz - vz) * (uz - vz), false) AS near,
  {_cost_sql("hx", "hy", "hz")} AS ch, {_cost_sql("ux", "uy", "uz")} AS cu, {_cost_sql("vx", "vy", "vz")} AS cv, {_cost_sql("ox", "oy", "oz")} AS cb FROM op),
ch AS (SELECT *, CASE WHEN near THEN 3 WHEN ch <= cu AND ch <= cv THEN 0 WHEN cu <= cv THEN 1 ELSE 2 END AS k FROM pk)
SELECT u, v, faces, {", ".join(f"round(CASE k WHEN 3 THEN o{c} WHEN 0 THEN h{c} WHEN 1 THEN u{c} ELSE v{c} END, 5) + 0 AS p_{c}" for c in XYZ)},
       round(greatest(0, CASE k WHEN 3 THEN cb WHEN 0 THEN ch WHEN 1 THEN cu ELSE cv END) * 1000000, 3) AS cost FROM ch
"""


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid brought to three quarters of its triangles: whether it kept to the budget, stayed one sheet without
    tangles, and is nearer to the old vertices than vertex clustering with the same budget."""
    t, v = _grid(spark, sf_dir, False)
    n = t.count()
    target = n * 3 // 4
    small, kept = collapse.collapse_edges(t, v, target)
    rough, cells = mesh.decimate_by_clustering(t, v, target)

    def middle_error(t: DataFrame, v: DataFrame) -> DataFrame:
        """Mean distance from the old vertices to the nearest vertex or middle of a triangle."""
        c = mesh.with_corners(t, v)
        spots = c.select(F.explode(F.array(*(F.struct(*(F.col(f"{k}_{x}").alias(x) for x in XYZ)) for k in "abc"), F.struct(*(((F.col(f"a_{x}") + F.col(f"b_{x}") + F.col(f"c_{x}")) / 3).alias(x) for x in XYZ)))).alias("p")).select("p.*").distinct()
        spots = scratch.table(spots.withColumn("pid", F.monotonically_increasing_id()), "spots")
        return nn.nearest(scratch.table(base, "base"), spots).agg(F.avg("dist").alias("d"))

    base = v.withColumnRenamed("vid", "pid")
    use = mesh.face_edges(small).groupBy("u", "v").count().agg(F.count(F.lit(1)).alias("edges"), F.max("count").alias("most"))
    used = small.select(F.explode(F.array("a", "b", "c")).alias("w")).agg(F.count_distinct("w").alias("vertices"))
    row = small.agg(F.count(F.lit(1)).alias("triangles")).join(use, F.lit(True)).join(used, F.lit(True))
    row = row.join(middle_error(small, kept).withColumnRenamed("d", "own"), F.lit(True)).join(middle_error(rough, cells).withColumnRenamed("d", "rough"), F.lit(True))
    return row.select(
        F.lit(n).cast("long").alias("before"), (F.col("triangles") <= target).alias("within"), (F.col("triangles") > target - 3).alias("not_below"),
        (F.col("vertices") - F.col("edges") + F.col("triangles")).alias("euler"), F.col("most").cast("long").alias("most"), (F.col("own") < F.col("rough")).alias("nearer"),
    )


COLLAPSED_SQL = f"""
SELECT (max(user_id) * {ROW - 1} * 2)::BIGINT AS before, true AS within, true AS not_below, 1::BIGINT AS euler, 2::BIGINT AS most, true AS nearer FROM events
"""

# ---------------------------------------------------------------- holes


def _punched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The closed grid without every fifth vertex of every fifth clip."""
    t, v = _grid(spark, sf_dir, True)
    gone = v.where(f"x % 5 = 2 and vid % {ROW} % 5 = 2").select("vid")
    for k in "abc":
        t = t.join(gone.select(F.col("vid").alias(k)), k, "left_anti")
    return scratch.table(t.select("tid", "a", "b", "c"), "punched"), v.join(gone, "vid", "left_anti")


def hole_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = _punched(spark, sf_dir)
    return holes.rings(t).select("hole", "place", "vid", "next", "size")


_AROUND = ((1, 0), (1, 1), (0, 1), (-1, 0), (-1, -1), (0, -1))
RINGS_SQL = f"""
WITH n AS (SELECT max(user_id) + 1 AS n FROM events),
r AS (SELECT DISTINCT user_id AS i, j, n FROM events, n, (SELECT unnest(range({ROW})) AS j) WHERE user_id % 5 = 2 AND j % 5 = 2),
s AS (SELECT i, j, k.k, (i + k.di + n) % n * {ROW} + (j + k.dj + {ROW}) % {ROW} AS vid FROM r, (VALUES {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(_AROUND))}) k(k, di, dj)),
m AS (SELECT i, j, min(vid) AS hole, arg_min(k, vid) AS k0 FROM s GROUP BY i, j)
SELECT hole, CAST((k - k0 + 6) % 6 AS BIGINT) AS place, vid, lead(vid, 1, hole) OVER (PARTITION BY i, j ORDER BY (k - k0 + 6) % 6) AS next, CAST(6 AS BIGINT) AS size
FROM s JOIN m USING (i, j)
"""


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = _punched(spark, sf_dir)
    opened = mesh.watertight(t).select(F.col("watertight").alias("before"))
    t, v = holes.fill_holes(t, v)
    t = scratch.table(t, "filled")
    used = t.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct().join(v, "vid").agg(F.count(F.lit(1)).alias("vertices"))
    row = mesh.watertight(t).join(t.agg(F.count(F.lit(1)).alias("triangles"), F.count_distinct("tid").alias("ids")), F.lit(True)).join(used, F.lit(True)).join(opened, F.lit(True))
    return row.select("before", "watertight", "triangles", "ids", "vertices", (F.col("vertices") - F.col("edges") + F.col("triangles")).alias("euler"))


FILLED_SQL = f"""
SELECT false AS before, true AS watertight, ((max(user_id) + 1) * {2 * ROW})::BIGINT AS triangles, ((max(user_id) + 1) * {2 * ROW})::BIGINT AS ids,
       ((max(user_id) + 1) * {ROW})::BIGINT AS vertices, 0::BIGINT AS euler FROM events
"""

# ---------------------------------------------------------------- normals


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the minimum spanning forest of every point's three nearest others."""
    edges, _ = orient.spanning_forest(orient.neighbour_edges(points(spark, sf_dir), 3))
    return edges.select("s", "t", "weight", "flip")


FOREST_SQL = f"""
WITH RECURSIVE p AS MATERIALIZED ({POINTS_SQL}),
r AS (SELECT a.pid, b.pid AS near, row_number() OVER (PARTITION BY a.pid ORDER BY {dist_sql("a", "b")}, b.pid) AS rn FROM p a JOIN p b ON a.pid <> b.pid),
d AS (SELECT DISTINCT least(pid, near) AS s, greatest(pid, near) AS t FROM r WHERE rn <= 3),
c AS (SELECT s, t, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz AS c FROM d JOIN p a ON a.pid = s JOIN p b ON b.pid = t),
e AS MATERIALIZED (SELECT s, t, CAST(round((1 - least(1, abs(c))) * 1000000000) AS BIGINT) AS weight, CAST(c < 0 AS INTEGER) AS flip FROM c),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight, s, t) AS k FROM e),
b AS MATERIALIZED (SELECT s, t, k FROM k UNION ALL SELECT t, s, k FROM k),
walk AS (SELECT k, s AS at FROM k UNION SELECT walk.k, b.t FROM walk JOIN b ON b.s = walk.at AND b.k < walk.k)
SELECT s, t, weight, flip FROM k WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.k = k.k AND walk.at = k.t)
"""


def oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's points lie on a plane of their own with normals of mixed signs, which come out looking up."""
    s = (F.col("label") - 4.5) * 0.1
    sign = F.when(F.xxhash64("pid") % 2 == 0, 1.0).otherwise(-1.0) / F.sqrt(1 + s * s)
    p = points(spark, sf_dir).select("pid", "x", "y", (s * F.col("x") + F.col("label") * 50.0).alias("z"), (-s * sign).alias("nx"), F.lit(0.0).alias("ny"), sign.alias("nz"))
    n = orient.orient_normals(p, 6)
    return n.select("pid", *(F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")))


ORIENTED_SQL = f"""
WITH p AS ({POINTS_SQL}), s AS (SELECT pid, (label - {D(4.5)}) * {D(0.1)} AS s FROM p)
SELECT pid, round(-s / sqrt(1 + s * s), 6) + 0 AS nx, {D(0)} AS ny, round(1 / sqrt(1 + s * s), 6) AS nz FROM s
"""

QUERIES = {
    "q70_edge_costs": quadrics,
    "q70b_edge_collapse": collapsed,
    "q71_spanning_forest": forest,
    "q71b_oriented_normals": oriented,
    "q72_hole_rings": hole_rings,
    "q72b_filled_holes": filled,
}
ORACLE_SQL = {
    "q70_edge_costs": QUADRIC_SQL,
    "q70b_edge_collapse": COLLAPSED_SQL,
    "q71_spanning_forest": FOREST_SQL,
    "q71b_oriented_normals": ORIENTED_SQL,
    "q72_hole_rings": RINGS_SQL,
    "q72b_filled_holes": FILLED_SQL,
}
