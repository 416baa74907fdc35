"""Geometry queries: rigid chains, cameras, paths, verdicts, volumes, visibility."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import camera, linalg
from lumenfold.operators import cloud, trajectory, volume

from .tables import POINTS_SQL, points, read

P = f"p AS ({POINTS_SQL})"
XYZ = "xyz"
D = "CAST({} AS DOUBLE)".format


def rigid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal turned to the vertical, the same turn on the point, the capture-to-reconstruction axes, a
    translation and its inverse, and the floor at zero."""
    p = linalg.with_alignment(points(spark, sf_dir), [F.col(f"n{c}") for c in XYZ], (0.0, 0.0, 1.0))
    r = linalg.columns_matrix()
    turned = linalg.rotate(r, [F.col(c) for c in XYZ])
    p = p.withColumns({f"t{c}": t for c, t in zip(XYZ, turned)})
    axes = linalg.rotate(linalg.CAPTURE_TO_RECON, [F.col(f"t{c}") for c in XYZ])
    m = [[*row, t] for row, t in zip(linalg.RX_PLUS_90, (0.1, -0.2, 0.3))]
    p = p.withColumns({f"m{c}": v for c, v in zip(XYZ, linalg.apply_rigid(m, axes))})
    back = linalg.apply_rigid(linalg.rigid_inverse(m), [F.col(f"m{c}") for c in XYZ])
    q = linalg.quaternion_of(r)
    rows = p.select("pid", *(F.col(f"m{c}").alias(c) for c in XYZ), *(c.alias(f"u{n}") for c, n in zip(back, XYZ)), *(c.alias(f"q{n}") for c, n in zip(q, "wxyz")))
    rows = cloud.floor_drop(rows, "y")
    return rows.select("pid", *(F.round(c, 7).alias(c) for c in (*XYZ, "ux", "uy", "uz", "qw")), *(F.round(F.abs(f"q{c}"), 6).alias(f"q{c}") for c in XYZ))


RIGID_SQL = f"""
WITH {P},
k AS (SELECT pid, x, y, z, ny AS v0, -nx AS v1, nz AS c FROM p),
t AS (SELECT pid, c, v0, v1,
   (1 - v1 * v1 / (1 + c)) * x + (v0 * v1 / (1 + c)) * y + v1 * z AS tx,
   (v0 * v1 / (1 + c)) * x + (1 - v0 * v0 / (1 + c)) * y - v0 * z AS ty,
   -v1 * x + v0 * y + (1 - (v0 * v0 + v1 * v1) / (1 + c)) * z AS tz FROM k),
a AS (SELECT pid, c, v0, v1, tx AS ax, tz AS ay, -ty AS az FROM t),
m AS (SELECT pid, ax + {D(0.1)} AS x, -az - {D(0.2)} AS y, ay + {D(0.3)} AS z, ax AS ux, ay AS uy, az AS uz,
             sqrt((1 + c) / 2) AS qw, v0 / (2 * sqrt((1 + c) / 2)) AS qx, v1 / (2 * sqrt((1 + c) / 2)) AS qy FROM a),
f AS (SELECT quantile_cont(y, 0.01) AS f FROM m)
SELECT pid, round(x, 7) AS x, round(y - f, 7) AS y, round(z, 7) AS z, round(ux, 7) AS ux, round(uy, 7) AS uy, round(uz, 7) AS uz,
       round(qw, 7) AS qw, round(abs(qx), 6) AS qx, round(abs(qy), 6) AS qy, {D(0)} AS qz FROM m, f
"""


def up_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean up-direction of the normals, cloud aligned to it, low percentile at zero, summary of the result."""
    p = points(spark, sf_dir)
    up = p.agg(*(F.avg(-F.col(f"n{c}")).alias(f"u{c}") for c in XYZ))
    turn = linalg.with_alignment(up, [F.col(f"u{c}") for c in XYZ], (0.0, 1.0, 0.0), parallel="cross")
    rows = p.join(F.broadcast(turn), F.lit(True))
    turned = linalg.rotate(linalg.columns_matrix(), [F.col(c) for c in XYZ])
    out = cloud.floor_drop(rows.select("pid", *(t.alias(c) for t, c in zip(turned, XYZ))), "y")
    return out.select("pid", *(F.round(c, 6).alias(c) for c in XYZ))


UP_SQL = f"""
WITH {P}, u AS (SELECT avg(-nx) AS ux, avg(-ny) AS uy, avg(-nz) AS uz FROM p),
n AS (SELECT ux / l AS ax, uy / l AS ay, uz / l AS az FROM (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS l FROM u)),
k AS (SELECT pid, x, y, z, -az AS v0, ax AS v2, ay AS c FROM p, n),
t AS (SELECT pid,
  (1 - v2 * v2 / (1 + c)) * x + (-v2) * y + (v0 * v2 / (1 + c)) * z AS x,
  v2 * x + (1 - (v0 * v0 + v2 * v2) / (1 + c)) * y + (-v0) * z AS y,
  (v0 * v2 / (1 + c)) * x + v0 * y + (1 - v0 * v0 / (1 + c)) * z AS z FROM k),
f AS (SELECT quantile_cont(y, 0.01) AS f FROM t)
SELECT pid, round(x, 6) AS x, round(y - f, 6) AS y, round(z, 6) AS z FROM t, f
"""

W_, H_, HFOV = 64, 48, 70.0


def backproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth pixels (from a point's first components and label) to world points of a turned camera."""
    p = points(spark, sf_dir)
    k = camera.intrinsics_from_hfov(HFOV, W_, H_)
    k["cx"] = camera.clamp_principal(k["cx"] + 40, W_)
    px = volume.valid_depth(p.select("pid", (F.col("r") * W_).alias("u"), (F.col("g") * H_).alias("v"), (F.col("label") * 1.0 + F.col("b")).alias("depth")))
    c2w = [[*row, t] for row, t in zip(linalg.RX_PLUS_90, (1.0, 2.0, 3.0))]
    world = camera.backproject(F.col("u"), F.col("v"), F.col("depth"), k, c2w)
    again = camera.project(world, k, linalg.rigid_inverse(c2w))
    rows = px.select("pid", "u", "v", "depth", *(w.alias(c) for w, c in zip(world, XYZ)), *(a.alias(n) for a, n in zip(again, ("pu", "pv", "pd"))))
    return rows.select("pid", *(F.round(c, 6).alias(c) for c in (*XYZ, "pu", "pv", "pd")))


_F = D(W_ / 2) + f" / tan({D(HFOV)} * {D(repr(math.pi / 180))} / 2)"
BACKPROJECT_SQL = f"""
WITH {P}, i AS (SELECT {_F} AS f, greatest({D(0.5)}, least({D(W_ / 2 + 40)}, {D(W_ - 1.5)})) AS cx, {D(H_ / 2)} AS cy),
d AS (SELECT pid, r * {W_} AS u, g * {H_} AS v, label * {D(1)} + b AS depth FROM p),
c AS (SELECT pid, u, v, depth, (u - cx) / f * depth AS x0, (v - cy) / f * depth AS y0 FROM d, i WHERE depth > {D(0.1)} AND depth < {D(8)})
SELECT pid, round(x0 + 1, 6) AS x, round(-depth + 2, 6) AS y, round(y0 + 3, 6) AS z, round(u, 6) AS pu, round(v, 6) AS pv, round(depth, 6) AS pd FROM c
"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path per user: positions from event values and ids in time order."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("traj"), "ts", "event_id", "value")
    i = (F.row_number().over(W.partitionBy("traj").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select("traj", i.alias("step"), F.col("value").alias("x"), (F.col("event_id") % 17).cast("double").alias("y"), (F.col("value") * 0.5).alias("z"))


_PATH = """
t AS (SELECT user_id AS traj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value AS x,
             CAST(event_id % 17 AS DOUBLE) AS y, value * CAST(0.5 AS DOUBLE) AS z FROM events)
"""


def arc_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = trajectory.heading(trajectory.arc_length(trajectory.trim_stride(_paths(spark, sf_dir), 0.1, 0.9, 2)))
    return h.select("traj", "step", F.round("arc", 3).alias("arc"), F.round("t", 6).alias("t"), F.round("heading", 6).alias("heading"))


ARC_SQL = f"""
WITH {_PATH},
c AS (SELECT *, count(*) OVER (PARTITION BY traj) AS n FROM t),
k AS (SELECT * FROM c WHERE step >= floor(CAST(0.1 AS DOUBLE) * n) AND step < floor(CAST(0.9 AS DOUBLE) * n) AND CAST(step - floor(CAST(0.1 AS DOUBLE) * n) AS BIGINT) % 2 = 0),
s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0) AS seg,
        coalesce(lead(x, 3) OVER w, last_value(x) OVER (PARTITION BY traj ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS hx,
        coalesce(lead(y, 3) OVER w, last_value(y) OVER (PARTITION BY traj ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS hy
      FROM k WINDOW w AS (PARTITION BY traj ORDER BY step)),
a AS (SELECT *, sum(seg) OVER (PARTITION BY traj ORDER BY step ROWS UNBOUNDED PRECEDING) AS arc FROM s)
SELECT traj, step, round(arc, 3) AS arc, round(CASE WHEN max(arc) OVER (PARTITION BY traj) > 0 THEN arc / max(arc) OVER (PARTITION BY traj) ELSE 0 END, 6) AS t,
       round(atan2(hy - y, hx - x), 6) AS heading FROM a
"""


def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.resample_linear(_paths(spark, sf_dir), 25).select("traj", "k", *(F.round(c, 8).alias(c) for c in XYZ))


RESAMPLE_SQL = f"""
WITH {_PATH}, n AS (SELECT traj, count(*) AS n FROM t GROUP BY traj),
u AS (SELECT traj, n, k, k * (CAST(n - 1 AS DOUBLE) / 24) AS u FROM n, (SELECT unnest(range(0, 25)) AS k)),
f AS (SELECT *, least(CAST(floor(u) AS BIGINT), n - 1) AS i FROM u)
SELECT f.traj, CAST(k AS INTEGER) AS k, round(a.x + coalesce(b.x - a.x, 0) * (u - i), 8) AS x, round(a.y + coalesce(b.y - a.y, 0) * (u - i), 8) AS y, round(a.z + coalesce(b.z - a.z, 0) * (u - i), 8) AS z
FROM f JOIN t a ON a.traj = f.traj AND a.step = i LEFT JOIN t b ON b.traj = f.traj AND b.step = i + 1
"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights that settle differently by user, judged as drop and as stand."""
    s = _paths(spark, sf_dir).withColumn("z", F.when(F.col("traj") % 4 == 0, F.col("z") * 0 + 0.12).when(F.col("traj") % 4 == 1, F.lit(-0.5)).when(F.col("traj") % 4 == 2, F.lit(-2.0)).otherwise(F.col("z")))
    a = trajectory.settle_verdict(s, 0.12)
    b = trajectory.stand_verdict(s, 10)
    out = a.join(b.select("traj", F.col("settled").alias("held"), "dx", "stood", F.col("moved").alias("walked")), "traj")
    return out.select("traj", *(F.round(c, 6).alias(c) for c in ("start", "least", "final", "settled")), "verdict", F.round("held", 6).alias("held"), F.round("dx", 6).alias("dx"), "stood", "walked")


def _at(cond: str, col: str) -> str:
    return f"max(CASE WHEN {cond} THEN {col} END)"


VERDICT_SQL = f"""
WITH {_PATH},
s AS (SELECT traj, step, x, CASE WHEN traj % 4 = 0 THEN z * 0 + {D(0.12)} WHEN traj % 4 = 1 THEN {D(-0.5)} WHEN traj % 4 = 2 THEN {D(-2)} ELSE z END AS z FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY step DESC) AS b FROM s),
g AS (SELECT traj, {_at("step = 0", "z")} AS start, min(z) AS least, {_at("b = 1", "z")} AS final, median(CASE WHEN b <= 25 THEN z END) AS settled,
             abs({_at("b = 1", "z")} - {_at("b = 10", "z")}) AS moved, median(CASE WHEN b <= 50 THEN z END) AS held,
             {_at("b = 1", "x")} - {_at("step = 10", "x")} AS dx FROM r GROUP BY traj)
SELECT traj, round(start, 6) AS start, round(least, 6) AS least, round(final, 6) AS final, round(settled, 6) AS settled,
  CASE WHEN settled < -1 THEN 'fell' WHEN settled < {D(-0.1)} THEN 'tunnelled' WHEN abs(settled - {D(0.12)}) < {D(0.06)} AND moved < {D(0.01)} THEN 'rested' ELSE 'partial' END AS verdict,
  round(held, 6) AS held, round(dx, 6) AS dx, held > {D(0.2)} AS stood, abs(dx) > {D(0.03)} AS walked FROM g
"""

VOX, TRUNC = 0.1, 0.2


def tsdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumns({"ox": F.lit(0.0), "oy": F.lit(0.0), "oz": F.lit(2.0), "weight": F.col("label") + 1.0})
    v = volume.tsdf(p, VOX, TRUNC)
    return v.select("ix", "iy", "iz", F.round("tsdf", 7).alias("tsdf"), F.round("weight", 6).alias("weight"), *(F.round(c, 7).alias(c) for c in "rgb"))


TSDF_SQL = f"""
WITH {P}, l AS (SELECT *, x AS dx, y AS dy, z - 2 AS dz, label + {D(1)} AS w FROM p),
n AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len FROM l),
s AS (SELECT n.*, st.s AS st FROM n, (SELECT unnest([-2, -1, 0, 1, 2]) AS s) st),
c AS (SELECT *, {", ".join(f"CAST(floor(({k} + st * {D(VOX)} * d{k} / len) / {D(VOX)}) AS BIGINT) AS i{k}" for k in XYZ)} FROM s),
d AS (SELECT *, (len - (((ix + {D(0.5)}) * {D(VOX)}) * dx / len + ((iy + {D(0.5)}) * {D(VOX)}) * dy / len + ((iz + {D(0.5)}) * {D(VOX)} - 2) * dz / len)) / {D(TRUNC)} AS f FROM c)
SELECT ix, iy, iz, round(sum(greatest(-1, least(1, f)) * w) / sum(w), 7) AS tsdf, round(sum(w), 6) AS weight,
       round(sum(r * w) / sum(w), 7) AS r, round(sum(g * w) / sum(w), 7) AS g, round(sum(b * w) / sum(w), 7) AS b FROM d GROUP BY ix, iy, iz
"""

_CAMS = [(0, ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 1))), (1, ((1, 0, 0, 0), (0, -1, 0, 0), (0, 0, -1, 1))), (2, ((0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 1))), (3, ((0, 0, 1, 0), (0, 1, 0, 0), (-1, 0, 0, 1)))]


def cameras(spark: SparkSession) -> DataFrame:
    rows = [(v, 30.0, 30.0, 32.0, 24.0, W_, H_, [[float(x) for x in r] for r in m]) for v, m in _CAMS]
    return spark.createDataFrame(rows, "view int, fx double, fy double, cx double, cy double, width int, height int, w2c array<array<double>>")


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    seen = volume.visible(p, cameras(spark), 0.02).select("pid", F.lit(True).alias("v"))
    return volume.coverage(p, cameras(spark)).join(seen, "pid", "left").select("pid", "views", F.coalesce("v", F.lit(False)).alias("visible"))


def _cam_sql(v: int, m) -> str:
    row = lambda r: " + ".join(f"{D(r[k])} * {c}" for k, c in enumerate(XYZ)) + f" + {D(r[3])}"
    return f"SELECT {v} AS view, pid, {row(m[0])} AS a, {row(m[1])} AS b, {row(m[2])} AS depth FROM p"


VISIBILITY_SQL = f"""
WITH {P}, c AS ({" UNION ALL ".join(_cam_sql(v, m) for v, m in _CAMS)}),
i AS (SELECT view, pid, depth, 30 * a / depth + 32 AS u, 30 * b / depth + 24 AS v FROM c WHERE depth > {D(1e-9)}),
s AS (SELECT *, CAST(floor(u) AS BIGINT) AS px, CAST(floor(v) AS BIGINT) AS py FROM i WHERE u >= 0 AND v >= 0 AND u < {W_} AND v < {H_}),
z AS (SELECT view, px, py, min(depth) AS front FROM s GROUP BY view, px, py),
o AS (SELECT DISTINCT s.pid FROM s JOIN z ON z.view = s.view AND z.px = s.px AND z.py = s.py WHERE s.depth <= z.front + {D(0.02)})
SELECT p.pid, (SELECT count(*) FROM s WHERE s.pid = p.pid) AS views, p.pid IN (SELECT pid FROM o) AS visible FROM p
"""


def orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circling cameras about the cloud and eyes inside its box."""
    p = points(spark, sf_dir)
    a = trajectory.orbit(spark, 36, 2.0, 0.5).select(F.lit("orbit").alias("kind"), "k", *XYZ)
    b = trajectory.interior_eyes(cloud.bounding_box(p)).select(F.lit("inside").alias("kind"), F.col("eye").alias("k"), *XYZ)
    return a.unionByName(b).select("kind", F.col("k").cast("int").alias("k"), *(F.round(c, 7).alias(c) for c in XYZ))


ORBIT_SQL = f"""
WITH {P}, b AS (SELECT {", ".join(f"min({c}) AS l{c}, max({c}) AS h{c}" for c in XYZ)} FROM p)
SELECT 'orbit' AS kind, CAST(k AS INTEGER) AS k, round(cos(k * {D(repr(2 * math.pi / 36))}) * 2, 7) AS x, round(sin(k * {D(repr(2 * math.pi / 36))}) * 2, 7) AS y, {D(0.5)} AS z FROM (SELECT unnest(range(0, 36)) AS k)
UNION ALL SELECT 'inside', CAST(e AS INTEGER), round((lx + hx) / 2 + sx * {D(0.45)} * (hx - lx), 7), round((ly + hy) / 2, 7), round((lz + hz) / 2 + sz * {D(0.45)} * (hz - lz), 7)
FROM b, (VALUES (0, 1, 1), (1, 1, -1), (2, -1, 1), (3, -1, -1)) t(e, sx, sz)
"""

QUERIES = {
    "q21_rigid_transform": rigid,
    "q22_up_floor": up_floor,
    "q24_backproject": backproject,
    "q25_arc_heading": arc_heading,
    "q25b_resample": resample,
    "q26_verdicts": verdicts,
    "q30_tsdf_voxel_mean": tsdf,
    "q31_visibility_cull": visibility,
    "q34_orbit_cameras": orbit,
}
ORACLE_SQL = {
    "q21_rigid_transform": RIGID_SQL,
    "q22_up_floor": UP_SQL,
    "q24_backproject": BACKPROJECT_SQL,
    "q25_arc_heading": ARC_SQL,
    "q25b_resample": RESAMPLE_SQL,
    "q26_verdicts": VERDICT_SQL,
    "q30_tsdf_voxel_mean": TSDF_SQL,
    "q31_visibility_cull": VISIBILITY_SQL,
    "q34_orbit_cameras": ORBIT_SQL,
}
