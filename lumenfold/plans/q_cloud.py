"""Cloud queries: voxels, crops, quantiles, outliers, samples, z-buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import camera, color
from lumenfold.operators import cloud, quantiles

from .tables import PARTS_SQL, POINTS_SQL, dist_sql, points, read

P = f"p AS ({POINTS_SQL})"
XYZ = "xyz"


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cloud.voxel_downsample(points(spark, sf_dir), 0.1, (*XYZ, "r"))
    return v.select("ix", "iy", "iz", "n", *(F.round(c, 9).alias(c) for c in (*XYZ, "r")))


VOXEL_SQL = f"""
WITH {P}, o AS (SELECT min(x) AS x, min(y) AS y, min(z) AS z FROM p),
c AS (SELECT {", ".join(f"CAST(floor((p.{k} - (o.{k} - CAST(0.05 AS DOUBLE))) / CAST(0.1 AS DOUBLE)) AS BIGINT) AS i{k}, p.{k} AS {k}" for k in XYZ)}, r FROM p, o)
SELECT ix, iy, iz, count(*) AS n, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, round(avg(r), 9) AS r FROM c GROUP BY ix, iy, iz
"""


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    a = cloud.crop_flyers(p, 0.9).select("pid", F.lit("flyer").alias("kind"))
    b = cloud.crop_axis(p, 0.1).select("pid", F.lit("band").alias("kind"))
    c = cloud.floor_band(p, "z", 0.25, 10).select("pid", F.lit("floor").alias("kind"))
    return a.unionByName(b).unionByName(c)


CROPS_SQL = f"""
WITH {P}, m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz, min(z) AS lo, max(z) AS hi FROM p),
d AS (SELECT pid, z, mz, lo, hi, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS d FROM p, m),
q AS (SELECT quantile_cont(d, 0.9) AS q FROM d),
b AS (SELECT count(CASE WHEN z < lo + CAST(0.25 AS DOUBLE) * (hi - lo) THEN 1 END) AS n FROM d)
SELECT pid, 'flyer' AS kind FROM d, q WHERE d < q
UNION ALL SELECT pid, 'band' FROM d WHERE abs(z - mz) < CAST(0.1 AS DOUBLE)
UNION ALL SELECT pid, 'floor' FROM d, b WHERE b.n < 10 OR z < lo + CAST(0.25 AS DOUBLE) * (hi - lo)
"""


def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("opacity", F.col("r") * 8 - 5)
    kept = cloud.prune_splats(p, scale_q=0.95, lo=0.02, hi=0.98)
    trimmed = cloud.quantile_trim(kept, "g", 0.04)
    return trimmed.select("pid", F.round(color.sigmoid(F.col("opacity")), 9).alias("alpha"), F.round(color.sh_encode(F.col("b")), 9).alias("sh"))


PRUNE_SQL = f"""
WITH {P},
s AS (SELECT *, r * 8 - 5 AS opacity, greatest(exp(s0), exp(s1), exp(s2)) AS hi, least(exp(s0), exp(s1), exp(s2)) AS lo FROM p),
q AS (SELECT quantile_cont(hi, 0.95) AS q, {", ".join(f"quantile_cont({k}, 0.02) AS l{k}, quantile_cont({k}, 0.98) AS h{k}" for k in XYZ)} FROM s),
k AS (SELECT s.* FROM s, q WHERE 1.0 / (1.0 + exp(-opacity)) > CAST(0.1 AS DOUBLE) AND hi < q AND hi / greatest(lo, CAST(1e-9 AS DOUBLE)) < 25
      AND {" AND ".join(f"{k} > l{k} AND {k} < h{k}" for k in XYZ)}),
t AS (SELECT quantile_cont(g, 0.04) AS t FROM k)
SELECT pid, round(1.0 / (1.0 + exp(-opacity)), 9) AS alpha, round((greatest(0, least(1, b)) - CAST(0.5 AS DOUBLE)) / CAST({color.SH_C0} AS DOUBLE), 9) AS sh FROM k, t WHERE g >= t
"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    box = cloud.room_axis(cloud.bounding_box(p))
    out = box.join(cloud.robust_extent(p), F.lit(True)).join(cloud.init_scale(p).select("mean_radius", "init_scale"), F.lit(True))
    return out.select(*(F.round(c, 8).alias(c) for c in ("diagonal", "extent", "voxel", "mean_radius", "init_scale")), "up_axis")


EXTENT_SQL = f"""
WITH {P},
b AS (SELECT max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM p),
q AS (SELECT greatest({", ".join(f"quantile_cont({k}, 0.98) - quantile_cont({k}, 0.02)" for k in XYZ)}) AS e FROM p),
r AS (SELECT avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))) AS mr FROM p, b)
SELECT round(sqrt(ex * ex + ey * ey + ez * ez), 8) AS diagonal, round(e, 8) AS extent, round(e / 512, 8) AS voxel, round(mr, 8) AS mean_radius,
       round(greatest(greatest(ex, ey, ez) / cbrt(CAST(n AS DOUBLE)), CAST(0.0005 AS DOUBLE)), 8) AS init_scale,
       CASE WHEN ex <= ey AND ex <= ez THEN 0 WHEN ey <= ez THEN 1 ELSE 2 END AS up_axis FROM b, q, r
"""


def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.outlier_removal(points(spark, sf_dir), 16, 2.0).select("pid")


OUTLIER_SQL = f"""
WITH {PARTS_SQL},
r AS (SELECT a.pid, {dist_sql("a", "b")} AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {dist_sql("a", "b")}, b.pid) AS rn FROM p a JOIN p b ON a.pid <> b.pid),
m AS (SELECT pid, avg(d) AS d FROM r WHERE rn <= 16 GROUP BY pid), s AS (SELECT avg(d) + 2 * stddev_samp(d) AS bar FROM m)
SELECT p.pid FROM p WHERE pid NOT IN (SELECT pid FROM m, s WHERE d > bar)
"""


def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"))
    p = points(spark, sf_dir).select("pid")
    a = cloud.sample_exact(o, 500).select("pid", F.lit("hash").alias("kind"))
    b = cloud.even_subsample(p, 80, "pid").select("pid", F.lit("even").alias("kind"))
    c = cloud.stride(p, 7, "pid").select("pid", F.lit("stride").alias("kind"))
    return a.unionByName(b).unionByName(c)


SUBSAMPLE_SQL = f"""
WITH {P}, o AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS ord, count(*) OVER () AS n FROM p),
e AS (SELECT DISTINCT CASE WHEN k = 79 THEN n - 1 ELSE CAST(floor(k * (CAST(n - 1 AS DOUBLE) / 79)) AS BIGINT) END AS ord FROM (SELECT max(n) AS n FROM o), (SELECT unnest(range(0, 80)) AS k))
SELECT pid, 'hash' AS kind FROM (SELECT o_orderkey AS pid FROM orders ORDER BY md5('0:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500)
UNION ALL SELECT pid, 'even' FROM o WHERE ord IN (SELECT ord FROM e) OR n <= 80
UNION ALL SELECT pid, 'stride' FROM o WHERE ord % 7 = 0
"""

AZ, EL, RES = 0.6, 0.4, 64
_M = camera.view_rotation(AZ, EL)


def z_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orthographic view about the median, the nearest point of each pixel."""
    p = points(spark, sf_dir)
    mid = quantiles.row(p, **{f"m{c}": (c, 0.5) for c in XYZ})
    q = p.join(F.broadcast(mid), F.lit(True))
    px, py, z = camera.orthographic_pixel([F.col(c) for c in XYZ], _M, [F.col(f"m{c}") for c in XYZ], F.lit(RES * 0.9), RES, RES)
    front = cloud.z_buffer(q.withColumns({"px": px, "py": py, "depth": z}), payload=("r",))
    return front.select("px", "py", F.round("depth", 8).alias("depth"), "pid", F.round("r", 8).alias("r"))


def _row_sql(i: int) -> str:
    return " + ".join(f"CAST({_M[i][k]!r} AS DOUBLE) * (x - m{c})" for k, c in enumerate(XYZ))


ZBUFFER_SQL = f"""
WITH {P}, m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM p),
v AS (SELECT pid, r, CAST(trunc(({_row_sql(0).replace("(x - my)", "(y - my)").replace("(x - mz)", "(z - mz)")}) * CAST({RES * 0.9} AS DOUBLE) + {RES / 2}) AS INTEGER) AS px,
             CAST(trunc(CAST({RES / 2} AS DOUBLE) - ({_row_sql(1).replace("(x - my)", "(y - my)").replace("(x - mz)", "(z - mz)")}) * CAST({RES * 0.9} AS DOUBLE)) AS INTEGER) AS py,
             {_row_sql(2).replace("(x - my)", "(y - my)").replace("(x - mz)", "(z - mz)")} AS depth FROM p, m)
SELECT px, py, round(depth, 8) AS depth, pid, round(r, 8) AS r FROM (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY depth, pid) AS rn FROM v) WHERE rn = 1
"""


def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-free outputs of the plane's principal axes."""
    a = cloud.pca_2d(points(spark, sf_dir))
    return a.select(*(F.round(c, 8).alias(c) for c in ("vaa", "vab", "vbb", "major", "minor")), F.round(F.abs("axis_a"), 6).alias("axis_a"), F.round(F.abs("axis_b"), 6).alias("axis_b"))


PCA_SQL = f"""
WITH {P}, c AS (SELECT var_samp(x) AS vaa, covar_samp(x, y) AS vab, var_samp(y) AS vbb FROM p),
e AS (SELECT *, sqrt((vaa - vbb) / 2 * ((vaa - vbb) / 2) + vab * vab) AS root, atan2(2 * vab, vaa - vbb) / 2 AS th FROM c)
SELECT round(vaa, 8) AS vaa, round(vab, 8) AS vab, round(vbb, 8) AS vbb, round((vaa + vbb) / 2 + root, 8) AS major, round((vaa + vbb) / 2 - root, 8) AS minor,
       round(abs(cos(th)), 6) AS axis_a, round(abs(sin(th)), 6) AS axis_b FROM e
"""


def error_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the origin as colours of the error ramp, through the look-up table."""
    p = points(spark, sf_dir)
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    rows = p.select("pid", F.round(color.error_level(d, 0.5) * 255, 0).cast("int").alias("level"))
    lut = color.turbo_table(spark)
    return rows.join(F.broadcast(lut), "level").select("pid", "level", *(F.round(c, 6).alias(c) for c in "rgb"))


def _turbo_sql(k: int) -> str:
    c = color.TURBO[k]
    out = f"CAST({c[-1]} AS DOUBLE)"
    for v in c[-2::-1]:
        out = f"({out} * t + CAST({v} AS DOUBLE))"
    return f"round(greatest(0, least(1, {out})), 6)"


COLOURS_SQL = f"""
WITH {P}, l AS (SELECT pid, CAST(round(greatest(0, least(1, sqrt(x * x + y * y + z * z) / CAST(0.5 AS DOUBLE))) * 255, 0) AS INTEGER) AS level FROM p),
t AS (SELECT *, level / CAST(255 AS DOUBLE) AS t FROM l)
SELECT pid, level, {", ".join(f"{_turbo_sql(k)} AS {c}" for k, c in enumerate("rgb"))} FROM t
"""

QUERIES = {
    "q15_voxel_downsample": voxels,
    "q16_crops": crops,
    "q17_quantile_prune": prune,
    "q17b_extents": extents,
    "q18_outlier_removal": outliers,
    "q19_subsample": subsample,
    "q20_zbuffer_project": z_buffer,
    "q20b_error_colours": error_colours,
    "q23_pca_align": pca,
}
ORACLE_SQL = {
    "q15_voxel_downsample": VOXEL_SQL,
    "q16_crops": CROPS_SQL,
    "q17_quantile_prune": PRUNE_SQL,
    "q17b_extents": EXTENT_SQL,
    "q18_outlier_removal": OUTLIER_SQL,
    "q19_subsample": SUBSAMPLE_SQL,
    "q20_zbuffer_project": ZBUFFER_SQL,
    "q20b_error_colours": COLOURS_SQL,
    "q23_pca_align": PCA_SQL,
}
