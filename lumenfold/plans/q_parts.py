"""Queries of single building blocks: images, cameras, colours, planes, paths, samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import camera, color, linalg, names
from lumenfold.operators import cloud, fit, image, quantiles, trajectory, volume
from lumenfold.operators import frames as fr

from .tables import FRAMES_SQL, POINTS_SQL, points, read
from .tables import frames as clip

P = f"p AS ({POINTS_SQL})"
XYZ = "xyz"
D = "CAST({} AS DOUBLE)".format

# ---------------------------------------------------------------- frames and images


def selected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second frame is scored; the selected ones are read again, with their new names."""
    frames = clip(spark, sf_dir)
    labelled = fr.select_keyframes(frames, fr.IngestConfig(target_frames=8, sample_stride=2)).where("selected")
    rank = F.row_number().over(W.partitionBy("video").orderBy("frame_idx")) - 1
    named = fr.take_selected(frames, labelled).withColumn("name", names.frame_name(rank))
    return named.select("video", "frame_idx", F.round("sharpness", 6).alias("sharpness"), "name", names.swap_extension(F.col("name"), ".obj").alias("sibling"))


def _selected_sql() -> str:
    from .q_frames import _STATS, _selection_sql

    stats = _STATS.replace(f"f AS ({FRAMES_SQL})", f"f AS (SELECT * FROM ({FRAMES_SQL}) WHERE frame_idx % 2 = 0)")
    stats = stats.replace("frame_idx AS i,", "row_number() OVER (PARTITION BY video ORDER BY frame_idx) - 1 AS i, frame_idx,")
    return f"""
WITH {stats}, {_selection_sql(8)},
r AS (SELECT video, frame_idx, sharpness, row_number() OVER (PARTITION BY video ORDER BY frame_idx) - 1 AS k FROM lab WHERE selected)
SELECT video, frame_idx, round(sharpness, 6) AS sharpness, 'frame_' || lpad(CAST(k AS VARCHAR), 4, '0') || '.jpg' AS name,
       'frame_' || lpad(CAST(k AS VARCHAR), 4, '0') || '.obj' AS sibling FROM r
"""


def _pictures(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Frames whose bytes are the first ``n`` components of a vector; a label is a clip."""
    level = lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5).cast("long")), 2, "0")
    rank = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    pixels = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, n), level), ""))
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video"), rank.cast("long").alias("frame_idx"), pixels.alias("pixels"))


def pixel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey frames of 8 x 8, halved by area: variance of the Laplacian and motion."""
    sized = _pictures(spark, sf_dir, 64).withColumns({"height": F.lit(8), "width": F.lit(8), "channels": F.lit(1)})
    scored = image.with_motion(image.score_frames(sized, proc_width=4))
    # Whole numbers of 1 / 4096, so that rounding meets no ties.
    return scored.select("video", "frame_idx", F.round(F.col("sharpness") * 4096, 0).alias("sharpness"), F.round("motion", 6).alias("motion"))


_PX = "SELECT label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, list_transform(embedding, lambda x: floor((CAST(x AS DOUBLE) + 1) * 127.5)) AS px FROM embeddings"


def _laplacian(h: int, w: int) -> str:
    """List of the four-neighbour Laplacian of list ``g``, edges mirrored."""
    flip = lambda k, n: -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    at = lambda r, c: f"g[{flip(r, h) * w + flip(c, w) + 1}]"
    return "[" + ", ".join(f"{at(r - 1, c)} + {at(r + 1, c)} + {at(r, c - 1)} + {at(r, c + 1)} - 4 * {at(r, c)}" for r in range(h) for c in range(w)) + "]"


_HALF = "[" + ", ".join("(" + " + ".join(f"px[{(2 * r + i) * 8 + 2 * c + j + 1}]" for i in (0, 1) for j in (0, 1)) + ") / 4" for r in range(4) for c in range(4)) + "]"
PIXEL_SQL = f"""
WITH x AS ({_PX}), g AS (SELECT video, frame_idx, {_HALF} AS g FROM x),
s AS (SELECT video, frame_idx, list_aggregate({_laplacian(4, 4)}, 'var_pop') AS sharpness, list_transform(g, lambda v: round_even(v, 0)) AS b FROM g),
m AS (SELECT *, lag(b) OVER (PARTITION BY video ORDER BY frame_idx) AS a FROM s)
SELECT CAST(video AS BIGINT) AS video, frame_idx, round(sharpness * 4096, 0) AS sharpness,
       round(coalesce(({" + ".join(f"abs(b[{k}] - a[{k}])" for k in range(1, 17))}) / 16, 0), 6) AS motion FROM m
"""


def colour_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour frames of 5 x 4, blue first, at their own size."""
    sized = _pictures(spark, sf_dir, 60).withColumns({"height": F.lit(4), "width": F.lit(5), "channels": F.lit(3)})
    return image.score_frames(sized, proc_width=None).select("video", "frame_idx", F.round("sharpness", 5).alias("sharpness"))


_GREY = "[" + ", ".join(f"{D(0.299)} * px[{3 * k + 3}] + {D(0.587)} * px[{3 * k + 2}] + {D(0.114)} * px[{3 * k + 1}]" for k in range(20)) + "]"
COLOUR_FRAME_SQL = f"""
WITH x AS ({_PX}), g AS (SELECT video, frame_idx, {_GREY} AS g FROM x)
SELECT CAST(video AS BIGINT) AS video, frame_idx, round(list_aggregate({_laplacian(4, 5)}, 'var_pop'), 5) AS sharpness FROM g
"""


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity and photometric loss of vectors 2k and 2k + 1 as images of 8 x 8."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("v"))
    even = e.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("pair"), F.col("v").alias("a"))
    odd = e.where("vec_id % 2 = 1").select(((F.col("vec_id") - 1) / 2).cast("long").alias("pair"), F.col("v").alias("b"))
    out = image.with_similarity(even.join(odd, "pair"), 8)
    return out.select("pair", F.round("ssim", 8).alias("ssim"), F.round("loss", 8).alias("loss"))


SIMILARITY_SQL = f"""
WITH v AS (SELECT vec_id, k - 1 AS k, (CAST(embedding[k] AS DOUBLE) + 1) / 2 AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
i AS (SELECT a.vec_id // 2 AS pair, a.k, a.x AS a, b.x AS b FROM v a JOIN v b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 AND a.k = b.k),
s AS (SELECT sum(exp(-k * k / {D(4.5)})) AS s FROM (SELECT unnest(range(-5, 6)) AS k)),
w AS (SELECT p, q, exp(-((p // 8 - q // 8) * (p // 8 - q // 8) + (p % 8 - q % 8) * (p % 8 - q % 8)) / {D(4.5)}) / (s * s) AS w
      FROM (SELECT unnest(range(0, 64)) AS p), (SELECT unnest(range(0, 64)) AS q), s WHERE abs(p // 8 - q // 8) <= 5 AND abs(p % 8 - q % 8) <= 5),
m AS (SELECT pair, p, sum(w * a) AS ma, sum(w * b) AS mb, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM i JOIN w ON w.q = i.k GROUP BY pair, p),
f AS (SELECT pair, avg((2 * ma * mb + {D(0.0001)}) * (2 * (ab - ma * mb) + {D(0.0009)}) / ((ma * ma + mb * mb + {D(0.0001)}) * (aa - ma * ma + bb - mb * mb + {D(0.0009)}))) AS ssim FROM m GROUP BY pair),
l AS (SELECT pair, avg(abs(a - b)) AS l FROM i GROUP BY pair)
SELECT pair, round(ssim, 8) AS ssim, round({D(0.8)} * l + {D(0.2)} * (1 - ssim), 8) AS loss FROM f JOIN l USING (pair)
"""

# ---------------------------------------------------------------- columns


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on points: bytes of colours, masked depth, view box, camera parts, quaternions, names."""
    p = points(spark, sf_dir)
    p = p.join(F.broadcast(p.agg(F.max(F.greatest("r", "g", "b")).alias("__top"))), F.lit(True))
    p = p.withColumn("byte", color.to_bytes(F.col("r"), F.col("__top"))).drop("__top")
    depth = volume.mask_depth(p.withColumns({"alpha": F.col("g"), "depth": F.col("b") * 4}), 2.0).select("pid", "depth")
    sure = cloud.confidence_mask(p.select("pid", "g"), "g", 30).select("pid", F.lit(True).alias("sure"))
    k = camera.rescale_intrinsics(camera.intrinsics_from_hfov(60.0, 64, 48), F.col("label") + 1.0, F.col("label") + 2.0)
    c2w = [[F.col("nx"), F.col("ny"), F.col("nz"), F.col("x")], [F.col("s0"), F.col("s1"), F.col("s2"), F.col("y")], [F.col("r"), F.col("g"), F.col("b"), F.col("z")]]
    yaw = linalg.yaw_quaternion(F.col("x") * 3)
    unit = linalg.quaternion_unit([F.col(c) for c in ("r", "s0", "s1", "s2")])
    rows = cloud.normalise_view(p).withColumnsRenamed({c: f"view_{c}" for c in XYZ}).join(p.select("pid", *XYZ), "pid")
    rows = rows.join(depth, "pid").join(sure, "pid", "left")
    return rows.select(
        "pid", "byte", F.round("depth", 8).alias("depth"), F.coalesce("sure", F.lit(False)).alias("sure"), *(F.round(f"view_{c}", 7).alias(f"view_{c}") for c in XYZ),
        *(F.round(k[c], 6).alias(c) for c in ("fx", "fy", "cx", "cy")),
        *(F.round(v, 7).alias(f"at_{c}") for v, c in zip(camera.centre(c2w), XYZ)), *(F.round(v, 7).alias(f"look_{c}") for v, c in zip(camera.look_direction(c2w), XYZ)),
        *(F.round(v, 7).alias(f"up_{c}") for v, c in zip(camera.up_direction(c2w), XYZ)),
        F.round(yaw[0], 7).alias("yaw_w"), F.round(yaw[3], 7).alias("yaw_z"), *(F.round(q, 7).alias(f"unit_{c}") for q, c in zip(unit, "wxyz")),
        camera.even(F.col("pid")).alias("even"), names.megabytes(F.col("pid") * 12345).alias("mb"),
    )


_FX = f"32 / tan({D(60)} * {D(repr(math.pi / 180))} / 2)"
_QN = "sqrt(r * r + s0 * s0 + s1 * s1 + s2 * s2)"
COLUMNS_SQL = f"""
WITH {P}, t AS (SELECT max(greatest(r, g, b)) AS top, quantile_cont(g, 0.3) AS q, {", ".join(f"min({c}) AS l{c}, max({c}) AS h{c}" for c in XYZ)} FROM p),
e AS (SELECT *, 3 / greatest(hx - lx, hy - ly, hz - lz) AS sc FROM t)
SELECT pid, CAST(trunc(CASE WHEN top <= 1 THEN r * 255 ELSE r END) AS INTEGER) AS byte, round(CASE WHEN g < {D(0.5)} OR b * 4 > 2 THEN 0 ELSE b * 4 END, 8) AS depth, g > q AS sure,
       {", ".join(f"round(({c} - (l{c} + h{c}) / 2) * sc, 7) AS view_{c}" for c in XYZ)},
       round({_FX} * (label + 1), 6) AS fx, round({_FX} * (label + 2), 6) AS fy, round({D(32)} * (label + 1), 6) AS cx, round({D(24)} * (label + 2), 6) AS cy,
       round(x, 7) AS at_x, round(y, 7) AS at_y, round(z, 7) AS at_z, round(nz, 7) AS look_x, round(s2, 7) AS look_y, round(b, 7) AS look_z,
       round(-ny, 7) AS up_x, round(-s1, 7) AS up_y, round(-g, 7) AS up_z,
       round(cos(x * 3 / 2), 7) AS yaw_w, round(sin(x * 3 / 2), 7) AS yaw_z,
       round(r / {_QN}, 7) AS unit_w, round(s0 / {_QN}, 7) AS unit_x, round(s1 / {_QN}, 7) AS unit_y, round(s2 / {_QN}, 7) AS unit_z,
       pid - pid % 2 AS even, round(pid * 12345 / {D(1e6)}, 1) AS mb
FROM p, e
"""

_TURNS = [(0, linalg.RX_PLUS_90, (1.0, 2.0, 3.0)), (1, linalg.CAPTURE_TO_RECON, (0.5, 0.0, -1.0)), (2, linalg.IDENTITY, (0.0, 0.0, 0.0))]


def fused_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked depth pixels of three cameras as one world cloud; pixels of a fourth view have no camera."""
    p = points(spark, sf_dir)
    pixels = p.select("pid", (F.col("label") % 4).alias("view"), (F.col("r") * 64).alias("u"), (F.col("g") * 48).alias("v"), (F.col("b") * 12).alias("depth"), (F.col("s0") > -0.05).alias("mask"))
    cams = [(k, 30.0 + k, 31.0 + k, 32.0, 24.0, [[*map(float, r), t] for r, t in zip(m, move)]) for k, m, move in _TURNS]
    cameras = spark.createDataFrame(cams, "view int, fx double, fy double, cx double, cy double, c2w array<array<double>>")
    return volume.fuse_views(pixels, cameras).select("pid", "view", *(F.round(c, 6).alias(c) for c in XYZ))


_CAM_ROWS = ", ".join(f"({k}, {30 + k}, {31 + k}, " + ", ".join(str(float(v)) for r, t in zip(m, move) for v in (*r, t)) + ")" for k, m, move in _TURNS)
FUSED_SQL = f"""
WITH {P}, c AS (SELECT * FROM (VALUES {_CAM_ROWS}) t(view, fx, fy, {", ".join(f"m{i}{j}" for i in range(3) for j in range(4))})),
q AS (SELECT pid, label % 4 AS view, r * 64 AS u, g * 48 AS v, b * 12 AS d FROM p WHERE s0 > {D(-0.05)} AND b * 12 > {D(0.1)} AND b * 12 < 8),
k AS (SELECT pid, c.*, (u - 32) / fx * d AS a, (v - 24) / fy * d AS b, d FROM q JOIN c ON c.view = q.view)
SELECT pid, CAST(view AS INTEGER) AS view, {", ".join(f"round(m{i}0 * a + m{i}1 * b + m{i}2 * d + m{i}3, 6) AS {c}" for i, c in enumerate(XYZ))} FROM k
"""

# ---------------------------------------------------------------- planes and alignment


def gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud turned by the mean up-direction of cameras whose second axis is the points' normal."""
    p = points(spark, sf_dir)
    zero = F.lit(0.0)
    cams = p.select(F.array(*(F.array(zero, F.col(f"n{c}"), zero, zero) for c in XYZ), F.array(zero, zero, zero, F.lit(1.0))).alias("c2w"))
    return fit.gravity_align(p.select("pid", *XYZ), cams, "y").select("pid", *(F.round(c, 6).alias(c) for c in XYZ))


A_, B_, C_ = 0.2, 0.1, -1.0  # the planted floor z = A x + B y + C


def planted_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of even label lie on a tilted floor, the others far above it; the floor becomes level at zero."""
    p = points(spark, sf_dir)
    z = F.when(F.col("label") % 2 == 0, A_ * F.col("x") + B_ * F.col("y") + C_).otherwise(F.col("z") + 40.0)
    level = fit.align_floor(p.select("pid", "x", "y", z.alias("z")))
    return level.select("pid", *(F.round(c, 5).alias(c) for c in XYZ))


PLANTED_SQL = f"""
WITH {P}, f AS (SELECT pid, label, x, y, CASE WHEN label % 2 = 0 THEN {D(A_)} * x + {D(B_)} * y + {D(C_)} ELSE z + 40 END AS z FROM p),
n AS (SELECT {D(-A_)} / l AS a, {D(-B_)} / l AS b, 1 / l AS c FROM (SELECT sqrt({D(A_)} * {D(A_)} + {D(B_)} * {D(B_)} + 1) AS l)),
t AS (SELECT pid, label, (1 - a * a / (1 + c)) * x - a * b / (1 + c) * y - a * z AS x, -a * b / (1 + c) * x + (1 - b * b / (1 + c)) * y - b * z AS y, a * x + b * y + c * z AS z FROM f, n),
h AS (SELECT median(z) AS h FROM t WHERE label % 2 = 0)
SELECT pid, round(x, 5) AS x, round(y, 5) AS y, round(z - h, 5) AS z FROM t, h
"""


def planted_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's points lie on a plane of their own, far from the others; the largest component is positive."""
    p = points(spark, sf_dir)
    z = (F.col("label") - 4.5) * 0.1 * F.col("x") + F.col("label") * 50.0
    n = fit.estimate_normals(p.select("pid", "x", "y", z.alias("z")), 12)
    return n.select("pid", *(F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")))


NORMAL_SQL = f"""
WITH {P}, s AS (SELECT pid, (label - {D(4.5)}) * {D(0.1)} AS s FROM p)
SELECT pid, round(-s / sqrt(1 + s * s), 5) + 0 AS nx, {D(0)} AS ny, round(1 / sqrt(1 + s * s), 5) AS nz FROM s
"""


def aligned_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretched points in their principal axes, up to the axes' signs."""
    p = points(spark, sf_dir).withColumns({"x": F.col("x") * 3, "y": F.col("y") + F.col("x")})
    return cloud.align_2d(p).select("pid", F.round(F.abs("ra"), 6).alias("ra"), F.round(F.abs("rb"), 6).alias("rb"))


ALIGNED_SQL = f"""
WITH {P}, q AS (SELECT pid, x * 3 AS x, y + x AS y FROM p), c AS (SELECT var_samp(x) AS vx, covar_samp(x, y) AS vxy, var_samp(y) AS vy, avg(x) AS mx, avg(y) AS my FROM q),
a AS (SELECT *, atan2(2 * vxy, vx - vy) / 2 AS th FROM c),
u AS (SELECT pid, cos(th) * (x - mx) + sin(th) * (y - my) AS u, cos(th) * (y - my) - sin(th) * (x - mx) AS v FROM q, a),
t AS (SELECT max(v) - min(v) > max(u) - min(u) AS tall FROM u)
SELECT pid, round(abs(CASE WHEN tall THEN v ELSE u END), 6) AS ra, round(abs(CASE WHEN tall THEN u ELSE v END), 6) AS rb FROM u, t
"""


def opposite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of equal, opposite and general directions: where the axis goes, and that lengths stay."""
    p = points(spark, sf_dir)
    kind = F.col("pid") % 3
    d = [F.when(kind == 0, 0.0).otherwise(F.col("nx")), F.when(kind == 0, 0.0).otherwise(F.col("ny")), F.when(kind == 0, F.when(F.col("pid") % 2 == 0, -2.0).otherwise(2.0)).otherwise(F.col("nz"))]
    out = None
    for test in ("cosine", "cross"):
        rows = linalg.with_alignment(p.withColumns({f"d{c}": v for c, v in zip(XYZ, d)}), [F.col(f"d{c}") for c in XYZ], (0.0, 0.0, 1.0), parallel=test)
        r = linalg.columns_matrix()
        to = linalg.rotate(r, linalg.unit([F.col(f"d{c}") for c in XYZ]))
        moved = linalg.norm(linalg.rotate(r, [F.col(c) for c in XYZ]))
        det = linalg.dot(linalg.cross(r[0], r[1]), r[2])
        one = rows.select("pid", F.lit(test).alias("test"), *(F.round(F.abs(t), 6).alias(f"to_{c}") for t, c in zip(to, XYZ)), F.round(moved, 6).alias("length"), F.round(det, 6).alias("det"))
        out = one if out is None else out.unionByName(one)
    return out


OPPOSITE_SQL = f"""
WITH {P}
SELECT pid, t.test, {D(0)} AS to_x, {D(0)} AS to_y, {D(1)} AS to_z, round(sqrt(x * x + y * y + z * z), 6) AS length, {D(1)} AS det FROM p, (VALUES ('cosine'), ('cross')) t(test)
"""

# ---------------------------------------------------------------- paths and samples


def smooth_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints along a line at uneven distances, turning as they go: places by spline, headings by slerp."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("traj"), "ts", "event_id", "value")
    w = W.partitionBy("traj").orderBy("ts", "event_id")
    e = e.withColumns({"step": (F.row_number().over(w) - 1).cast("long"), "s": F.sum(F.abs("value") + 1).over(w.rowsBetween(W.unboundedPreceding, 0)) / 1000})
    yaw = linalg.yaw_quaternion((F.col("event_id") % 17).cast("double") / 17)
    path = e.select("traj", "step", F.col("s").alias("x"), (F.col("s") * 2).alias("y"), (-F.col("s")).alias("z"), *(q.alias(f"q{c}") for q, c in zip(yaw, "wxyz")))
    out = trajectory.resample_smooth(path, 20)
    return out.select("traj", "k", *(F.round(c, 5).alias(c) for c in (*XYZ, "qw", "qz")))


SMOOTH_SQL = f"""
WITH e AS (SELECT user_id AS traj, row_number() OVER w - 1 AS step, sum(abs(value) + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 1000 AS s,
           CAST(event_id % 17 AS DOUBLE) / 17 AS yaw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT traj, min(s) AS lo, max(s) AS hi, count(*) AS n FROM e GROUP BY traj),
t AS (SELECT e.*, (s - lo) / (hi - lo) AS t FROM e JOIN b USING (traj)),
g AS (SELECT traj, step, t, yaw, lead(t) OVER (PARTITION BY traj ORDER BY step) AS t2, lead(yaw) OVER (PARTITION BY traj ORDER BY step) AS yaw2 FROM t),
k AS (SELECT traj, lo, hi, k, CAST(k AS DOUBLE) / 19 AS u FROM b, (SELECT unnest(range(0, 20)) AS k)),
j AS (SELECT k.traj, k.k, lo + u * (hi - lo) AS s, CASE WHEN k.k = 19 THEN (SELECT yaw FROM g x WHERE x.traj = k.traj AND x.t2 IS NULL) ELSE g.yaw + (g.yaw2 - g.yaw) * (u - g.t) / (g.t2 - g.t) END AS yaw
      FROM k LEFT JOIN g ON g.traj = k.traj AND k.k < 19 AND g.t <= u AND u < g.t2)
SELECT traj, CAST(k AS INTEGER) AS k, round(s, 5) AS x, round(2 * s, 5) AS y, round(-s, 5) AS z, round(cos(yaw / 2), 5) AS qw, round(sin(yaw / 2), 5) AS qz FROM j
"""


def gait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leg phases of a trot, as many steps as there are nations, for each region's lift."""
    steps = read(spark, sf_dir, "nation").count()
    t = trajectory.trot(spark, steps, 0.01, 1.5, 0.3, 0.2)
    r = read(spark, sf_dir, "region").select("r_regionkey")
    return t.join(F.broadcast(r), F.lit(True)).select("r_regionkey", "step", "leg", F.round("hip", 7).alias("hip"), F.round(F.col("knee") * (F.col("r_regionkey") + 1), 7).alias("knee"))


GAIT_SQL = f"""
WITH s AS (SELECT CAST(unnest(range(0, (SELECT count(*) FROM nation))) AS INTEGER) AS step),
l AS (SELECT * FROM (VALUES ('FL', 0), ('FR', 1), ('RL', 1), ('RR', 0)) t(leg, p)),
a AS (SELECT step, leg, step * {D(0.01)} * {D(repr(3 * math.pi))} + p * {D(repr(math.pi))} AS a FROM s, l)
SELECT r_regionkey, step, leg, round(sin(a) * {D(0.3)}, 7) AS hip, round(greatest(0, cos(a)) * {D(0.2)} * (r_regionkey + 1), 7) AS knee FROM a, region
"""


def goal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals from the central disc and from one that no draw falls into; meshes paired with budgets."""
    cells = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), (F.col("o_custkey") % 50).cast("double").alias("x"), (F.col("o_orderkey") % 50).cast("double").alias("y"))
    a = trajectory.goals(cells, (25.0, 25.0), 12.0, 6).select(F.lit("near").alias("kind"), F.col("pid").alias("id"))
    b = trajectory.goals(cells, (900.0, 900.0), 5.0, 6).select(F.lit("far").alias("kind"), F.col("pid").alias("id"))
    regions = [r[0] for r in read(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]
    c = fit.work_list(regions, [n + ".ply" for n in regions], [1000 * k for k in range(len(regions))], spark)
    return a.unionByName(b).unionByName(c.select(F.concat_ws(">", "src", "out").alias("kind"), (F.col("n") + F.col("target")).cast("long").alias("id")))


_DRAWS = "SELECT *, md5('0:' || CAST(pid AS VARCHAR)) AS h FROM (SELECT o_orderkey AS pid, o_custkey % 50 AS x, o_orderkey % 50 AS y FROM orders) ORDER BY h, pid LIMIT 300"
GOALS_SQL = f"""
WITH d AS ({_DRAWS}), r AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS n FROM region)
SELECT 'near' AS kind, pid AS id FROM (SELECT pid FROM d ORDER BY (x - 25) * (x - 25) + (y - 25) * (y - 25) > 144, h, pid LIMIT 6)
UNION ALL SELECT 'far', pid FROM (SELECT pid FROM d ORDER BY h, pid LIMIT 6)
UNION ALL SELECT r_name || '>' || r_name || '.ply', n + 1000 * n FROM r
"""


def splat_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of prices, one from each end and the middle."""
    return quantiles.row(read(spark, sf_dir, "lineitem"), price=("l_extendedprice", [0.01, 0.5, 0.99])).select(F.explode("price").alias("q")).select(F.round("q", 6).alias("q"))


QUANTILE_SQL = "SELECT round(unnest([quantile_cont(l_extendedprice, 0.01), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.99)]), 6) AS q FROM lineitem"


def _up_sql() -> str:
    from .q_geometry import UP_SQL

    return UP_SQL


QUERIES = {
    "q37_selected_frames": selected_frames,
    "q38_pixel_scores": pixel_scores,
    "q38b_colour_frames": colour_frames,
    "q39_similarity": similarity,
    "q40_columns": columns,
    "q41_fused_views": fused_views,
    "q42_gravity_align": gravity,
    "q43_planted_floor": planted_floor,
    "q44_planted_normals": planted_normals,
    "q45_align_2d": aligned_2d,
    "q46_opposite_directions": opposite,
    "q47_smooth_path": smooth_path,
    "q48_gait": gait,
    "q49_goals": goal_cells,
    "q50_quantiles": splat_quantiles,
}
ORACLE_SQL = {
    "q37_selected_frames": _selected_sql(),
    "q38_pixel_scores": PIXEL_SQL,
    "q38b_colour_frames": COLOUR_FRAME_SQL,
    "q39_similarity": SIMILARITY_SQL,
    "q40_columns": COLUMNS_SQL,
    "q41_fused_views": FUSED_SQL,
    "q42_gravity_align": _up_sql(),
    "q43_planted_floor": PLANTED_SQL,
    "q44_planted_normals": NORMAL_SQL,
    "q45_align_2d": ALIGNED_SQL,
    "q46_opposite_directions": OPPOSITE_SQL,
    "q47_smooth_path": SMOOTH_SQL,
    "q48_gait": GAIT_SQL,
    "q49_goals": GOALS_SQL,
    "q50_quantiles": QUANTILE_SQL,
}
