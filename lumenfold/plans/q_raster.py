"""Queries that draw meshes and splats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import raster

from .q_surface import _TRI, _mesh
from .tables import POINTS_SQL, points

D = "CAST({} AS DOUBLE)".format
XYZ = "xyz"
FOCAL, SIDE = 60.0, 32
# Two cameras on the z axis that look at the cloud from both sides: signs of x, y and z, and the distance.
_VIEWS = ((1, -1, -1, 2.0), (1, 1, 1, 1.5))


def _cameras(spark: SparkSession) -> DataFrame:
    rows = [(n, FOCAL, FOCAL, SIDE / 2, SIDE / 2, SIDE, SIDE, [[a * 1.0, 0.0, 0.0, 0.0], [0.0, b * 1.0, 0.0, 0.0], [0.0, 0.0, c * 1.0, d]]) for n, (a, b, c, d) in enumerate(_VIEWS)]
    return spark.createDataFrame(rows, "view int, fx double, fy double, cx double, cy double, width int, height int, w2c array<array<double>>")


_VIEW_ROWS = ", ".join(f"({n}, {a}, {b}, {c}, {D(d)})" for n, (a, b, c, d) in enumerate(_VIEWS))
_CAM = f"cam AS (SELECT * FROM (VALUES {_VIEW_ROWS}) t(view, sx, sy, sz, far))"
_GRID = f"grid AS (SELECT x AS px, y AS py, x + {D(0.5)} AS pu, y + {D(0.5)} AS pv FROM (SELECT unnest(range({SIDE})) AS x), (SELECT unnest(range({SIDE})) AS y))"


def drawn_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = _mesh(spark, sf_dir)
    out = raster.draw_mesh(t, v, _cameras(spark), ("r",))
    return out.select("view", "px", "py", "tid", F.round("depth", 7).alias("depth"), F.round("r", 6).alias("r"))


def _corner(k: str) -> str:
    return f"{D(FOCAL)} * sx * {k}.x / (sz * {k}.z + far) + {SIDE / 2} AS {k}u, {D(FOCAL)} * sy * {k}.y / (sz * {k}.z + far) + {SIDE / 2} AS {k}v, sz * {k}.z + far AS {k}d, {k}.r AS {k}r"


def _edge(a: str, b: str, u: str = "pu", v: str = "pv") -> str:
    return f"(({b}u - {a}u) * ({v} - {a}v) - ({b}v - {a}v) * ({u} - {a}u))"


DRAWN_MESH_SQL = f"""
WITH {_TRI}, {_CAM}, {_GRID},
t AS (SELECT view, tid, {_corner("a")}, {_corner("b")}, {_corner("c")} FROM clean JOIN p a ON a.pid = clean.a JOIN p b ON b.pid = clean.b JOIN p c ON c.pid = clean.c, cam),
f AS (SELECT *, {_edge("a", "b", "cu", "cv")} AS area FROM t WHERE ad > 0.000001 AND bd > 0.000001 AND cd > 0.000001),
w AS (SELECT view, tid, px, py, ad, bd, cd, ar, br, cr, {_edge("b", "c")} / area AS wa, {_edge("c", "a")} / area AS wb, {_edge("a", "b")} / area AS wc
      FROM f JOIN grid ON pu BETWEEN least(au, bu, cu) AND greatest(au, bu, cu) AND pv BETWEEN least(av, bv, cv) AND greatest(av, bv, cv) WHERE area <> 0),
d AS (SELECT view, tid, px, py, 1 / (wa / ad + wb / bd + wc / cd) AS depth, (wa * ar / ad + wb * br / bd + wc * cr / cd) / (wa / ad + wb / bd + wc / cd) AS r FROM w WHERE wa >= 0 AND wb >= 0 AND wc >= 0)
SELECT view, px, py, tid, round(depth, 7) AS depth, round(r, 6) AS r
FROM (SELECT *, row_number() OVER (PARTITION BY view, px, py ORDER BY depth, tid) AS k FROM d) WHERE k = 1
"""


def drawn_splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point as a splat with a shape, turn and opacity of its own."""
    p = points(spark, sf_dir)
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in ("s0", "s1", "s2")), F.col("r") * F.col("r")))
    splats = p.select(
        "pid", *XYZ, *"rgb", *((0.01 + 0.1 * F.abs(F.col(f"s{k}"))).alias(f"s{k}") for k in range(3)), (0.2 + 0.7 * F.col("g")).alias("opacity"),
        *((F.col(c) / length).alias(q) for c, q in zip(("r", "s0", "s1", "s2"), ("qw", "qx", "qy", "qz"))),
    )
    out = raster.draw_splats(splats, _cameras(spark))
    return out.select("view", "px", "py", *(F.round(c, 6).alias(c) for c in ("r", "g", "b", "alpha", "depth")))


_N = "sqrt(r * r + s0 * s0 + s1 * s1 + s2 * s2)"
_R = (
    ("1 - 2 * (qy * qy + qz * qz)", "2 * (qx * qy - qw * qz)", "2 * (qx * qz + qw * qy)"),
    ("2 * (qx * qy + qw * qz)", "1 - 2 * (qx * qx + qz * qz)", "2 * (qy * qz - qw * qx)"),
    ("2 * (qx * qz - qw * qy)", "2 * (qy * qz + qw * qx)", "1 - 2 * (qx * qx + qy * qy)"),
)
_AXES = ", ".join(f"s{axis} * ({_R[r][s]}) * e{s} AS m{r}{s}" for r, axis in enumerate(XYZ) for s in range(3))
_FLAT = ", ".join(f"{D(FOCAL)} / d * (m0{s} - cx / d * m2{s}) AS t{s}, {D(FOCAL)} / d * (m1{s} - cy / d * m2{s}) AS e{s}" for s in range(3))
DRAWN_SPLATS_SQL = f"""
WITH p AS ({POINTS_SQL}), {_CAM}, {_GRID},
q AS (SELECT pid, x, y, z, r, g, b, {", ".join(f"{D(0.01)} + {D(0.1)} * abs(s{k}) AS e{k}" for k in range(3))}, {D(0.2)} + {D(0.7)} * g AS opacity, r / {_N} AS qw, s0 / {_N} AS qx, s1 / {_N} AS qy, s2 / {_N} AS qz FROM p),
c AS (SELECT view, pid, r, g, b, opacity, sx * x AS cx, sy * y AS cy, sz * z + far AS d, {_AXES} FROM q, cam WHERE sz * z + far > 0.000001),
f AS (SELECT view, pid, r, g, b, opacity, d, {D(FOCAL)} * cx / d + {SIDE / 2} AS u, {D(FOCAL)} * cy / d + {SIDE / 2} AS v, {_FLAT} FROM c),
k AS (SELECT *, t0 * t0 + t1 * t1 + t2 * t2 + {D(raster.BLUR)} AS ka, t0 * e0 + t1 * e1 + t2 * e2 AS kb, e0 * e0 + e1 * e1 + e2 * e2 + {D(raster.BLUR)} AS kc FROM f),
h AS (SELECT *, ka * kc - kb * kb AS det, {raster.REACH} * sqrt((ka + kc) / 2 + sqrt(greatest(0, (ka + kc) / 2 * (ka + kc) / 2 - (ka * kc - kb * kb)))) AS reach FROM k),
o AS (SELECT view, px, py, pid, d, r, g, b, least({D(raster.MOST)}, opacity * exp({D(-0.5)} * (kc * (pu - u) * (pu - u) - 2 * kb * (pu - u) * (pv - v) + ka * (pv - v) * (pv - v)) / det)) AS alpha
      FROM h JOIN grid ON pu BETWEEN u - reach AND u + reach AND pv BETWEEN v - reach AND v + reach WHERE det > 0),
l AS (SELECT *, exp(coalesce(sum(ln(1 - alpha)) OVER (PARTITION BY view, px, py ORDER BY d, pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS light FROM o WHERE alpha >= {D("1")} / 255)
SELECT view, px, py, round(sum(r * alpha * light), 6) AS r, round(sum(g * alpha * light), 6) AS g, round(sum(b * alpha * light), 6) AS b, round(sum(alpha * light), 6) AS alpha,
       round(sum(d * alpha * light) / sum(alpha * light), 6) AS depth
FROM l WHERE light >= {D(raster.DARK)} GROUP BY view, px, py
"""

QUERIES = {"q76_drawn_mesh": drawn_mesh, "q77_drawn_splats": drawn_splats}
ORACLE_SQL = {"q76_drawn_mesh": DRAWN_MESH_SQL, "q77_drawn_splats": DRAWN_SPLATS_SQL}
