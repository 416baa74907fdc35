"""Camera paths and physics time series: rows ``traj, step`` with positions or readings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _by_step():
    return W.partitionBy("traj").orderBy("step")


def arc_length(path: DataFrame) -> DataFrame:
    """Add ``seg``, ``arc`` (running length) and ``t`` (share of the whole; 0 for a path that stands)."""
    w = _by_step()
    d = [F.col(c) - F.lag(c).over(w) for c in XYZ]
    out = path.withColumn("seg", F.coalesce(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(0.0)))
    out = out.withColumn("arc", F.sum("seg").over(w.rowsBetween(W.unboundedPreceding, 0)))
    whole = F.max("arc").over(W.partitionBy("traj"))
    return out.withColumn("t", F.when(whole > 0, F.col("arc") / whole).otherwise(0.0))


def trim_stride(path: DataFrame, lo: float = 0.0, hi: float = 1.0, stride: int = 1) -> DataFrame:
    """The contiguous share from ``lo`` to ``hi`` of each path, every ``stride``-th row of it."""
    n = F.count(F.lit(1)).over(W.partitionBy("traj"))
    i = F.row_number().over(_by_step()) - 1
    start = F.floor(F.lit(lo) * n)
    out = path.withColumn("__i", i - start).withColumn("__n", F.floor(F.lit(hi) * n) - start)
    return out.where((F.col("__i") >= 0) & (F.col("__i") < F.col("__n")) & (F.col("__i") % stride == 0)).drop("__i", "__n")


def heading(path: DataFrame, ahead: int = 3, a: str = "x", b: str = "y") -> DataFrame:
    """Direction to the position ``ahead`` steps later, the last one near the end."""
    w = _by_step()
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    later = lambda c: F.coalesce(F.lead(c, ahead).over(w), F.last(c).over(whole))
    return path.withColumn("heading", F.atan2(later(b) - F.col(b), later(a) - F.col(a)))


def resample_linear(path: DataFrame, n: int) -> DataFrame:
    """``traj, k, x, y, z`` at ``n`` even parameters over the waypoints' ranks, by interpolation between
    neighbours: each segment makes its own samples, so nothing is joined."""
    w = _by_step()
    rows = path.withColumn("__i", (F.row_number().over(w) - 1).cast("double")).withColumn("__m", F.count(F.lit(1)).over(W.partitionBy("traj")).cast("double"))
    rows = rows.withColumns({f"__{c}": F.lead(c).over(w) for c in XYZ})
    # Sample k stands at u = k * (m - 1) / (n - 1); this segment has those from its rank up to the next.
    per = (F.col("__m") - 1) / F.lit(float(max(1, n - 1)))
    first = F.when(per > 0, F.ceil(F.col("__i") / per)).otherwise(0)
    last = F.when(F.col("__i") == F.col("__m") - 1, F.lit(n - 1)).otherwise(F.least(F.lit(n - 1), F.ceil((F.col("__i") + 1) / per) - 1))
    rows = rows.withColumn("k", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))))
    f = F.col("k") * per - F.col("__i")
    return rows.select("traj", "k", *(F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(F.col(c) + (F.col(f"__{c}") - F.col(c)) * f).alias(c) for c in XYZ))


def natural_spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (t, y) with not-a-knot ends, evaluated at ``at``."""
    n = len(t)
    if n == 1:
        return np.repeat(y, len(at), axis=0)
    if n == 2:
        f = ((at - t[0]) / (t[1] - t[0]))[:, None]
        return y[0] + (y[1] - y[0]) * f
    if n == 3:
        fit = np.linalg.solve(np.vander(t - t[0], 3), y)
        return np.vander(at - t[0], 3) @ fit
    h = np.diff(t)
    slope = np.diff(y, axis=0) / h[:, None]
    # The third derivative is continuous at the second and the last but one knot; put into the second and last
    # but one equation, that leaves three diagonals.
    low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    rhs = 6 * np.diff(slope, axis=0)
    mid[0] += h[0] + h[0] ** 2 / h[1]
    up[0] -= h[0] ** 2 / h[1]
    mid[-1] += h[-1] + h[-1] ** 2 / h[-2]
    low[-1] -= h[-1] ** 2 / h[-2]
    for k in range(1, n - 2):
        f = low[k] / mid[k - 1]
        mid[k] -= f * up[k - 1]
        rhs[k] -= f * rhs[k - 1]
    m = np.zeros_like(y)
    m[n - 2] = rhs[-1] / mid[-1]
    for k in range(n - 4, -1, -1):
        m[k + 1] = (rhs[k] - up[k] * m[k + 2]) / mid[k]
    m[0] = m[1] + (m[1] - m[2]) * h[0] / h[1]
    m[-1] = m[-2] + (m[-2] - m[-3]) * h[-1] / h[-2]
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    u, v, hh = (at - t[i])[:, None], (t[i + 1] - at)[:, None], h[i][:, None]
    return (m[i] * v**3 + m[i + 1] * u**3) / (6 * hh) + (y[i] / hh - m[i] * hh / 6) * v + (y[i + 1] / hh - m[i + 1] * hh / 6) * u


def slerp(t: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shortest-arc interpolation of unit quaternions (w, x, y, z) at the knots ``t``."""
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, max(0, len(t) - 2))
    j = np.minimum(i + 1, len(t) - 1)
    a, b = q[i], q[j].copy()
    c = (a * b).sum(axis=1)
    b[c < 0] *= -1
    c = np.minimum(np.abs(c), 1.0)
    f = np.where(t[j] > t[i], (at - t[i]) / np.where(t[j] > t[i], t[j] - t[i], 1), 0.0)
    angle = np.arccos(c)
    s = np.sin(angle)
    flat = s < 1e-9
    wa = np.where(flat, 1 - f, np.sin((1 - f) * angle) / np.where(flat, 1, s))
    wb = np.where(flat, f, np.sin(f * angle) / np.where(flat, 1, s))
    out = wa[:, None] * a + wb[:, None] * b
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def resample_smooth(path: DataFrame, n: int) -> DataFrame:
    """``traj, k, x, y, z, qw, qx, qy, qz`` at ``n`` even arc lengths: spline positions, slerp rotations.
    A path is one group, bounded by its own waypoints."""
    import pyarrow as pa

    cols = ["x", "y", "z", "qw", "qx", "qy", "qz"]

    def smooth(key, table):
        table = table.sort_by("step")
        pos = np.stack([table.column(c).to_numpy() for c in XYZ], axis=1)
        rot = np.stack([table.column(c).to_numpy() for c in cols[3:]], axis=1)
        seg = np.linalg.norm(np.diff(pos, axis=0), axis=1)
        t = np.concatenate([[0.0], np.cumsum(seg)])
        keep = np.concatenate([[True], np.diff(t) > 0])
        t, pos, rot = t[keep], pos[keep], rot[keep]
        t = t / t[-1] if t[-1] > 0 else t
        at = np.linspace(0, 1, n)
        out = np.concatenate([natural_spline(t, pos, at), slerp(t, rot, at)], axis=1)
        return pa.table({"traj": pa.array([key[0].as_py()] * n, pa.int64()), "k": pa.array(np.arange(n, dtype=np.int32)), **{c: out[:, i] for i, c in enumerate(cols)}})

    src = path.select(F.col("traj").cast("long").alias("traj"), "step", *(F.col(c).cast("double").alias(c) for c in cols))
    return src.groupBy("traj").applyInArrow(smooth, "traj long, k int, " + ", ".join(f"{c} double" for c in cols))


# ---------------------------------------------------------------- readings


def tail(series: DataFrame, rows: int) -> DataFrame:
    back = F.row_number().over(W.partitionBy("traj").orderBy(F.desc("step")))
    return series.withColumn("back", back).where(F.col("back") <= rows)


def settle_verdict(series: DataFrame, radius: float, column: str = "z", window: int = 25, lag: int = 10) -> DataFrame:
    """Start, least, last and settled height (median of the last ``window`` rows), the motion over the last
    ``lag`` rows, and a verdict."""
    order = W.partitionBy("traj").orderBy(F.desc("step"))
    rows = series.withColumn("__b", F.row_number().over(order))
    nth = lambda k: F.max(F.when(F.col("__b") == k, F.col(column)))
    out = rows.groupBy("traj").agg(
        F.min_by(column, "step").alias("start"), F.min(column).alias("least"), nth(1).alias("final"),
        F.median(F.when(F.col("__b") <= window, F.col(column))).alias("settled"),
        F.abs(nth(1) - nth(lag)).alias("moved"),
    )
    rest = (F.abs(F.col("settled") - F.lit(radius)) < 0.06) & (F.col("moved") < 0.01)
    verdict = F.when(F.col("settled") < -1.0, "fell").when(F.col("settled") < -0.1, "tunnelled").when(rest, "rested").otherwise("partial")
    return out.withColumn("verdict", verdict)


def stand_verdict(series: DataFrame, settle_step: int, walk: bool = True, height: str = "z", forward: str = "x", window: int = 50) -> DataFrame:
    """Settled height, forward way since ``settle_step`` (a row's rank), whether it stood and moved."""
    w = W.partitionBy("traj")
    rows = series.withColumn("__b", F.row_number().over(w.orderBy(F.desc("step")))).withColumn("__i", F.row_number().over(w.orderBy("step")) - 1)
    at = lambda c, k, v: F.max(F.when(F.col(c) == k, F.col(v)))
    out = rows.groupBy("traj").agg(
        F.median(F.when(F.col("__b") <= window, F.col(height))).alias("settled"),
        (at("__b", 1, forward) - at("__i", settle_step, forward)).alias("dx"),
    )
    return out.withColumn("stood", F.col("settled") > 0.20).withColumn("moved", F.lit(walk) & (F.abs("dx") > 0.03))


# ---------------------------------------------------------------- generators


def orbit(spark: SparkSession, frames: int, radius: float, height: float) -> DataFrame:
    """Cameras on a circle: ``k, angle, x, y, z``."""
    a = F.col("id") * F.lit(2 * math.pi / frames)
    return spark.range(frames).select(F.col("id").cast("int").alias("k"), a.alias("angle"), (F.cos(a) * radius).alias("x"), (F.sin(a) * radius).alias("y"), F.lit(float(height)).alias("z"))


def trot(spark: SparkSession, steps: int, dt: float, hz: float, swing: float, lift: float) -> DataFrame:
    """Joint offsets of four legs, diagonal pairs in phase: ``step, leg, t, hip, knee``."""
    legs = F.explode(F.array(*(F.struct(F.lit(n).alias("leg"), F.lit(p).alias("p")) for n, p in (("FL", 0.0), ("FR", math.pi), ("RL", math.pi), ("RR", 0.0)))))
    rows = spark.range(steps).select(F.col("id").cast("int").alias("step"), (F.col("id") * F.lit(dt)).alias("t"), legs.alias("l"))
    phase = F.col("t") * F.lit(2 * math.pi * hz) + F.col("l.p")
    return rows.select("step", "l.leg", "t", (F.sin(phase) * swing).alias("hip"), (F.greatest(F.lit(0.0), F.cos(phase)) * lift).alias("knee"))


def interior_eyes(box: DataFrame, share: float = 0.45) -> DataFrame:
    """Four eyes inside a bounding box, at +-share of the extent on the first and third axis."""
    mid = {c: (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in XYZ}
    signs = F.explode(F.array(*(F.struct(F.lit(k).alias("eye"), F.lit(a).alias("sx"), F.lit(b).alias("sz")) for k, (a, b) in enumerate(((1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0))))))
    return box.withColumn("__s", signs).select(
        "__s.eye", (mid["x"] + F.col("__s.sx") * share * F.col("ext_x")).alias("x"), mid["y"].alias("y"), (mid["z"] + F.col("__s.sz") * share * F.col("ext_z")).alias("z")
    )


def goals(cells: DataFrame, centre: tuple[float, float], disc: float, n: int, seed: int = 0, tries: int = 300) -> DataFrame:
    """``n`` goal cells: of the first ``tries`` draws, cells in a seeded hash order, those in the central disc come
    first; if they are fewer than ``n``, the other draws follow in order."""
    from .cloud import sample_exact

    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pid").cast("string")))
    out = (F.col("x") - centre[0]) ** 2 + (F.col("y") - centre[1]) ** 2 > disc * disc
    return sample_exact(cells, max(n, tries), "pid", seed).orderBy(out, draw, "pid").limit(n)
