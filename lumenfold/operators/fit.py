"""Planes and normals fitted to points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import scratch
from lumenfold.functions import linalg

from . import cloud, nn, quantiles

XYZ = ("x", "y", "z")
SEED_ROWS = 3_000  # bound of the points that candidate planes are drawn from


def ransac_plane(df: DataFrame, threshold: float = 0.03, iterations: int = 2_000, seed: int = 0, up: Sequence[float] | None = None) -> tuple[np.ndarray, float, int]:
    """(unit normal, offset, inliers) of the plane n.p + d = 0 with most points within ``threshold``, refitted
    to them. Candidates come from a bounded sample in hash order; all points vote, each task with one sum
    per candidate. ``up`` fixes the normal's sign."""
    import pyarrow as pa

    sample = cloud.sample_exact(df.select("pid", *XYZ), SEED_ROWS, seed=seed).select(*XYZ).toPandas().to_numpy(float)
    if len(sample) < 3:
        raise ValueError("a plane needs three points")
    rng = np.random.default_rng(seed)
    pick = np.stack([rng.choice(len(sample), 3, replace=False) for _ in range(iterations)])
    a, b, c = (sample[pick[:, k]] for k in range(3))
    normal = np.cross(b - a, c - a)
    length = np.linalg.norm(normal, axis=1)
    ok = length > 1e-12
    if not ok.any():
        raise ValueError("the points are on one line")
    normal = normal[ok] / length[ok, None]
    offset = -(normal * a[ok]).sum(axis=1)
    shared = df.sparkSession.sparkContext.broadcast((normal, offset))

    def vote(batches) -> Iterator:
        n, d = shared.value
        total = np.zeros(len(d), dtype=np.int64)
        for batch in batches:
            p = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            for lo in range(0, len(p), 2_000):
                total += (np.abs(p[lo : lo + 2_000] @ n.T + d) < threshold).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(d))), pa.array(total)], ["k", "votes"])

    rows = df.select(*(F.col(x).cast("double").alias(x) for x in XYZ))
    best = rows.mapInArrow(vote, "k long, votes long").groupBy("k").agg(F.sum("votes").alias("votes")).orderBy(F.desc("votes"), "k").first()
    n, d = normal[best["k"]], float(offset[best["k"]])
    near = rows.where(F.abs(F.lit(float(n[0])) * F.col("x") + F.lit(float(n[1])) * F.col("y") + F.lit(float(n[2])) * F.col("z") + F.lit(d)) < threshold)
    s = near.agg(*(F.avg(x).alias(f"m{x}") for x in XYZ), *(F.covar_pop(x, y).alias(f"c{x}{y}") for i, x in enumerate(XYZ) for y in XYZ[i:])).first()
    cov = np.array([[s[f"c{min(x, y)}{max(x, y)}"] for y in XYZ] for x in XYZ])
    n = np.linalg.eigh(cov)[1][:, 0]
    if up is not None and n @ np.asarray(up, float) < 0:
        n = -n
    return n, float(-n @ [s[f"m{x}"] for x in XYZ]), int(best["votes"])


def align_floor(df: DataFrame, axis: str = "z", threshold: float = 0.03, seed: int = 0) -> DataFrame:
    """Cloud turned so that the floor, the main plane of its low band, is level, and shifted so that the
    median height of the floor's points is zero."""
    up = [1.0 if x == axis else 0.0 for x in XYZ]
    n, d, _ = ransac_plane(cloud.floor_band(df, axis), threshold, seed=seed, up=up)
    on = F.abs(F.lit(float(n[0])) * F.col("x") + F.lit(float(n[1])) * F.col("y") + F.lit(float(n[2])) * F.col("z") + F.lit(d)) < threshold
    rows = linalg.with_alignment(df.withColumn("__on", on), tuple(map(float, n)), up, "__t", "cross")
    turned = linalg.rotate(linalg.columns_matrix("__t"), [F.col(x) for x in XYZ])
    rows = rows.withColumns(dict(zip(XYZ, turned)))
    height = quantiles.row(rows.where("__on"), __h=(axis, 0.5))
    rows = rows.join(F.broadcast(height), F.lit(True))
    return rows.select(*((F.col(c) - F.col("__h")).alias(c) if c == axis else F.col(c) for c in df.columns))


def gravity_align(df: DataFrame, cameras: DataFrame, axis: str = "y") -> DataFrame:
    """Cloud turned so that the cameras' mean up-direction (minus the second column of ``c2w``) is the axis,
    its low percentile at zero."""
    mean = cameras.agg(*(F.avg(-F.col("c2w")[k][1]).alias(f"__u{k}") for k in range(3)))
    target = [1.0 if x == axis else 0.0 for x in XYZ]
    turn = linalg.with_alignment(mean, [F.col(f"__u{k}") for k in range(3)], target, "__t").drop("__u0", "__u1", "__u2")
    rows = df.join(F.broadcast(turn), F.lit(True))
    turned = linalg.rotate(linalg.columns_matrix("__t"), [F.col(x) for x in XYZ])
    out = rows.select(*(dict(zip(XYZ, turned))[c].alias(c) if c in XYZ else F.col(c) for c in df.columns))
    return cloud.floor_drop(out, axis)


def estimate_normals(df: DataFrame, k: int = 30, strategy: str = "auto", toward: Sequence[float] | None = None, radius: float | None = None) -> DataFrame:
    """Points with ``nx, ny, nz``: the direction of least spread of the ``k`` nearest points (itself
    included), of those within ``radius`` if that is given. Covariances are plain aggregates; only the 3 x 3 eigenvectors are NumPy. Signs look
    ``toward`` a place, or make the largest component positive."""
    import pyarrow as pa

    near = nn.k_nearest(df, df, k, strategy)
    near = (near if radius is None else near.where(F.col("dist") <= radius)).select("qid", "pid").join(df.select("pid", *XYZ), "pid")
    pairs = [(x, y) for i, x in enumerate(XYZ) for y in XYZ[i:]]
    cov = near.groupBy("qid").agg(*(F.covar_pop(x, y).alias(x + y) for x, y in pairs))
    rows = df.drop("nx", "ny", "nz").join(cov.withColumnRenamed("qid", "pid"), "pid")
    view = tuple(map(float, toward)) if toward is not None else None

    def solve(batches) -> Iterator:
        for batch in batches:
            col = lambda c: np.nan_to_num(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False))  # noqa: B023, E731
            m = np.zeros((batch.num_rows, 3, 3))
            for x, y in pairs:
                i, j = XYZ.index(x), XYZ.index(y)
                m[:, i, j] = m[:, j, i] = col(x + y)
            n = np.linalg.eigh(m)[1][:, :, 0] if len(m) else np.zeros((0, 3))
            ref = np.asarray(view) - np.stack([col(c) for c in XYZ], axis=1) if view else None
            sign = (n * ref).sum(axis=1) if view else np.take_along_axis(n, np.abs(n).argmax(axis=1)[:, None], axis=1)[:, 0]
            n = np.where(sign[:, None] < 0, -n, n)
            kept = [k for k, c in enumerate(batch.schema.names) if c not in {x + y for x, y in pairs}]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), *(pa.array(np.ascontiguousarray(n[:, k])) for k in range(3))], [*(batch.schema.names[k] for k in kept), "nx", "ny", "nz"]
            )

    schema = df.drop("nx", "ny", "nz").select("pid", *[c for c in df.columns if c not in ("pid", "nx", "ny", "nz")]).schema
    for c in ("nx", "ny", "nz"):
        schema = schema.add(c, "double")
    return scratch.table(rows, "spread").mapInArrow(solve, schema)


def work_list(inputs: Sequence[str], outputs: Sequence[str], budgets: Sequence[int], spark) -> DataFrame:
    """``n, src, out, target`` of a batch of meshes; the three lists must be of one length."""
    if not len(inputs) == len(outputs) == len(budgets):
        raise ValueError("inputs, outputs and budgets differ in length")
    return spark.createDataFrame([(k, *row) for k, row in enumerate(zip(inputs, outputs, budgets))], "n int, src string, out string, target int")
