"""Point-cloud filters, samples and group-bys over rows ``pid, x, y, z, ...``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold import scratch

from . import nn, quantiles

XYZ = ("x", "y", "z")
PART_ROWS = 2_000_000  # rows of a range partition on average


def _with_row(df: DataFrame, aggs: Sequence[Column]) -> DataFrame:
    """``df`` beside a broadcast aggregate of one row."""
    return df.join(F.broadcast(df.agg(*aggs)), F.lit(True))


def _with_quantiles(df: DataFrame, **wanted) -> DataFrame:
    """``df`` beside a broadcast row of exact quantiles."""
    return df.join(F.broadcast(quantiles.row(df, **wanted)), F.lit(True))


def bounding_box(df: DataFrame) -> DataFrame:
    out = df.agg(*(f(c).alias(f"{n}_{c}") for c in XYZ for f, n in ((F.min, "lo"), (F.max, "hi"))))
    ext = [F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in XYZ]
    return out.withColumns({f"ext_{c}": e for c, e in zip(XYZ, ext)}).withColumn("diagonal", F.sqrt(ext[0] * ext[0] + ext[1] * ext[1] + ext[2] * ext[2]))


def room_axis(box: DataFrame) -> DataFrame:
    """Index of the shortest extent, the first of equals."""
    e = F.array(*(F.col(f"ext_{c}") for c in XYZ))
    return box.withColumn("up_axis", (F.array_position(e, F.array_min(e)) - 1).cast("int"))


def voxel_downsample(df: DataFrame, size: float, means: Sequence[str] = XYZ) -> DataFrame:
    """Mean of each column per cubic cell; cells start half a cell below the least corner."""
    box = df.agg(*(F.min(c).alias(f"lo_{c}") for c in XYZ))
    cell = [F.floor((F.col(c) - (F.col(f"lo_{c}") - F.lit(size / 2))) / F.lit(float(size))).cast("long").alias(f"i{c}") for c in XYZ]
    rows = df.join(F.broadcast(box), F.lit(True)).select(*cell, *means)
    return rows.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in means))


def crop_flyers(df: DataFrame, q: float = 0.99) -> DataFrame:
    """Rows nearer to the per-axis median than the ``q`` quantile of those distances."""
    centred = _with_quantiles(df, **{f"__m{c}": (c, 0.5) for c in XYZ})
    d = [F.col(c) - F.col(f"__m{c}") for c in XYZ]
    far = centred.withColumn("__d", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return _with_quantiles(far, __q=("__d", q)).where("__d < __q").select(*df.columns)


def crop_axis(df: DataFrame, half: float, axis: str = "z") -> DataFrame:
    """Rows within ``half`` of the axis' median; all if ``half`` is not positive."""
    if half <= 0:
        return df
    return _with_quantiles(df, __m=(axis, 0.5)).where(F.abs(F.col(axis) - F.col("__m")) < half).select(*df.columns)


def quantile_trim(df: DataFrame, column: str, q: float) -> DataFrame:
    """Drop rows strictly below the quantile."""
    return _with_quantiles(df, __q=(column, q)).where(F.col(column) >= F.col("__q")).select(*df.columns)


def confidence_mask(df: DataFrame, column: str, percentile: float) -> DataFrame:
    return _with_quantiles(df, __q=(column, percentile / 100.0)).where(F.col(column) > F.col("__q")).select(*df.columns)


def prune_splats(df: DataFrame, opacity_over: float = 0.1, scale_q: float = 0.99, needle: float = 25.0, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Splats that are visible, not huge, not needles and inside the robust box. ``opacity`` is a logit,
    ``s0..s2`` are log scales."""
    s = [F.exp(f"s{k}") for k in range(3)]
    rows = df.withColumns({"__max": F.greatest(*s), "__min": F.least(*s), "__op": 1.0 / (1.0 + F.exp(-F.col("opacity")))})
    keep = (F.col("__op") > opacity_over) & (F.col("__max") < F.col("__q")) & (F.col("__max") / F.greatest(F.col("__min"), F.lit(1e-9)) < needle)
    for c in XYZ:
        keep &= (F.col(c) > F.col(f"__b{c}")[0]) & (F.col(c) < F.col(f"__b{c}")[1])
    return _with_quantiles(rows, __q=("__max", scale_q), **{f"__b{c}": (c, [lo, hi]) for c in XYZ}).where(keep).select(*df.columns)


def robust_extent(df: DataFrame, lo: float = 0.02, hi: float = 0.98, cells: int = 512) -> DataFrame:
    """Largest extent between two quantiles, and the voxel that divides it into ``cells``."""
    q = quantiles.row(df, **{c: (c, [lo, hi]) for c in XYZ})
    e = F.greatest(*(F.col(c)[1] - F.col(c)[0] for c in XYZ))
    return q.select(e.alias("extent"), (e / cells).alias("voxel"))


def init_scale(df: DataFrame, floor: float = 5e-4) -> DataFrame:
    """Centroid, mean radius, largest extent and the starting splat scale."""
    c = _with_row(df, [F.avg(x).alias(f"__c{x}") for x in XYZ])
    d = [F.col(x) - F.col(f"__c{x}") for x in XYZ]
    out = c.agg(
        *(F.first(f"__c{x}").alias(f"c{x}") for x in XYZ),
        F.avg(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("mean_radius"),
        F.greatest(*(F.max(x) - F.min(x) for x in XYZ)).alias("extent"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("init_scale", F.greatest(F.col("extent") / F.cbrt("n"), F.lit(floor)))


def floor_band(df: DataFrame, axis: str = "z", share: float = 0.25, least: int = 1000) -> DataFrame:
    """Rows in the lowest share of the axis' extent; all rows if they are fewer than ``least``."""
    box = df.agg(F.min(axis).alias("__lo"), F.max(axis).alias("__hi"))
    rows = df.join(F.broadcast(box), F.lit(True)).withColumn("__in", F.col(axis) < F.col("__lo") + share * (F.col("__hi") - F.col("__lo")))
    return _with_row(rows, [F.count_if("__in").alias("__n")]).where((F.col("__n") < least) | F.col("__in")).select(*df.columns)


def floor_drop(df: DataFrame, axis: str = "y", q: float = 0.01) -> DataFrame:
    """Shift so that the axis' low percentile is at zero."""
    rows = _with_quantiles(df, __q=(axis, q))
    return rows.select(*((F.col(c) - F.col("__q")).alias(c) if c == axis else F.col(c) for c in df.columns))


def normalise_view(df: DataFrame, size: float = 3.0) -> DataFrame:
    """One translation and scale for all layers: the box is centred and its largest extent is ``size``."""
    rows = df.join(F.broadcast(bounding_box(df)), F.lit(True))
    scale = F.lit(size) / F.greatest(*(F.col(f"ext_{c}") for c in XYZ))
    moved = {c: (F.col(c) - (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2) * scale for c in XYZ}
    return rows.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in df.columns))


def pca_2d(df: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """Sample covariance of two columns, its eigenvalues and the major axis (direction up to sign)."""
    c = df.agg(F.var_samp(a).alias("vaa"), F.covar_samp(a, b).alias("vab"), F.var_samp(b).alias("vbb"))
    half = (F.col("vaa") - F.col("vbb")) / 2
    root = F.sqrt(half * half + F.col("vab") * F.col("vab"))
    mid = (F.col("vaa") + F.col("vbb")) / 2
    angle = F.atan2(2 * F.col("vab"), F.col("vaa") - F.col("vbb")) / 2
    return c.withColumns({"major": mid + root, "minor": mid - root, "axis_a": F.cos(angle), "axis_b": F.sin(angle)})


def align_2d(df: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """Columns ``ra, rb``: centred rows in the principal axes, the longer span first, without mirroring."""
    mean = df.agg(F.avg(a).alias("__ma"), F.avg(b).alias("__mb"))
    rows = df.join(F.broadcast(pca_2d(df, a, b).select("axis_a", "axis_b")), F.lit(True)).join(F.broadcast(mean), F.lit(True))
    da, db = F.col(a) - F.col("__ma"), F.col(b) - F.col("__mb")
    rows = rows.withColumns({"__u": F.col("axis_a") * da + F.col("axis_b") * db, "__v": F.col("axis_a") * db - F.col("axis_b") * da})
    rows = _with_row(rows, [(F.max("__v") - F.min("__v") > F.max("__u") - F.min("__u")).alias("__tall")])
    return rows.select(
        *df.columns, F.when(F.col("__tall"), F.col("__v")).otherwise(F.col("__u")).alias("ra"), F.when(F.col("__tall"), -F.col("__u")).otherwise(F.col("__v")).alias("rb")
    )


def outlier_removal(df: DataFrame, k: int = 16, sigmas: float = 2.0, strategy: str = "auto") -> DataFrame:
    """Drop points whose mean distance to their ``k`` nearest others exceeds mean + ``sigmas`` sample
    deviations of those means."""
    d = nn.k_nearest(df, df, k, strategy, skip_self=True).groupBy("qid").agg(F.avg("dist").alias("__d")).withColumnRenamed("qid", "pid")
    d = scratch.table(d, "knn")
    far = _with_row(d, [(F.avg("__d") + F.lit(sigmas) * F.stddev_samp("__d")).alias("__bar")]).where("__d > __bar").select("pid")
    return df.join(far, "pid", "left_anti")


# ---------------------------------------------------------------- samples


def sample_exact(df: DataFrame, n: int, key: str = "pid", seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the least in a seeded hash order: the same on any partitioning. A
    large table is first thinned on the executors to little more than ``n``."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    total = df.count()
    few = df.where(draw < f"{int((1 << 48) * (1.2 * n + 100) / total):012x}") if total > 2 * n + 1000 else df
    # The hash decides how many pass; should they be too few, all rows are ordered.
    return (few if few is df or not n or few.count() >= n else df).orderBy(draw, key).limit(n)


def ordinal(df: DataFrame, *order: str) -> DataFrame:
    """Add ``ord`` from 0 in a global order, without gathering the rows: counts per range partition give
    each partition its base."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS), 1)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Written, so that both passes see the same partitions; the partition's number rides along.
    kept = scratch.table(ranged.withColumn("__p", F.spark_partition_id()), "ranged")
    counts = kept.groupBy("__p").count()
    base = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("__p", F.coalesce(F.sum("count").over(base), F.lit(0)).alias("__b"))
    within = W.partitionBy("__p").orderBy(*order)
    return kept.join(F.broadcast(bases), "__p").withColumn("ord", (F.row_number().over(within) - 1 + F.col("__b")).cast("long")).drop("__p", "__b")


def even_subsample(df: DataFrame, m: int, *order: str) -> DataFrame:
    """Rows at the ``m`` distinct truncated positions of an even spacing from first to last."""
    rows = ordinal(df, *order)
    n = rows.count()
    if n <= m:
        return rows
    if m == 1:
        return rows.where("ord = 0")
    step = (n - 1) / (m - 1)
    spark = df.sparkSession
    at = F.when(F.col("id") == m - 1, F.lit(n - 1)).otherwise(F.floor(F.col("id") * F.lit(float(step)))).cast("long")
    return rows.join(spark.range(m).select(at.alias("ord")).distinct(), "ord", "left_semi")


def stride(df: DataFrame, k: int, *order: str) -> DataFrame:
    return ordinal(df, *order).where(F.col("ord") % k == 0)


# ---------------------------------------------------------------- pixels


def z_buffer(df: DataFrame, px: str = "px", py: str = "py", z: str = "depth", payload: Sequence[str] = ()) -> DataFrame:
    """Nearest row of each pixel (least depth, then least pid)."""
    s = F.struct(F.col(z).alias("z"), F.col("pid").alias("pid"), *payload)
    return df.groupBy(px, py).agg(F.min(s).alias("s")).select(px, py, F.col("s.z").alias(z), "s.pid", *(f"s.{c}" for c in payload))


def splat_squares(df: DataFrame, size: int, width: int, height: int, px: str = "px", py: str = "py") -> DataFrame:
    """Each point as a square of ``size`` pixels, clipped at the image's edge."""
    o = F.sequence(F.lit(0), F.lit(size - 1))
    out = df.withColumn("__dx", F.explode(o)).withColumn("__dy", F.explode(o))
    clamp = lambda c, d, m: F.least(F.greatest(F.col(c) + F.col(d), F.lit(0)), F.lit(m - 1)).alias(c)
    rest = [c for c in df.columns if c not in (px, py)]
    return out.select(*rest, clamp(px, "__dx", width), clamp(py, "__dy", height))
