"""Nearest-neighbour, range and anti joins between point sets, exact at any size.

Points are rows ``pid, x, y, z``. Two strategies give the same result:

* ``broadcast``: the reference side, if its counted size allows, is one NumPy array on each executor
  and every batch of queries meets it there, through cells too once it has more than ``BRUTE`` points;
  nothing is shuffled.
* ``grid``: both sides are hashed to cubic cells and met cell by cell with their 27 neighbours, the
  cell doubling for queries that found nothing near enough, so an answer is exact when its distance
  is at most the cell. The cell starts at the size that holds a few points on average, halved while the
  points are so uneven that the average point shares its cell with many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold import scratch

from . import quantiles

XYZ = ("x", "y", "z")
PER_CELL = 1  # points of a cell that the first grid aims at, for each neighbour wanted: four times as many are as near as a cell is wide
BRUTE = 2_000  # points up to which the broadcast side is scanned whole
PAIRS = 500_000  # distances held at once, some 130 bytes each in a task


def _cells(size: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(float(size))).cast("long") for c in XYZ]


def _with_cells(df: DataFrame, size: float, names: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    return df.withColumns({n: c for n, c in zip(names, _cells(size))})


def _spread(df: DataFrame) -> DataFrame:
    """Each row once for its cell and each of the 26 around it."""
    for c in ("cx", "cy", "cz"):
        df = df.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    return df


def distance_between(a: str = "q", b: str = "p") -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in XYZ]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def k_nearest(queries: DataFrame, points: DataFrame, k: int = 1, strategy: str = "auto", skip_self: bool = False) -> DataFrame:
    """``qid, rank, pid, dist``: the ``k`` nearest points of each query, ties to the smaller pid.
    ``skip_self`` leaves out the point with the query's own id. Queries get fewer rows if there are fewer
    points, and none if there are none."""
    q = queries.select(F.col("pid").alias("qid"), *(F.col(c).cast("double").alias(f"q{c}") for c in XYZ))
    p = points.select("pid", *(F.col(c).cast("double").alias(f"p{c}") for c in XYZ))
    if strategy == "auto":
        strategy = "broadcast" if scratch.fits(p) else "grid"
    if strategy == "broadcast":
        return _scan(q, p, k, skip_self)
    return _rings(q, p, k, skip_self)


def _scan(q: DataFrame, p: DataFrame, k: int, skip_self: bool) -> DataFrame:
    import pyarrow as pa

    rows = p.toPandas().sort_values("pid")
    shared = q.sparkSession.sparkContext.broadcast((rows["pid"].to_numpy(np.int64), rows[["px", "py", "pz"]].to_numpy(np.float64)))

    def run(batches) -> Iterator:
        ids, pts = shared.value
        cells = Cells(ids, pts, k + skip_self) if len(ids) > BRUTE else None
        for batch in batches:
            qid = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
            if cells:
                for q, rank, pid, dist in cells.nearest(qid, at, k, skip_self):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(rank.astype(np.int32)), pa.array(pid), pa.array(dist)], ["qid", "rank", "pid", "dist"])
                continue
            step = max(1, PAIRS // max(1, len(ids)))
            for lo in range(0, len(qid), step):
                a = at[lo : lo + step]
                d = (a[:, None, 0] - pts[None, :, 0]) ** 2
                d += (a[:, None, 1] - pts[None, :, 1]) ** 2
                d += (a[:, None, 2] - pts[None, :, 2]) ** 2
                d = np.sqrt(d)
                if skip_self:
                    d[qid[lo : lo + step, None] == ids[None, :]] = np.inf
                n = min(k, len(ids))
                if n == 0:
                    continue
                if n == 1:
                    best = d.argmin(axis=1)[:, None]
                elif len(ids) > 4 * n:
                    # All that are not farther than the n-th, so that ties are settled by id.
                    bar = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                    best = np.argsort(np.where(d <= bar, d, np.inf), axis=1, kind="stable")[:, :n]
                else:
                    best = np.argsort(d, axis=1, kind="stable")[:, :n]
                dist = np.take_along_axis(d, best, axis=1)
                ok = np.isfinite(dist).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(qid[lo : lo + step], n)[ok]),
                        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(a))[ok]),
                        pa.array(ids[best].ravel()[ok]),
                        pa.array(dist.ravel()[ok]),
                    ],
                    ["qid", "rank", "pid", "dist"],
                )

    return q.mapInArrow(run, "qid long, rank int, pid long, dist double")


class Cells:
    """Points of one array in cubic cells: a query meets the 27 around it, and those that found nothing near
    enough meet cells of twice the size."""

    def __init__(self, ids: np.ndarray, pts: np.ndarray, per: int):
        self.ids, self.pts = ids, pts
        self.low = pts.min(axis=0)
        self.span = float((pts.max(axis=0) - self.low).max()) or 1.0
        self.size = max(self.span / max(1.0, (len(ids) / (PER_CELL * per)) ** (1 / 3)), self.span / (1 << 19))
        # Uneven points: smaller cells while the average point has many around it.
        while self.size > self.span / (1 << 12) and self.crowd(self.size) > 8 * PER_CELL * per:
            self.size /= 2
        self.levels: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def key(self, at: np.ndarray, size: float) -> np.ndarray:
        """Cell numbers of places, clipped to one cell beyond the points' box."""
        c = np.clip(np.floor((at - self.low) / size), -2, self.span / size + 2).astype(np.int64) + 2
        return (c[:, 0] << 42) | (c[:, 1] << 21) | c[:, 2]

    def crowd(self, size: float) -> float:
        n = np.unique(self.key(self.pts, size), return_counts=True)[1]
        return float((n.astype(float) ** 2).sum() / n.sum())

    def sorted(self, size: float) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.levels:
            key = self.key(self.pts, size)
            order = np.argsort(key, kind="stable")
            self.levels[size] = key[order], order
        return self.levels[size]

    def nearest(self, qid: np.ndarray, at: np.ndarray, k: int, skip_self: bool) -> Iterator:
        """(query rows, ranks, ids, distances) of the ``k`` nearest of each query."""
        left, size = np.arange(len(qid)), self.size
        # From here on the 27 cells hold every point, whatever the query.
        reach = max(self.span, float(np.abs(at - self.low).max(initial=0.0))) * 2 + self.span
        while len(left):
            whole = size >= reach
            keys, order = self.sorted(size)
            if whole:
                start, end = np.zeros((1, len(left)), np.int64), np.full((1, len(left)), len(order))
            else:
                steps = [(x << 42) + (y << 21) + z for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
                own = self.key(at[left], size)
                start, end = (np.stack([np.searchsorted(keys, own + s, side) for s in steps]) for side in ("left", "right"))
            total = (end - start).sum(axis=0)
            again = []
            cut = np.cumsum(total) // PAIRS
            for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(cut)) + 1):
                n = (end - start)[:, part].T.ravel()
                q = np.repeat(np.repeat(part, len(start)), n)
                p = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[:, part].T.ravel(), n)]
                if skip_self:
                    other = self.ids[p] != qid[left[q]]
                    q, p = q[other], p[other]
                d = at[left[q]] - self.pts[p]
                dist = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
                if not whole:
                    # What is farther than a cell settles no query at this size.
                    q, p, dist = (v[dist <= size] for v in (q, p, dist))
                best = np.lexsort((self.ids[p], dist, q))
                q, p, dist = q[best], p[best], dist[best]
                rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
                q, p, dist, rank = (v[rank <= k] for v in (q, p, dist, rank))
                sure = np.zeros(len(left), dtype=bool)
                sure[q[(rank == k) & (dist <= size)]] = True
                sure[part] |= whole
                keep = sure[q]
                yield left[q[keep]], rank[keep], self.ids[p[keep]], dist[keep]
                again.append(left[part[~sure[part]]])
            left, size = np.concatenate(again), size * 2


def _rings(q: DataFrame, p: DataFrame, k: int, skip_self: bool) -> DataFrame:
    spark = q.sparkSession
    p, q = scratch.table(p, "points"), scratch.table(q, "queries")
    box = p.agg(F.count(F.lit(1)).alias("n"), *(f(f"p{c}").alias(f"{n}{c}") for c in XYZ for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    reach = q.agg(*(f(f"q{c}").alias(f"{n}{c}") for c in XYZ for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    if not box["n"] or reach["lox"] is None:
        return spark.createDataFrame([], "qid long, rank int, pid long, dist double")
    span = lambda *rows: max(max(r[f"hi{c}"] for r in rows) - min(r[f"lo{c}"] for r in rows) for c in XYZ)
    wide = span(box, reach) or 1.0
    size = (span(box) or 1.0) / max(1.0, (box["n"] / (PER_CELL * k)) ** (1 / 3))
    order = W.partitionBy("qid").orderBy("dist", "pid")
    for _ in range(12):
        crowd = p.groupBy(*(F.floor(F.col(f"p{c}") / F.lit(size)) for c in XYZ)).agg(F.count(F.lit(1)).cast("double").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("c")).first()["c"]
        if crowd <= 8 * PER_CELL * k:
            break
        size /= 2
    named = lambda df, s, cell: df.withColumns({f"c{c}": F.floor(F.col(f"{s}{c}") / F.lit(cell)).cast("long") for c in XYZ})
    done, left = [], q
    while True:
        last = size >= 2 * wide  # then the 27 cells hold every point
        met = _spread(named(left, "q", size)).join(named(p, "p", size), ["cx", "cy", "cz"])
        if skip_self:
            met = met.where("qid <> pid")
        met = met.withColumn("dist", distance_between())
        if not last:
            # What is farther than a cell settles no query at this size, so it need not be sorted.
            met = met.where(F.col("dist") <= size)
        met = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        met = met.select("qid", "rank", "pid", "dist")
        if last:
            done.append(met)
            break
        met = scratch.table(met, "met")
        sure = met.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).where((F.col("n") == k) & (F.col("far") <= size)).select("qid")
        done.append(met.join(sure, "qid", "left_semi"))
        left = scratch.table(left.join(sure, "qid", "left_anti"), "left")
        if left.isEmpty():
            break
        size *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def nearest(queries: DataFrame, points: DataFrame, strategy: str = "auto") -> DataFrame:
    """``qid, pid, dist``."""
    return k_nearest(queries, points, 1, strategy).select("qid", "pid", "dist")


def within(queries: DataFrame, points: DataFrame, tau: float, strategy: str = "auto") -> DataFrame:
    """Ids (``pid``) of queries that have a point at a distance of at most ``tau``.

    The grid form first settles queries that share a cell of side tau / sqrt(3) with a point, which
    needs no pairs at all; only the rest meets points of the 27 cells of side tau around it."""
    if strategy == "auto":
        strategy = "broadcast" if scratch.fits(points) else "grid"
    if strategy == "broadcast":
        return nearest(queries, points, "broadcast").where(F.col("dist") <= tau).select(F.col("qid").alias("pid"))
    fine = max(tau / 3**0.5 * (1 - 1e-9), 1e-300)
    q = queries.select("pid", *XYZ)
    p = points.select(*XYZ)
    cells = ["cx", "cy", "cz"]
    easy = _with_cells(q, fine).join(_with_cells(p, fine).select(*cells).distinct(), cells, "left_semi").select("pid")
    coarse = max(tau * (1 + 1e-9), 1e-300)
    hard = _spread(_with_cells(q.join(easy, "pid", "left_anti"), coarse))
    hard = hard.select("pid", *cells, *(F.col(c).alias(f"q{c}") for c in XYZ))
    targets = _with_cells(p, coarse).select(*cells, *(F.col(c).alias(f"p{c}") for c in XYZ))
    found = hard.join(targets, cells).where(distance_between() <= tau).select("pid").distinct()
    return easy.unionByName(found).distinct()


def gap_points(donor: DataFrame, backbone: DataFrame, tau: float, strategy: str = "auto") -> DataFrame:
    """Donor rows without a backbone point within ``tau``: what is exactly ``tau`` away is no gap."""
    return donor.join(within(donor, backbone, tau, strategy), "pid", "left_anti")


def fuse(backbone: DataFrame, donor: DataFrame, tau: float, strategy: str = "auto") -> DataFrame:
    """Backbone and donor gap points with a ``part`` column."""
    gaps = gap_points(donor, backbone, tau, strategy)
    return backbone.withColumn("part", F.lit("backbone")).unionByName(gaps.withColumn("part", F.lit("donor")), allowMissingColumns=True)


def void_fill(base: DataFrame, donors: Sequence[tuple[str, DataFrame, float]], strategy: str = "auto") -> DataFrame:
    """Donors in order, each filling what all accepted points so far leave open at its own distance."""
    out = base.withColumn("part", F.lit("base"))
    for name, donor, tau in donors:
        gaps = gap_points(donor, out, tau, strategy)
        out = out.unionByName(gaps.withColumn("part", F.lit(name)), allowMissingColumns=True)
    return out


def fuse_diagnostics(donor: DataFrame, backbone: DataFrame, tau: float, strategy: str = "auto") -> DataFrame:
    d = scratch.table(nearest(donor, backbone, strategy).select("dist"), "nearest")
    stats = d.agg(
        F.count(F.lit(1)).alias("donor_pts"),
        F.count_if(F.col("dist") > tau).alias("donor_gapfill_pts"), F.avg((F.col("dist") > tau).cast("int")).alias("donor_gapfill_frac"),
    )
    stats = stats.join(F.broadcast(quantiles.row(d, q=("dist", [0.25, 0.5, 0.75]))), F.lit(True))
    return stats.join(scratch.one_row(backbone.agg(F.count(F.lit(1)).alias("backbone_pts"))), F.lit(True)).select(
        "backbone_pts", "donor_pts", F.col("q")[0].alias("donor_nn_p25_m"), F.col("q")[1].alias("donor_nn_median_m"),
        F.col("q")[2].alias("donor_nn_p75_m"), "donor_gapfill_pts", "donor_gapfill_frac",
    )


def transfer(queries: DataFrame, points: DataFrame, columns: Sequence[str], strategy: str = "auto") -> DataFrame:
    """Queries with ``dist`` and the nearest point's ``columns`` (prefixed ``near_``)."""
    n = nearest(queries, points, strategy)
    payload = points.select("pid", *(F.col(c).alias(f"near_{c}") for c in columns))
    return queries.join(n.join(payload, "pid").drop("pid").withColumnRenamed("qid", "pid"), "pid")


def pairs_within(points: DataFrame, radius: float) -> DataFrame:
    """``a, b`` (a < b) of points at most ``radius`` apart: the edges of a radius graph, met in cells of that
    side. Each pair of neighbouring cells is looked at from the cell of its smaller id only."""
    size = max(radius * (1 + 1e-9), 1e-300)
    left = _spread(_with_cells(points.select("pid", *XYZ), size)).select(F.col("pid").alias("a"), "cx", "cy", "cz", *(F.col(c).alias(f"q{c}") for c in XYZ))
    right = _with_cells(points.select("pid", *XYZ), size).select(F.col("pid").alias("b"), "cx", "cy", "cz", *(F.col(c).alias(f"p{c}") for c in XYZ))
    return left.join(right, ["cx", "cy", "cz"]).where((F.col("a") < F.col("b")) & (distance_between() <= radius)).select("a", "b")
