"""Holes of a mesh: open edges in order around each, and triangles that close them.

The border of a hole runs against the triangles beside it: a side (u, v) that no other triangle has makes a step
from v to u. Steps form rings; where several meet in one vertex it is not clear how to go on, and these rings are
left open. A vertex finds its place in its ring by pointer doubling towards the ring's least vertex: the number
of rounds is the logarithm of the longest ring that may be filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import scratch

from . import cloud, graph

MOST = 1_000  # edges of a hole that is filled


def open_steps(triangles: DataFrame) -> DataFrame:
    """``at, to``: steps along the holes."""
    sides = F.explode(F.array(*(F.struct(F.col(p).alias("to"), F.col(q).alias("at")) for p, q in ("ab", "bc", "ca")))).alias("s")
    rows = triangles.select(sides).select("s.*")
    lone = rows.groupBy(F.least("at", "to").alias("u"), F.greatest("at", "to").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.first("at").alias("at"), F.first("to").alias("to"))
    return lone.where("n = 1 and at <> to").select("at", "to")


def rings(triangles: DataFrame, most: int = MOST) -> DataFrame:
    """``hole`` (its least vertex), ``place`` from 0, ``vid, next`` and ``size`` of holes of 3 to ``most`` edges."""
    steps = scratch.table(open_steps(triangles), "steps")
    found = graph.components(steps, "at", "to")
    steps = steps.join(found.select(F.col("node").alias("at"), F.col("component").alias("hole")), "at")
    degree = steps.select("hole", "at", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(steps.select("hole", F.col("to").alias("at"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    degree = degree.groupBy("hole", "at").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    good = degree.groupBy("hole").agg(F.count(F.lit(1)).alias("size"), F.bool_and((F.col("out") == 1) & (F.col("into") == 1)).alias("ring"))
    good = good.where(F.col("ring") & F.col("size").between(3, most)).select("hole", "size")
    ring = scratch.table(steps.join(good, "hole").select("hole", "size", F.col("at").alias("vid"), F.col("to").alias("next")), "rings")
    # Steps to the least vertex, which stands still.
    head = F.col("vid") == F.col("hole")
    jump = scratch.table(ring.select("vid", F.when(head, F.col("vid")).otherwise(F.col("next")).alias("ptr"), F.when(head, 0).otherwise(1).alias("far")), "jump")
    reach = 1
    while reach < most and not jump.join(ring.select("vid", "hole"), "vid").where("ptr <> hole").isEmpty():
        ahead = jump.select(F.col("vid").alias("ptr"), F.col("ptr").alias("__ptr"), F.col("far").alias("__far"))
        jump = scratch.table(jump.join(ahead, "ptr").select("vid", F.col("__ptr").alias("ptr"), (F.col("far") + F.col("__far")).alias("far")), "jump")
        reach *= 2
    return ring.join(jump.select("vid", "far"), "vid").select("hole", ((F.col("size") - F.col("far")) % F.col("size")).cast("long").alias("place"), "vid", "next", F.col("size").cast("long").alias("size"))


def fill_holes(triangles: DataFrame, vertices: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(triangles, vertices) with the holes of at most ``most`` edges closed: three edges by one triangle, more by a
    fan around a new vertex in their middle, whose numbers are the means of the ring's. New triangles and vertices
    have ids after the greatest old ones, in the order of the holes."""
    ring = scratch.table(rings(triangles, most), "ring")
    if ring.isEmpty():
        return triangles, vertices
    last = triangles.agg(F.max("tid").alias("tid")).join(F.broadcast(vertices.agg(F.max("vid").alias("vid"))), F.lit(True)).first()
    numbers = [f.name for f in vertices.schema.fields if f.name != "vid" and f.dataType.typeName() in ("double", "float")]
    middle = ring.where("size > 3").join(vertices.select("vid", *numbers), "vid").groupBy("hole").agg(*(F.avg(c).alias(c) for c in numbers))
    middle = scratch.table(cloud.ordinal(middle, "hole").select((F.col("ord") + 1 + last["vid"]).alias("vid"), "hole", *numbers), "middle")
    fan = ring.where("size > 3").join(middle.select("hole", F.col("vid").alias("c")), "hole").select("hole", "place", F.col("vid").alias("a"), F.col("next").alias("b"), "c")
    three = ring.where("size = 3").groupBy("hole").agg(F.array_sort(F.collect_list(F.struct("place", "vid"))).alias("p"))
    three = three.select("hole", F.lit(0).cast("long").alias("place"), *(F.col("p")[k]["vid"].alias(c) for k, c in enumerate("abc")))
    new = cloud.ordinal(fan.unionByName(three), "hole", "place").select((F.col("ord") + 1 + last["tid"]).alias("tid"), "a", "b", "c")
    added = middle.select("vid", *(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in numbers else F.lit(None).cast(f.dataType).alias(f.name) for f in vertices.schema.fields if f.name != "vid"))
    return triangles.select("tid", "a", "b", "c").unionByName(new), vertices.unionByName(added.select(*vertices.columns))
