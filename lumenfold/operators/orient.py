"""Consistent signs of normals: a minimum spanning forest of the neighbour graph carries them from point to point.

Neighbours whose normals are nearly parallel, whatever their signs, are close: an edge weighs one less the absolute
cosine, and says whether its ends must differ in sign. Boruvka rounds build the forest: every tree takes its lightest
edge to another tree, and trees that are linked become one. Each point knows its tree's root and its sign relative
to it; when a tree hangs itself onto another one, pointer jumping follows the new links to their roots and multiplies
the signs on the way. Rounds and jumps grow with the logarithm of the points; state is a written table a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import scratch

from . import nn

XYZ = ("x", "y", "z")


def neighbour_edges(points: DataFrame, k: int = 8, strategy: str = "auto") -> DataFrame:
    """``s, t`` (s < t), ``weight`` and ``flip`` (0 or 1) between each point and its ``k`` nearest others. Weights are
    whole 10^-9 parts, so that sums have no order; equal ones are told apart by the ends."""
    near = nn.k_nearest(points, points, k, strategy, skip_self=True).select("qid", "pid")
    pairs = near.select(F.least("qid", "pid").alias("s"), F.greatest("qid", "pid").alias("t")).distinct()
    for e in "st":
        pairs = pairs.join(points.select(F.col("pid").alias(e), *(F.col(f"n{c}").alias(f"{e}_{c}") for c in XYZ)), e)
    cosine = F.col("s_x") * F.col("t_x") + F.col("s_y") * F.col("t_y") + F.col("s_z") * F.col("t_z")
    return pairs.select("s", "t", F.round((1 - F.least(F.lit(1.0), F.abs(cosine))) * 1e9).cast("long").alias("weight"), (cosine < 0).cast("int").alias("flip"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the forest's edges ``s, t, weight, flip``; ``node, root, sign``: the parity of flips between a node and its
    tree's root). Nodes without edges are left out."""
    live = scratch.table(edges.select("s", "t", "weight", "flip"), "edges")
    nodes = live.select(F.explode(F.array("s", "t")).alias("node")).distinct()
    nodes = scratch.table(nodes.select("node", F.col("node").alias("root"), F.lit(0).alias("sign")), "nodes")
    forest = None
    while True:
        # Both ends' trees; edges within one are done with.
        for e in "st":
            live = live.join(nodes.select(F.col("node").alias(e), F.col("root").alias(f"r{e}"), F.col("sign").alias(f"g{e}")), e)
        live = scratch.table(live.where("rs <> rt"), "crossing")
        if live.isEmpty():
            return forest if forest is not None else live.select("s", "t", "weight", "flip"), nodes
        parity = F.col("gs").bitwiseXOR(F.col("gt")).bitwiseXOR(F.col("flip"))
        key = F.struct("weight", "s", "t")
        out = live.select(F.explode(F.array(*(F.struct(F.col(f"r{a}").alias("tree"), F.col(f"r{b}").alias("to"), parity.alias("sign"), key.alias("key"), "flip") for a, b in ("st", "ts")))).alias("e")).select("e.*")
        best = scratch.table(out.groupBy("tree").agg(F.min_by(F.struct("to", "sign", "key", "flip"), "key").alias("b")).select("tree", "b.*"), "best")
        taken = best.select("key.s", "key.t", "key.weight", "flip").distinct()
        forest = scratch.table(taken if forest is None else forest.unionByName(taken), "forest")
        # Two trees that chose each other: the lesser one stays a root.
        back = best.select(F.col("tree").alias("to"), F.col("to").alias("__back"))
        links = best.join(back, "to", "left").select("tree", "to", "sign", (F.coalesce(F.col("__back") == F.col("tree"), F.lit(False)) & (F.col("tree") < F.col("to"))).alias("top"))
        links = scratch.table(links.select("tree", F.when(F.col("top"), F.col("tree")).otherwise(F.col("to")).alias("to"), F.when(F.col("top"), 0).otherwise(F.col("sign")).alias("sign")), "links")
        while True:
            ahead = links.select(F.col("tree").alias("to"), F.col("to").alias("__to"), F.col("sign").alias("__sign"))
            jumped = links.join(ahead, "to", "left").select(
                "tree", F.coalesce("__to", "to").alias("next"), F.col("sign").bitwiseXOR(F.coalesce("__sign", F.lit(0))).alias("sign"), (F.coalesce("__to", "to") != F.col("to")).alias("moved")
            )
            jumped = scratch.table(jumped, "jumped")
            links = jumped.select("tree", F.col("next").alias("to"), "sign")
            if jumped.where("moved").isEmpty():
                break
        moved = nodes.join(links.select(F.col("tree").alias("root"), F.col("to").alias("__to"), F.col("sign").alias("__sign")), "root", "left")
        nodes = scratch.table(moved.select("node", F.coalesce("__to", "root").alias("root"), F.col("sign").bitwiseXOR(F.coalesce("__sign", F.lit(0))).alias("sign")), "nodes")
        live = live.select("s", "t", "weight", "flip")


def orient_normals(points: DataFrame, k: int = 8, strategy: str = "auto", axis: str = "z") -> DataFrame:
    """Points whose normals agree in sign along the forest; in each tree the point that is highest along ``axis``, the
    least id of equals, looks up. A point without neighbours looks up itself."""
    points = scratch.table(points, "points")
    _, nodes = spanning_forest(neighbour_edges(points, k, strategy))
    rows = points.join(nodes.withColumnRenamed("node", "pid"), "pid", "left").withColumns({"root": F.coalesce("root", "pid"), "sign": F.coalesce("sign", F.lit(0))})
    rows = scratch.table(rows, "signed")
    up = F.when(F.col(f"n{axis}") * (1 - 2 * F.col("sign")) < 0, 1).otherwise(0)
    top = rows.groupBy("root").agg(F.max_by(up, F.struct(F.col(axis), -F.col("pid"))).alias("__turn"))
    turn = 1 - 2 * F.col("sign").bitwiseXOR(F.col("__turn"))
    out = rows.join(top, "root")
    return out.select(*((F.col(c) * turn).alias(c) if c in ("nx", "ny", "nz") else F.col(c) for c in points.columns))
