"""Images of meshes and splats: coverage and compositing as joins, groupings and windows.

Cameras are rows of ``view, fx, fy, cx, cy, width, height, w2c``; a pixel's middle is half a pixel from its corner.
A triangle or splat meets the cameras in its own task and goes on only as the pixels of its box in an image. Depths
are combined in every task before the shuffle, so a pixel costs a row a task however much lies behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold import scratch
from lumenfold.functions import linalg

from . import mesh
from .volume import CAMERAS

XYZ, CORNERS = mesh.XYZ, mesh.CORNERS
FIELDS = ("view", "fx", "fy", "cx", "cy", "width", "height", "w2c")
NEAR = 1e-6  # least depth of what is drawn
# Fixed values of splat compositing: blur of the image plane in squared pixels, deviations drawn, greatest and least
# opacity, and the light from which on nothing behind counts.
BLUR, REACH, MOST, LEAST, DARK = 0.3, 3.0, 0.99, 1.0 / 255.0, 1e-4


def _met(rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """Rows with each camera as ``c``, from one broadcast row."""
    n = cameras.count()
    if n > CAMERAS:
        raise ValueError(f"{n} cameras; draw at most {CAMERAS} at a time")
    every = cameras.select(F.struct(*FIELDS).alias("cam")).agg(F.collect_list("cam").alias("__cams"))
    return rows.join(F.broadcast(every), F.lit(True)).withColumn("c", F.explode("__cams")).drop("__cams")


def _camera(p: Sequence[Column]) -> list[Column]:
    m = F.col("c.w2c")
    return [m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + m[i][3] for i in range(3)]


def _pixels(rows: DataFrame, lo_u: Column, hi_u: Column, lo_v: Column, hi_v: Column) -> DataFrame:
    """A row for each pixel of the image whose middle is in the box."""
    first = lambda x: F.greatest(F.lit(0).cast("long"), F.ceil(x - 0.5))
    last = lambda x, size: F.least(F.col(size).cast("long") - 1, F.floor(x - 0.5))
    rows = rows.withColumns({"__u0": first(lo_u), "__u1": last(hi_u, "c.width"), "__v0": first(lo_v), "__v1": last(hi_v, "c.height")})
    rows = rows.where("__u0 <= __u1 and __v0 <= __v1").withColumn("py", F.explode(F.sequence("__v0", "__v1")))
    return rows.withColumn("px", F.explode(F.sequence("__u0", "__u1"))).drop("__u0", "__u1", "__v0", "__v1")


def draw_mesh(triangles: DataFrame, vertices: DataFrame, cameras: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """``view, px, py, depth, tid`` of the nearest triangle at each pixel that any covers, the least id of equals, with
    the vertices' ``attributes`` blended in perspective. Triangles that reach behind a camera are not drawn in it."""
    corners = mesh.with_corners(triangles.select("tid", *CORNERS), vertices.select("vid", *XYZ, *attributes), (*XYZ, *attributes))
    rows = _met(corners, cameras)
    for k in CORNERS:
        x, y, z = _camera([F.col(f"{k}_{c}") for c in XYZ])
        rows = rows.withColumns({f"{k}X": x, f"{k}Y": y, f"{k}Z": z})
    rows = rows.where(" and ".join(f"{k}Z > {NEAR}" for k in CORNERS))
    rows = rows.withColumns({f"{k}u": F.col("c.fx") * F.col(f"{k}X") / F.col(f"{k}Z") + F.col("c.cx") for k in CORNERS} | {f"{k}v": F.col("c.fy") * F.col(f"{k}Y") / F.col(f"{k}Z") + F.col("c.cy") for k in CORNERS})
    # Written: a row for each triangle and camera, from which all that follows is computed once.
    rows = scratch.table(rows.select("tid", "c", *(f"{k}{n}" for k in CORNERS for n in "uvZ"), *(f"{k}_{n}" for k in CORNERS for n in attributes)), "projected")
    at = {k: (F.col(f"{k}u"), F.col(f"{k}v")) for k in CORNERS}
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    rows = rows.withColumn("__area", side(at["a"], at["b"], at["c"])).where("__area <> 0")
    u, v = ([F.col(f"{k}{c}") for k in CORNERS] for c in "uv")
    rows = _pixels(rows, F.least(*u), F.greatest(*u), F.least(*v), F.greatest(*v))
    p = (F.col("px") + 0.5, F.col("py") + 0.5)
    weight = {"a": side(at["b"], at["c"], p), "b": side(at["c"], at["a"], p), "c": side(at["a"], at["b"], p)}
    rows = rows.withColumns({f"w{k}": w / F.col("__area") for k, w in weight.items()}).where("wa >= 0 and wb >= 0 and wc >= 0")
    near = sum((F.col(f"w{k}") / F.col(f"{k}Z") for k in "bc"), F.col("wa") / F.col("aZ"))
    blend = [(sum((F.col(f"w{k}") * F.col(f"{k}_{n}") / F.col(f"{k}Z") for k in "bc"), F.col("wa") * F.col(f"a_{n}") / F.col("aZ")) / near).alias(n) for n in attributes]
    front = F.min(F.struct((1 / near).alias("depth"), "tid", *blend)).alias("front")
    return rows.groupBy(F.col("c.view").alias("view"), "px", "py").agg(front).select("view", "px", "py", "front.*")


def draw_splats(splats: DataFrame, cameras: DataFrame) -> DataFrame:
    """``view, px, py, r, g, b, alpha, depth`` of the pixels that any splat reaches: colours composited from front to back,
    the light that was stopped and the mean depth where it was. ``splats`` has ``pid, x, y, z``, scales ``s0, s1, s2``,
    a unit quaternion ``qw, qx, qy, qz``, ``opacity`` and ``r, g, b``. A splat is drawn to three deviations of its shape
    in the image; at a pixel it counts from an opacity of 1 in 255 on, and nothing counts behind what leaves less
    than 1 in 10,000 of the light. Splats of a pixel are sorted, spilling if need be, not gathered."""
    rows = _met(splats, cameras)
    x, y, z = _camera([F.col(c) for c in XYZ])
    rows = rows.withColumns({"__x": x, "__y": y, "__z": z}).where(F.col("__z") > NEAR)
    w, i, j, k = (F.col(f"q{c}") for c in "wxyz")
    turn = [
        [1 - 2 * (j * j + k * k), 2 * (i * j - w * k), 2 * (i * k + w * j)],
        [2 * (i * j + w * k), 1 - 2 * (i * i + k * k), 2 * (j * k - w * i)],
        [2 * (i * k - w * j), 2 * (j * k + w * i), 1 - 2 * (i * i + j * j)],
    ]
    axes = [[turn[r][s] * F.col(f"s{s}") for s in range(3)] for r in range(3)]
    seen = linalg.matmul([[F.col("c.w2c")[r][s] for s in range(3)] for r in range(3)], axes)
    # Written in steps: a row for each splat and camera, each step computed once.
    rows = scratch.table(rows.withColumns({f"__m{r}{s}": seen[r][s] for r in range(3) for s in range(3)}), "turned")
    depth = F.col("__z")
    flat = {}
    for s in range(3):
        flat[f"__t{s}"] = F.col("c.fx") / depth * (F.col(f"__m0{s}") - F.col("__x") / depth * F.col(f"__m2{s}"))
        flat[f"__e{s}"] = F.col("c.fy") / depth * (F.col(f"__m1{s}") - F.col("__y") / depth * F.col(f"__m2{s}"))
    rows = scratch.table(rows.withColumns(flat).select("c", "pid", "opacity", *"rgb", "__x", "__y", "__z", *flat), "flat")
    total = lambda f: f(0) + f(1) + f(2)
    t, e = (lambda s: F.col(f"__t{s}")), (lambda s: F.col(f"__e{s}"))
    rows = rows.withColumns({"__a": total(lambda s: t(s) * t(s)) + BLUR, "__b": total(lambda s: t(s) * e(s)), "__c": total(lambda s: e(s) * e(s)) + BLUR})
    rows = rows.withColumn("__det", F.col("__a") * F.col("__c") - F.col("__b") * F.col("__b")).where("__det > 0")
    middle = (F.col("__a") + F.col("__c")) / 2
    widest = middle + F.sqrt(F.greatest(F.lit(0.0), middle * middle - F.col("__det")))
    rows = rows.withColumns({"__r": REACH * F.sqrt(widest), "__u": F.col("c.fx") * F.col("__x") / depth + F.col("c.cx"), "__v": F.col("c.fy") * F.col("__y") / depth + F.col("c.cy")})
    rows = scratch.table(rows, "shapes")
    u, v, r = F.col("__u"), F.col("__v"), F.col("__r")
    rows = _pixels(rows, u - r, u + r, v - r, v + r)
    dx, dy = F.col("px") + 0.5 - u, F.col("py") + 0.5 - v
    power = -0.5 * (F.col("__c") * dx * dx - 2 * F.col("__b") * dx * dy + F.col("__a") * dy * dy) / F.col("__det")
    alpha = F.least(F.lit(MOST), F.col("opacity") * F.exp(power))
    rows = rows.select(F.col("c.view").alias("view"), "px", "py", "pid", depth.alias("depth"), *"rgb", alpha.alias("alpha")).where(F.col("alpha") >= LEAST)
    before = W.partitionBy("view", "px", "py").orderBy("depth", "pid").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("light", F.exp(F.coalesce(F.sum(F.log(1 - F.col("alpha"))).over(before), F.lit(0.0)))).where(F.col("light") >= DARK)
    share = F.col("alpha") * F.col("light")
    out = rows.groupBy("view", "px", "py").agg(*(F.sum(F.col(c) * share).alias(c) for c in "rgb"), F.sum(share).alias("alpha"), (F.sum(F.col("depth") * share) / F.sum(share)).alias("depth"))
    return out.select("view", "px", "py", *"rgb", "alpha", "depth")
