"""Depth maps, truncated signed distance volumes and camera visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def valid_depth(pixels: DataFrame, near: float = 0.1, far: float = 8.0) -> DataFrame:
    return pixels.where((F.col("depth") > near) & (F.col("depth") < far))


def mask_depth(pixels: DataFrame, extent: float, alpha: float = 0.5) -> DataFrame:
    """Zero depth where the pixel is thin or farther than the scene."""
    return pixels.withColumn("depth", F.when((F.col("alpha") < alpha) | (F.col("depth") > extent), 0.0).otherwise(F.col("depth")))


def unproject(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """World points of depth pixels ``view, u, v, depth``; cameras (``view, fx, fy, cx, cy, c2w``) are broadcast
    only if Spark's own size estimate allows."""
    rows = pixels.join(cameras, "view")
    cam = ((F.col("u") - F.col("cx")) / F.col("fx") * F.col("depth"), (F.col("v") - F.col("cy")) / F.col("fy") * F.col("depth"), F.col("depth"))
    m = F.col("c2w")
    world = [m[i][0] * cam[0] + m[i][1] * cam[1] + m[i][2] * cam[2] + m[i][3] for i in range(3)]
    return rows.select(*pixels.columns, *(w.alias(c) for w, c in zip(world, XYZ)))


def fuse_views(pixels: DataFrame, cameras: DataFrame, near: float = 0.1, far: float = 8.0) -> DataFrame:
    """World points of all views together: pixels whose ``mask`` (if there) holds and whose depth is in range."""
    ok = pixels.where("mask") if "mask" in pixels.columns else pixels
    return unproject(valid_depth(ok, near, far), cameras)


def tsdf(points: DataFrame, voxel: float, trunc: float, colours=("r", "g", "b")) -> DataFrame:
    """Weighted mean truncated distance per voxel of rows ``x, y, z`` (surface), ``ox, oy, oz`` (camera) and
    ``weight``: each ray marks the voxels within ``trunc`` of its surface point, and all rays of a
    voxel are averaged with a combine before the shuffle."""
    o = [F.col(f"o{c}") for c in XYZ]
    d = [F.col(c) - k for c, k in zip(XYZ, o)]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    steps = max(1, int(trunc / voxel + 1e-9))
    rays = points.withColumn("__len", length).where("__len > 0").withColumn("__s", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
    along = F.col("__s") * F.lit(float(voxel))
    at = {c: F.col(c) + along * (F.col(c) - F.col(f"o{c}")) / F.col("__len") for c in XYZ}
    cell = {f"i{c}": F.floor(at[c] / F.lit(float(voxel))).cast("long") for c in XYZ}
    # Signed distance of the voxel's centre along the ray: positive in front of the surface.
    rows = rays.withColumns(cell)
    centre = {c: (F.col(f"i{c}") + F.lit(0.5)) * F.lit(float(voxel)) for c in XYZ}
    depth = sum(((centre[c] - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) / F.col("__len") for c in "yz"), (centre["x"] - F.col("ox")) * (F.col("x") - F.col("ox")) / F.col("__len"))
    sdf = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("__len") - depth) / F.lit(float(trunc))))
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in points.columns else F.lit(1.0)
    rows = rows.withColumns({"__sdf": sdf, "__w": w})
    have = [c for c in colours if c in points.columns]
    return rows.groupBy("ix", "iy", "iz").agg(
        (F.sum(F.col("__sdf") * F.col("__w")) / F.sum("__w")).alias("tsdf"), F.sum("__w").alias("weight"),
        *((F.sum(F.col(c) * F.col("__w")) / F.sum("__w")).alias(c) for c in have),
    )


CAMERAS = 2_000  # that travel in one broadcast row
UNPRUNED = 16  # cameras that every point may be tested with
CELLS = 64  # of the longest extent, for pruning by frustum


def project_points(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """``view, pid, u, v, depth`` of the points in front of each camera and inside its image.

    Cameras are counted. A handful (``UNPRUNED``) are one array in one broadcast row, so a point meets them in its own
    task and nothing is shuffled. More meet the occupied cells of the cloud first, in groups of ``CAMERAS``: only
    points of cells that a frustum may touch meet that camera."""
    fields = ["view", "fx", "fy", "cx", "cy", "width", "height", "w2c"]
    n = cameras.count()
    if n <= UNPRUNED:
        all_ = cameras.select(F.struct(*fields).alias("cam")).agg(F.collect_list("cam").alias("cams"))
        return _in_image(points.join(F.broadcast(all_), F.lit(True)).select("pid", *XYZ, F.explode("cams").alias("c")))
    box = points.agg(*(f(c).alias(f"{k}{c}") for c in XYZ for f, k in ((F.min, "lo"), (F.max, "hi")))).first()
    size = max((box[f"hi{c}"] or 0.0) - (box[f"lo{c}"] or 0.0) for c in XYZ) / CELLS or 1.0
    cell = [F.floor(F.col(c) / F.lit(size)).cast("long").alias(f"__{c}") for c in XYZ]
    keys = [f"__{c}" for c in XYZ]
    held = points.select("pid", *XYZ, *cell)
    cells = held.select(*keys).distinct()
    groups = -(-n // CAMERAS)
    numbered = cameras.select(F.struct(*fields).alias("cam"), F.pmod(F.xxhash64("view"), F.lit(groups)).alias("g"))
    out = None
    for g in range(groups):
        cams = numbered.where(F.col("g") == g).agg(F.collect_list("cam").alias("cams"))
        met = cells.join(F.broadcast(cams), F.lit(True)).select(*keys, F.explode("cams").alias("c")).where(_may_see([F.col(k) for k in keys], size))
        part = _in_image(held.join(met, keys).select("pid", *XYZ, "c"))
        out = part if out is None else out.unionByName(part)
    return out


def _camera_space(p: list[Column]) -> list[Column]:
    m = F.col("c.w2c")
    return [m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + m[i][3] for i in range(3)]


def _may_see(cell: list[Column], size: float) -> Column:
    """Whether the ball around a cell reaches the inner side of the frustum's planes."""
    x, y, z = _camera_space([(k + 0.5) * F.lit(size) for k in cell])
    r = F.lit(size * 3**0.5 / 2 * (1 + 1e-9))
    ok = z > -r
    for p, f, c, w in ((x, "c.fx", "c.cx", "c.width"), (y, "c.fy", "c.cy", "c.height")):
        f, c, far = F.col(f), F.col(c), F.col(w) - F.col(c)
        ok &= (f * p + c * z >= -r * F.sqrt(f * f + c * c)) & (far * z - f * p >= -r * F.sqrt(f * f + far * far))
    return ok


def _in_image(rows: DataFrame) -> DataFrame:
    x, y, z = _camera_space([F.col(c) for c in XYZ])
    rows = rows.withColumns({"__x": x, "__y": y, "depth": z}).where("depth > 1e-9")
    u = F.col("c.fx") * F.col("__x") / F.col("depth") + F.col("c.cx")
    v = F.col("c.fy") * F.col("__y") / F.col("depth") + F.col("c.cy")
    rows = rows.withColumns({"u": u, "v": v})
    inside = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < F.col("c.width")) & (F.col("v") < F.col("c.height"))
    return rows.where(inside).select(F.col("c.view").alias("view"), "pid", "u", "v", "depth")


def visible(points: DataFrame, cameras: DataFrame, slack: float = 0.02, occluders: DataFrame | None = None) -> DataFrame:
    """Points that some camera sees: inside its image and at most ``slack`` behind the nearest occluder
    (by default the points themselves) of the pixel."""
    seen = project_points(points, cameras).withColumns({"px": F.floor("u").cast("long"), "py": F.floor("v").cast("long")})
    front = seen if occluders is None else project_points(occluders, cameras).withColumns({"px": F.floor("u").cast("long"), "py": F.floor("v").cast("long")})
    zbuf = front.groupBy("view", "px", "py").agg(F.min("depth").alias("front"))
    ok = seen.join(zbuf, ["view", "px", "py"]).where(F.col("depth") <= F.col("front") + slack).select("pid").distinct()
    return points.join(ok, "pid", "left_semi")


def coverage(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """How many cameras have each point in view; 0 for none."""
    n = project_points(points, cameras).groupBy("pid").agg(F.count(F.lit(1)).alias("views"))
    return points.select("pid").join(n, "pid", "left").select("pid", F.coalesce("views", F.lit(0)).alias("views"))


def depth_metres(raw: Column) -> Column:
    """Depth stored as unsigned millimetres."""
    return raw.cast("double") / 1000.0
