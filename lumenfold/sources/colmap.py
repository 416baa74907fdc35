"""Sparse-model binaries: cameras, images and points."""

from __future__ import annotations

import itertools
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import scratch

from . import files
from .files import store_of

# Fixed value: the pinhole model's number.
PINHOLE = 1


def cameras_bytes(cameras: list[dict]) -> bytes:
    out = [struct.pack("<Q", len(cameras))]
    out += [struct.pack("<IiQQ4d", c["camera_id"], PINHOLE, c["width"], c["height"], c["fx"], c["fy"], c["cx"], c["cy"]) for c in cameras]
    return b"".join(out)


def images_bytes(images: list[dict]) -> bytes:
    """Images with rotation (w, x, y, z), translation, camera and name, and no 2-D points."""
    out = [struct.pack("<Q", len(images))]
    for i in images:
        out.append(struct.pack("<I7dI", i["image_id"], *i["q"], *i["t"], i["camera_id"]) + i["name"].encode() + b"\0" + struct.pack("<Q", 0))
    return b"".join(out)


_HEAD = np.dtype([("id", "<u8"), ("xyz", "<f8", (3,)), ("rgb", "u1", (3,)), ("err", "<f8"), ("n", "<u8")])
VIEWS = "array<struct<image_id:int,point:int>>"
POINTS = f"pid long, x double, y double, z double, r int, g int, b int, error double, track long, views {VIEWS}"
RANGE = 1 << 25  # bytes of points that one task reads


def points_rows(batch) -> bytes:
    """Point records of a batch of ``pid, x, y, z, r, g, b, views``."""
    column = {name: batch.column(name) for name in batch.schema.names}
    head = np.zeros(batch.num_rows, dtype=_HEAD)
    head["id"] = column["pid"].to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1)
    for k, (c, colour) in enumerate(zip("xyz", "rgb")):
        head["xyz"][:, k] = column[c].to_numpy(zero_copy_only=False)
        head["rgb"][:, k] = column[colour].to_numpy(zero_copy_only=False)
    length = column["views"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    head["n"] = length
    seen = column["views"].flatten()
    track = np.stack([seen.field(k).to_numpy(zero_copy_only=False).astype("<i4") for k in range(2)], axis=1)
    size = _HEAD.itemsize + 8 * length
    out, heads = np.zeros(size.sum(), np.uint8), np.zeros(size.sum(), bool)
    heads[(np.cumsum(size) - size)[:, None] + np.arange(_HEAD.itemsize)] = True
    out[heads], out[~heads] = head.view(np.uint8), np.ascontiguousarray(track).view(np.uint8).ravel()
    return out.tobytes()


def point_records(content: bytes, step: int = 100_000):
    """(heads, tracks as (record, view, 2), first byte after them) of the whole records at the start of ``content``. Runs of
    records with equally long tracks, as most are, are read as arrays."""
    at = 0
    while at + _HEAD.itemsize <= len(content):
        k = int(np.frombuffer(content, _HEAD, 1, at)["n"][0])
        kind = np.dtype([("head", _HEAD), ("track", "<i4", (k, 2))])
        have = min(step, (len(content) - at) // kind.itemsize)
        if have == 0:
            return
        a = np.frombuffer(content, kind, have, at)
        same = a["head"]["n"] == k
        have = have if same.all() else int(same.argmin())
        at += have * kind.itemsize
        yield a["head"][:have], a["track"][:have], at


def point_ranges(path: str, size: int):
    """(first byte, first byte after) of stretches of whole records of about ``size`` bytes. Only a record's own head
    tells where the next one starts, so this reads through the file once, a stretch at a time."""
    store, name = store_of(path)
    with store.open_input_stream(name) as f:
        left, at, rest = struct.unpack("<Q", f.read(8))[0], 8, b""
        while left:
            more = f.read(max(size - len(rest), _HEAD.itemsize))
            rest += more
            end = n = 0
            for heads, _, end in point_records(rest, 1_000_000):
                n += len(heads)
            if end:
                yield at, at + end
            elif not more:
                raise ValueError(f"{path}: {left} points are missing")
            left, at, rest = left - n, at + end, rest[end:]


def write_model(folder: str, cameras: DataFrame, images: DataFrame, points: DataFrame) -> None:
    """Three files in ``folder`` of any store. A point's track is its ``views``, by default the first three images. Executors pack the points; the packed pieces pass through the
    driver in id order, one at a time, into the one file that the format asks for."""
    import pyarrow as pa

    spark = points.sparkSession
    files.write(spark, f"{folder}/cameras.bin", cameras_bytes([r.asDict() for r in cameras.orderBy("camera_id").collect()]))
    files.write(spark, f"{folder}/images.bin", images_bytes([r.asDict() for r in images.orderBy("image_id").collect()]))

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([points_rows(batch)], pa.binary())], ["rows"])

    views = F.col("views") if "views" in points.columns else F.array(*(F.struct(F.lit(k).alias("image_id"), F.lit(0).alias("point")) for k in (1, 2, 3)))
    rows = scratch.table(points.select("pid", "x", "y", "z", "r", "g", "b", views.cast(VIEWS).alias("views")), "points")
    packed = rows.orderBy("pid").mapInArrow(pack, "rows binary").toLocalIterator(prefetchPartitions=True)
    files.write(spark, f"{folder}/points3D.bin", itertools.chain([struct.pack("<Q", rows.count())], (bytes(r[0]) for r in packed)))


def read_model(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``cameras``, ``images`` and ``points`` of a model folder. One task finds where stretches of whole points begin, then
    each stretch of about ``range_bytes`` is read by a task of its own; ``track`` is the number of a point's ``views``."""
    blob, at = files.read(spark, f"{folder}/cameras.bin"), 8
    cams = []
    for _ in range(struct.unpack_from("<Q", blob)[0]):
        cid, model, w, h = struct.unpack_from("<IiQQ", blob, at)
        fx, fy, cx, cy = struct.unpack_from("<4d", blob, at + 24)
        cams.append((cid, model, w, h, fx, fy, cx, cy))
        at += 56
    blob, at = files.read(spark, f"{folder}/images.bin"), 8
    imgs = []
    for _ in range(struct.unpack_from("<Q", blob)[0]):
        iid, *qt, cid = struct.unpack_from("<I7dI", blob, at)
        at += 64
        end = blob.index(b"\0", at)
        name = blob[at:end].decode()
        n = struct.unpack_from("<Q", blob, end + 1)[0]
        at = end + 9 + 24 * n
        imgs.append((iid, list(qt[:4]), list(qt[4:]), cid, name))

    at = f"{folder}/points3D.bin"

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                found = list(point_ranges(at, range_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], ["first", "past"])

    def points(batches):
        import pyarrow as pa

        store, name = store_of(at)
        kinds = [pa.int64(), *[pa.float64()] * 3, *[pa.int32()] * 3, pa.float64(), pa.int64()]
        for batch in batches:
            for first, past in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(name) as f:
                    content = f.read_at(past - first, first)
                for a, tracks, _ in point_records(content):
                    cols = [a["id"].astype(np.int64) - 1, *a["xyz"].T, *a["rgb"].astype(np.int32).T, a["err"], a["n"].astype(np.int64)]
                    seen = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(tracks[:, :, k]).ravel(), pa.int32()) for k in range(2)], ["image_id", "point"])
                    views = pa.ListArray.from_arrays(pa.array((np.arange(len(a) + 1) * tracks.shape[1]).astype(np.int32)), seen)
                    arrays = [*(pa.array(np.ascontiguousarray(c), t) for c, t in zip(cols, kinds)), views]
                    yield pa.RecordBatch.from_arrays(arrays, ["pid", "x", "y", "z", "r", "g", "b", "error", "track", "views"])

    ranges = scratch.table(spark.range(0, 1, 1, 1).mapInArrow(find, "first long, past long"), "ranges")
    return (
        spark.createDataFrame(cams, "camera_id long, model int, width long, height long, fx double, fy double, cx double, cy double"),
        spark.createDataFrame(imgs, "image_id long, q array<double>, t array<double>, camera_id long, name string"),
        ranges.repartitionByRange(max(1, ranges.count()), "first").mapInArrow(points, POINTS),
    )
