"""Frames and depth as image files: a source of frame files that reads only the frames asked for, depth in metres,
and keyframes with thumbnails."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lumenfold.functions import names

from . import files, png

FRAMES = "video long, frame_idx long, pixels binary, height int, width int, channels int"
SPLIT_BYTES = 64_000_000  # of the files of a partition
OPEN_BYTES = 64_000  # that opening a file counts for at least, so that small files are dealt out too
BATCH_BYTES, BATCH_ROWS = 8_000_000, 256  # of frames handed over at once
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

# A frame file; the number that ends its folder's name, if there is one, is its clip's.
FRAME_FILE = re.compile(r"(?:(?:^|/)[^/]*?(\d+)/)?frame_(\d+)\.png$")


class _Files(InputPartition):
    def __init__(self, found: list[tuple[int, int, str]]):
        super().__init__(None)
        self.found = found


class FrameFiles(DataSource):
    """``spark.read.format("framefiles").option("path", folder)``: a row for each frame image under the folder, one
    folder a clip. ``stride`` keeps every so-manieth frame. Comparisons of ``frame_idx`` and ``video`` with values are
    pushed to the list of files, so that what they leave out is never opened (``PUSHDOWN`` is the session's
    switch for sources in Python; without it Spark filters the rows). A damaged image is an error."""

    @classmethod
    def name(cls) -> str:
        return "framefiles"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options["path"], int(self.options.get("stride", 1)), int(self.options.get("splitBytes", SPLIT_BYTES)))


#: Whether a file's number passes a filter.
_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


class _FrameReader(DataSourceReader):
    def __init__(self, path: str, stride: int, split: int):
        self.path, self.stride, self.split = path.rstrip("/"), stride, split
        self.pushed: list[tuple[type, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("frame_idx",), ("video",)):
                self.pushed.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = files.store_of(self.path)
        kept = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            m = FRAME_FILE.search(info.path[len(root) :]) if info.is_file else None
            if not m:
                continue
            at = {"video": int(m[1] or 0), "frame_idx": int(m[2])}
            if at["frame_idx"] % self.stride == 0 and all(_TESTS[k](at[c], v) for k, c, v in self.pushed):
                kept.append((at["video"], at["frame_idx"], info.path, info.size))
        groups, size = [[]], 0
        for *row, n in sorted(kept):
            n = max(n, OPEN_BYTES)
            if groups[-1] and size + n > self.split:
                groups.append([])
                size = 0
            groups[-1].append(tuple(row))
            size += n
        return [_Files(g) for g in groups]

    def read(self, part):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        names = [c.split(" ")[0] for c in FRAMES.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        store, _ = files.store_of(self.path)
        rows, size = [], 0
        for video, idx, path in part.found:
            with store.open_input_file(path) as f:
                image = png.decode(f.read())
            if image.dtype != np.uint8:
                raise png.BadImage(f"{path}: frames have 8 bits")
            rows.append((video, idx, image[:, :, ::-1].tobytes() if image.shape[2] == 3 else image.tobytes(), *image.shape))
            size += image.size
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


def frame_files(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """Frames of the image files under a folder, three samples blue first as elsewhere, with filters pushed down."""
    spark.dataSource.register(FrameFiles)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("framefiles").option("path", path).option("stride", stride).load()


def encode_frames(frames: DataFrame, name, thumb_width=None) -> DataFrame:
    """``name, content`` of ``files.write_many`` for frames of 8 bits; ``name`` is a column. With ``thumb_width`` (a number,
    or a column of numbers and nulls) the image is reduced to that width, if it is wider, by the mean of the pixels under each of the new ones."""
    import pyarrow as pa

    from lumenfold.operators.image import area_resize

    def run(batches) -> Iterator:
        for batch in batches:
            out = []
            for pixels, h, w, c, thumb in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                image = np.frombuffer(pixels, np.uint8).reshape(h, w, c)
                image = image[:, :, ::-1] if c == 3 else image
                if thumb and w > thumb:
                    small = max(1, round(h * thumb / w))
                    image = np.stack([np.clip(np.rint(area_resize(image[:, :, k].astype(float), thumb, small)), 0, 255) for k in range(c)], axis=2).astype(np.uint8)
                out.append(png.encode(image))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["name", "content"])

    thumb = (thumb_width if isinstance(thumb_width, Column) else F.lit(thumb_width)).cast("int").alias("thumb")
    return frames.select(name.alias("name"), "pixels", "height", "width", "channels", thumb).mapInArrow(run, "name string, content binary")


def write_keyframes(frames: DataFrame, selected: DataFrame, folder: str, thumb_width: int = 256, by_clip: bool = True) -> int:
    """Images ``frame_k.png`` and ``thumb_k.png`` of the selected frames of each clip, in order, in a folder for each clip
    unless there is only one. ``selected`` has ``video, frame_idx``. Returns the number of files."""
    from pyspark.sql import Window as W

    rank = (F.row_number().over(W.partitionBy("video").orderBy("frame_idx")) - 1).alias("k")
    ranked = selected.select("video", "frame_idx", rank)
    rows = frames.join(ranked, ["video", "frame_idx"])
    base = F.concat(F.lit("clip"), F.col("video").cast("string"), F.lit("/")) if by_clip else F.lit("")
    # Both images of a frame come from one reading of it.
    rows = rows.withColumn("__thumb", F.explode(F.array(F.lit(None).cast("int"), F.lit(thumb_width))))
    shown = F.when(F.col("__thumb").isNull(), names.frame_name(F.col("k"), ext=".png")).otherwise(names.frame_name(F.col("k"), "thumb_", ".png"))
    return files.write_many(encode_frames(rows, F.concat(base, shown), F.col("__thumb")), folder)


def depth_documents(depth: DataFrame, name) -> DataFrame:
    """``name, content`` of 16-bit images of ``depth`` in metres (an array by rows of ``width``), stored as whole
    millimetres from 0 to 65,535; what is missing or not finite is 0."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        for batch in batches:
            out = []
            for values, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                mm = np.nan_to_num(np.array(values, float), nan=0.0, posinf=0.0, neginf=0.0) * 1000
                out.append(png.encode(np.clip(np.rint(mm), 0, 65_535).astype(np.uint16).reshape(-1, w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["name", "content"])

    return depth.select(name.alias("name"), "depth", F.col("width").cast("int").alias("width")).mapInArrow(run, "name string, content binary")


def depth_files(spark: SparkSession, path: str, height: int | None = None, width: int | None = None) -> DataFrame:
    """``path, height, width, depth`` (metres by rows) of the 16-bit images that ``path`` stands for, at the given size,
    by the nearest pixel, where theirs is another. Files that are no such image are left out."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        for batch in batches:
            rows = []
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    image = png.decode(blob)
                except png.BadImage:
                    continue
                if image.dtype == np.uint16 and image.shape[2] == 1:
                    size = (height or image.shape[0], width or image.shape[1])
                    image = image[:, :, 0] if image.shape[:2] == size else png.nearest(image[:, :, 0], *size)
                    rows.append((at, *size, (image / 1000.0).ravel()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "height", "width", "depth"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")
    return found.mapInArrow(run, "path string, height int, width int, depth array<double>")
