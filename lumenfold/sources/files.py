"""Single files through Spark's own file systems, so that reports, models and meshes go to any store; many small ones
are written, found and read by the tasks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import scratch

CHUNK = 1 << 24
BATCH_FILES, BATCH_BYTES = 1_000, 1 << 23  # of small files that a task gives on at once

LISTERS = 4  # tasks for each core that list folders
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing(spark: SparkSession):
    """While a reader is made, many folders are listed by some tasks for each core; by default each folder has a task of
    its own, up to 10,000. The session's setting is restored."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(LISTERS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)
    return fs, at


def store_of(path: str):
    """The store that executors' Python reaches, and the path in it."""
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _split(pattern: str) -> tuple[str, list[str]]:
    """The folder over the first part with wildcards, and the parts from there."""
    head, *rest = re.split(r"/(?=[^/]*[*?\[])", pattern.rstrip("/"), maxsplit=1)
    return head, rest[0].split("/") if rest else []


def tasks_reach(pattern: str) -> bool:
    """Whether ``find`` can be used: the executors' Python knows the store, and there are no braces."""
    try:
        head, _ = _split(pattern)
        return not re.search(r"[{\\]", pattern) and head.endswith(store_of(head)[1])
    except Exception:
        return False


def find(spark: SparkSession, pattern: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """``path`` of the files that ``pattern`` stands for, or with ``suffixes`` of the files with one of these in the
    folders it stands for; what a wildcard stands for doesn't begin with ``_`` or ``.``. The tasks list the folders and
    write what they find to a table, so the driver holds no file's name; with Spark's readers it holds the status of each."""
    import pyarrow as pa

    head, parts = _split(pattern)
    store, at = store_of(head)
    lead = "file:" if store.type_name == "local" else head.removesuffix(at)

    def entries(store, folder: str):
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [(i.path.rstrip("/").rsplit("/", 1)[-1], i.type == fs.FileType.Directory) for i in found]

    def visible(name: str) -> bool:
        return not name.startswith(("_", "."))

    def step(store, folder: str, part: str, last: bool):
        """Paths one part further; of the last part files, or folders if their files are wanted."""
        from fnmatch import fnmatchcase

        if not re.search(r"[*?\[]", part):
            return [f"{folder}/{part}"]
        return [f"{folder}/{n}" for n, is_dir in entries(store, folder) if visible(n) and fnmatchcase(n, part) and is_dir == (not last or suffixes is not None)]

    def batches_of(paths: Iterable[str]) -> Iterator:
        from itertools import batched

        for some in batched(paths, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.string())], ["path"])

    def first(batches) -> Iterator:
        store, at = store_of(head)
        for batch in batches:
            for _ in range(batch.num_rows):
                yield from batches_of(step(store, at.rstrip("/"), parts[0], len(parts) == 1) if parts else [at])

    def others(batches) -> Iterator:
        from pyarrow import fs

        store, _ = store_of(head)

        def under(folder: str, k: int) -> Iterator[str]:
            if k < len(parts):
                for path in step(store, folder, parts[k], k + 1 == len(parts)):
                    yield from under(path, k + 1)
            elif suffixes is not None:
                yield from (f"{folder}/{n}" for n, is_dir in entries(store, folder) if visible(n) and not is_dir and n.rsplit(".", 1)[-1] in suffixes and "." in n)
            else:
                yield folder

        def files_under(folders: Iterable[str]) -> Iterator[str]:
            from itertools import batched

            for some in batched((p for folder in folders for p in under(folder, 1)), 1_000):
                kinds = [fs.FileType.File] * len(some) if suffixes is not None else [i.type for i in store.get_file_info(list(some))]
                yield from (lead + p for p, kind in zip(some, kinds) if kind == fs.FileType.File)

        for batch in batches:
            yield from batches_of(files_under(batch.column(0).to_pylist()))

    top = spark.range(0, 1, 1, 1).mapInArrow(first, "path string")
    dealt = top.repartition(LISTERS * spark.sparkContext.defaultParallelism, "path").mapInArrow(others, "path string")
    found = scratch.table(dealt, "found")
    if suffixes is None and found.isEmpty():
        raise FileNotFoundError(pattern)
    return found


def contents(found: DataFrame) -> DataFrame:
    """``path, content`` of the small files that one ``find`` found, read by the tasks in bounded batches."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        paths, blobs, size, store, lead = [], [], 0, None, ""
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if store is None:
                    store, at = store_of(path)
                    lead = path.removesuffix(at)
                with store.open_input_file(path.removeprefix(lead)) as f:
                    blobs.append(f.read())
                paths.append(path)
                size += len(blobs[-1])
                if len(paths) == BATCH_FILES or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(blobs, pa.binary())], ["path", "content"])
                    paths, blobs, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(blobs, pa.binary())], ["path", "content"])

    return found.select("path").mapInArrow(run, "path string, content binary")


def write(spark: SparkSession, path: str, data: bytes | str | Iterable[bytes]) -> int:
    """Create or replace ``path``; ``data`` may come in pieces. Returns the size."""
    fs, at = _at(spark, path)
    if isinstance(data, (bytes, bytearray, str)):
        data = [data.encode() if isinstance(data, str) else data]
    size, out = 0, fs.create(at, True)
    try:
        for piece in data:
            for lo in range(0, len(piece), CHUNK):
                out.write(bytearray(piece[lo : lo + CHUNK]))
            size += len(piece)
    finally:
        out.close()
    return size


def write_many(documents: DataFrame, folder: str) -> int:
    """One file under ``folder`` for each row of ``name`` (a relative path) and ``content`` (text or bytes), written by
    the tasks that hold the rows. Each appears under its name at once and whole, so a task that runs again leaves the
    same. Returns their number. ``folder`` is a path or URI of a store that all executors reach."""
    root = folder.rstrip("/")

    def run(batches) -> Iterator:
        import uuid

        import pyarrow as pa

        store, base = store_of(root)
        made, n = set(), 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent, _, last = f"{base}/{name}".rpartition("/")
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                hidden = f"{parent}/_{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(content)
                store.move(hidden, f"{parent}/{last}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = documents.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read(spark: SparkSession, path: str) -> bytes:
    """A bounded file as a whole."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)
