"""Shared plumbing of the corpus operators: scratch tables, word bytes, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables of at most this many rows of two longs may be broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000

# Bounds of a batch of texts on its way to a Python worker.
TEXT_ROWS = 1_000
TEXT_BYTES = 8_000_000
BATCH_ROWS, BATCH_BYTES = (f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes"))
# Edges of a graph that one task finishes; larger graphs are contracted on all executors first.
LOCAL_EDGES = 500_000

_WORD_BYTES = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
# Byte map of the alphanumeric word rule: A-Z folded, every ASCII non-word byte a space.
WORD_MAP = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in _WORD_BYTES else 32
    for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``. Only a local master may leave it unset and
    gets a fresh folder; elsewhere each executor would write to a disk of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lumenfold_scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark._lumenfold_scratch = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
    return root.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has such columns (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def materialize(df: DataFrame, name: str = "t", partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and a lost
    executor never makes an upstream stage run again."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lumenfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a (materialized) table has at most ``limit`` rows."""
    return df.count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the counted size allows it; otherwise left to a shuffle join, whose
    skewed partitions adaptive execution splits."""
    return F.broadcast(df) if small_enough(df, limit) else df


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bound the Arrow batches of this session to ``rows`` texts and ``TEXT_BYTES`` bytes: several copies of
    a batch live in the JVM, in Arrow's buffers and in the worker at once. A smaller bound that is set
    already stays. Spark reads these settings when a plan runs, and what an operator returns runs later, so
    they stay too; ``restore_batches`` puts the caller's back."""
    before = getattr(spark, "_lumenfold_batches", None)
    if before is None:
        before = spark._lumenfold_batches = {k: spark.conf.get(k) for k in (BATCH_ROWS, BATCH_BYTES)}
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))
    if not 0 < _bytes_of(spark.conf.get(BATCH_BYTES)) <= TEXT_BYTES:
        spark.conf.set(BATCH_BYTES, f"{TEXT_BYTES}b")


def restore_batches(spark: SparkSession) -> None:
    """The batch settings that the session had before the first operator on texts."""
    for k, v in (getattr(spark, "_lumenfold_batches", None) or {}).items():
        spark.conf.set(k, v)
    spark._lumenfold_batches = None


def _bytes_of(size: str) -> int:
    m = re.fullmatch(r"(-?[0-9]+)\s*([kmgtp]?)i?b?", size.strip().lower())
    return int(m[1]) * 1024 ** " kmgtp".index(m[2] or " ") if m else 0


def tidied(run):
    """``run`` as a batch function that hands freed memory back to the system at its end: Python workers
    live on between tasks, and what their allocators keep adds up beside the JVM."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 (wraps silently)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Memo of 64-bit word hashes; emptied when it holds ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph given as rows of two ids.

    Returns ``(node, component)``, ``component`` being the smallest node id reachable, for
    every node that has an edge to another one. Randomised contraction: in each round every
    node adopts the neighbour (or itself) of least hash and edges are rewritten to the adopted
    nodes, so the number of remaining edges falls geometrically whatever the ids' order; no
    table leaves the executors. Once at most ``LOCAL_EDGES`` are left, one task joins them. Nulls and
    self-loops are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = materialize(
        e.where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    labels, turn = None, 0
    while (left := e.count()) > LOCAL_EDGES:
        turn += 1
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: B023, E731
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        adopted = (
            both.groupBy("u")
            .agg(F.min(F.struct(rank("v").alias("r"), F.col("v").alias("n"))).alias("best"))
            .select(
                "u",
                F.when(F.struct(rank("u"), F.col("u")) < F.col("best"), F.col("u"))
                .otherwise(F.col("best.n"))
                .alias("to"),
            )
        )
        adopted = materialize(adopted, "adopted")
        labels = adopted.select(F.col("u").alias("node"), F.col("to").alias("cur")) if labels is None else _follow(labels, adopted, "u", "to")
        labels = materialize(labels, "labels")
        to_u = adopted.select("u", F.col("to").alias("tu"))
        to_v = adopted.select(F.col("u").alias("v"), F.col("to").alias("tv"))
        e = materialize(
            e.join(to_u, "u")
            .join(to_v, "v")
            .where("tu <> tv")
            .select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v"))
            .distinct(),
            "edges",
        )
    rest = materialize(e.coalesce(1).mapInArrow(_join_edges, "node long, component long"), "components") if left else None
    if labels is None:
        return rest if rest is not None else edges.sparkSession.createDataFrame([], "node long, component long")
    if rest is not None:
        labels = materialize(_follow(labels, rest, "node", "component"), "labels")
    least = materialize(labels.groupBy("cur").agg(F.min("node").alias("component")), "least")
    return labels.join(least, "cur").select("node", "component")


def _follow(labels: DataFrame, moves: DataFrame, old: str, new: str) -> DataFrame:
    """``node, cur`` after the nodes that moved."""
    moves = moves.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return labels.join(moves, labels["cur"] == moves["__old"], "left").select("node", F.coalesce("__new", "cur").alias("cur"))


def _join_edges(batches) -> Iterator:
    """``node, component`` of a bounded list of edges: labels fall to the least neighbour's and jump along
    themselves until no edge has two."""
    import pyarrow as pa

    pairs = [[batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)] for batch in batches]
    u, v = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    node, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = flat[: len(u)], flat[len(u) :]
    at = np.arange(len(node))
    while len(u):
        low = np.minimum(at[u], at[v])
        for end in (u, v):
            np.minimum.at(at, at[end], low)
        while (at[at] != at).any():
            at = at[at]
        apart = at[u] != at[v]
        u, v = u[apart], v[apart]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[at])], ["node", "component"])


def with_fields(df: DataFrame, more: str):
    """Schema of ``df`` followed by ``name type`` fields."""
    from pyspark.sql import types as T

    kinds = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([*df.schema.fields, *(T.StructField(n, kinds[k]) for n, k in (item.split(" ") for item in more.split(", ")))])
