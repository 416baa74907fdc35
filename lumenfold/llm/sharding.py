"""Uniform shuffle into shards through a hypergeometric communication matrix.

A uniform permutation of all rows, cut into shards of fixed sizes, sends from each input
partition a random number of rows to each shard; those numbers form a matrix with given row
sums (partition sizes) and column sums (shard sizes) whose law is multivariate hypergeometric.
Drawing the matrix first makes shard sizes exact. Populations beyond numpy's generator (a billion) are
drawn from the same law by rejection, with log factorials to 40 digits. Each partition then permutes its
own rows and deals them by its matrix row, and each shard permutes what it gets.

Defined results: every row gets a shard and a slot, repeated rows and nulls included; shard
sizes differ by at most one; an empty table gives no rows; input columns named ``shard`` or
``slot`` are replaced.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from math import factorial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, mix64, read, with_fields

SHARDS = 40
SEED = 20_240_601
# Rows of a shard that one task sorts and writes.
BLOCK_ROWS = 500_000
# Partitions whose matrix rows are drawn together; more are drawn in groups, groups first.
GROUP = 2_048
_PI = Decimal("3.14159265358979323846264338327950288419716939937510582")


def split_row(rng: np.random.Generator, n: int, columns: np.ndarray) -> np.ndarray:
    """How many of ``n`` rows drawn without replacement fall to each column's open places."""
    out = np.zeros(len(columns), dtype=np.int64)
    rest = int(columns.sum())
    for j, c in enumerate(columns):
        if n == 0:
            break
        rest -= int(c)
        out[j] = _hypergeometric(rng, int(c), rest, n)
        n -= int(out[j])
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    return _rejection_hypergeometric(rng, good, bad, n)


def log_factorial(n: int) -> Decimal:
    """ln n! to the digits of the decimal context, by Stirling's series."""
    if n < 200:
        return Decimal(factorial(n)).ln()
    x = Decimal(n)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9) - 691 / (360360 * x**11) + 1 / (156 * x**13)
    return x * x.ln() - x + (2 * _PI * x).ln() / 2 + series


def _rejection_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The good ones among ``n`` drawn from ``good + bad``, by rejection from a flat top with exponential
    tails about the mode, which lies above every log-concave law whose greatest chance is the flat one
    (Devroye, Non-uniform random variate generation, X.2)."""
    with localcontext() as ctx:
        ctx.prec = 50
        low, high = max(0, n - bad), min(good, n)
        mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)

        def weight(k: int) -> Decimal:
            return -sum(map(log_factorial, (k, good - k, n - k, bad - n + k)), Decimal(0))

        top = weight(mode)
        whole = log_factorial(good) + log_factorial(bad) + log_factorial(n) + log_factorial(good + bad - n) - log_factorial(good + bad)
        # Rounded up a little, so that the hull is never below the law.
        chance = float((top + whole).exp()) * (1 + 1e-12)
        w = 1 + chance / 2
        while True:
            y = rng.random() * w / chance if rng.random() <= w / (1 + w) else (w + rng.exponential()) / chance
            k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
            if low <= k <= high and np.log(rng.random()) + min(0.0, w - chance * y) <= float(weight(k) - top):
                return k


def communication_matrix(rows: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """Random matrix with these row and column sums; ``rows.sum() == columns.sum()``."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    if len(rows) > GROUP:
        starts = np.arange(0, len(rows), GROUP)
        groups = communication_matrix(np.add.reduceat(rows, starts), columns, seed + 1)
        for g, s in enumerate(starts):
            out[s : s + GROUP] = communication_matrix(rows[s : s + GROUP], groups[g], seed + 2 + g)
        return out
    left = columns.astype(np.int64).copy()
    for i, n in enumerate(rows):
        out[i] = split_row(rng, int(n), left)
        left -= out[i]
    return out


class Deal:
    """The matrix of many partitions, held as one row per group of ``GROUP`` partitions; a group's own rows
    are drawn again, from the same seed, by the tasks that need them. What is broadcast is thus a size
    per partition and a ``GROUP``-th of the matrix."""

    def __init__(self, rows: np.ndarray, quota: np.ndarray, seed: int):
        self.rows, self.seed, self.group = rows, seed, GROUP
        starts = np.arange(0, len(rows), GROUP)
        sums = np.add.reduceat(rows, starts) if len(rows) else np.zeros(0, np.int64)
        self.groups = communication_matrix(sums, quota, seed + 1)
        self.before = np.cumsum(self.groups, axis=0) - self.groups  # rows a shard has from earlier groups
        self.open: tuple[int, np.ndarray, np.ndarray] | None = None

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of partition ``i`` for each shard, rows each shard has from earlier partitions)."""
        g = i // self.group
        if self.open is None or self.open[0] != g:
            part = communication_matrix(self.rows[g * self.group : (g + 1) * self.group], self.groups[g], self.seed + 2 + g)
            self.open = (g, part, np.cumsum(part, axis=0) - part + self.before[g])
        return self.open[1][i % self.group], self.open[2][i % self.group]


def permute_index(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudo-random permutation of ``0..size-1``, evaluated at single indexes: a six-round Feistel
    network on the next even power of two, walked until the value is in range. No list of the
    shard's rows is ever built, so a shard may be of any size."""
    index, size = index.astype(np.uint64), size.astype(np.uint64)
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(size.astype(np.float64), 2))).astype(np.uint64))
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    todo = np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(6):
            f = mix64(right ^ mix64(k + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))) & m
            left, right = right, left ^ f
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def shuffle_into_shards(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 to ``n_shards - 1``) and ``slot`` (gapless from
    0 in each shard), partitioned by blocks of slots and sorted."""
    import pyarrow as pa

    spark = df.sparkSession
    df = df.drop("shard", "slot")
    part_col, row_col = fresh(df, "__part", "__row")

    def number(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(n, n + k))],
                [*batch.schema.names, part_col, row_col],
            )
            n += k

    # Written once: the counts and the deal must see the same partitions, also after a retry.
    numbered = materialize(df.mapInArrow(number, with_fields(df, f"{part_col} int, {row_col} long")), "numbered")
    sizes = numbered.groupBy(part_col).count().toPandas().sort_values(part_col)
    parts, rows = sizes[part_col].to_numpy(np.int64), sizes["count"].to_numpy(np.int64)
    total = int(rows.sum())
    quota = np.full(n_shards, total // n_shards, dtype=np.int64)
    quota[np.random.default_rng(seed).permutation(n_shards)[: total % n_shards]] += 1
    shared = spark.sparkContext.broadcast((parts, rows, Deal(rows, quota, seed)))

    def deal(batches):
        parts, rows, matrix = shared.value
        orders: dict[int, np.ndarray] = {}
        for batch in batches:
            names = batch.schema.names
            part = batch.column(names.index(part_col)).to_numpy(zero_copy_only=False)
            row = batch.column(names.index(row_col)).to_numpy(zero_copy_only=False)
            shard, place = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            for p in np.unique(part):
                i = int(np.searchsorted(parts, p))
                if p not in orders:
                    orders.clear()  # a file holds whole partitions, so one is needed at a time
                    orders[p] = np.random.default_rng([seed, 7, int(p)]).permutation(rows[i])
                at = np.flatnonzero(part == p)
                dealt = orders[p][row[at]]
                own, arrived = matrix.of(i)
                ends = np.cumsum(own)
                s = np.searchsorted(ends, dealt, side="right")
                shard[at] = s
                place[at] = dealt - (ends - own)[s] + arrived[s]
            slot = permute_index(place, quota[shard], mix64(shard + np.int64(seed)))
            keep = [k for k, n in enumerate(names) if n not in (part_col, row_col)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(shard.astype(np.int32)), pa.array(slot)],
                [*(names[k] for k in keep), "shard", "slot"],
            )

    dealt = numbered.mapInArrow(deal, with_fields(df, "shard int, slot long"))
    blocks = n_shards * max(1, -(-int(quota.max(initial=0)) // block_rows))
    return dealt.repartition(blocks, "shard", F.floor(F.col("slot") / block_rows)).sortWithinPartitions("shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return shuffle_into_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
