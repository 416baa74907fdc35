"""Approximate nearest neighbours on randomly rotated one-bit codes.

Vectors are assigned to the nearest of about the square root of their number of centroids (k-means on
a bounded sample; beyond ``FIRST_LISTS`` a second level of centroids is fitted to what the first leaves,
and a list is a pair of both). What is left after subtracting the centroid is rotated by one random
orthogonal matrix and reduced to the signs of its coordinates, packed 64 to a word. With two correction
scalars a code (its residual's norm and the product of the unit residual with the code's own direction)
the inner product with a rotated query is estimated without bias, and the estimate's error exceeds
``EPSILON`` deviations only rarely. A query first scans the codes of as many of its nearest lists as hold
``FOUND_IN`` of the true neighbours of sample queries that the centroids were not fitted on; the best
estimates, scored exactly, give a bar, and a vector is reranked exactly, on the original components,
if its upper bound reaches the bar. Then every further list is scanned whose own bound can still beat the query's
last score: its centroid's product plus as many deviations of its farthest residual's as ``BEATEN_IN`` of those
sample queries' neighbours need. So a query whose neighbours lie in many or far lists scans more of them.

Every vector is indexed. Lists near one another make a group of about ``BLOCK`` rows, which one task
scans, so a query travels once to each group that holds any of its lists; a list or group that is larger,
such as one with a third of all rows, is cut into blocks by a hash of the id, and the queries of a
group into parts of ``QUERY_BLOCK``. Equal vectors of a block are scanned once, keeping as many
ids as a result can hold. The driver holds the sample, the centroids and a few numbers a list.

Defined results: vectors that are null, zero, hold null or non-finite components, or are not of
the usual (most frequent) length take no part; an id with several vectors counts once, at its best score;
an empty table gives no rows; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, mix64, read

K = 20
QUERY_EVERY = 20
SAMPLE_ROWS = 40_000  # bounds of what centroids are fitted on: rows and numbers
SAMPLE_VALUES = 8_000_000
ROWS_PER_LIST = 16  # sample rows that a centroid needs
FIRST_LISTS = 2_048
SECOND_LISTS = 1_024
BLOCK = 8_192
QUERY_BLOCK = 8_192
FOUND_IN = 0.95  # share of true neighbours in the scanned lists, measured on held-out sample rows
BEATEN_IN = 0.98  # share of true neighbours, measured there too, whose list's bound reaches the query's last score
HELD_OUT = 256
CHUNK = 64  # queries whose estimates are held at once
EPSILON = 2.4  # deviations of the estimate's error bound
SEED = 7


@dataclass
class Index:
    """``first`` and ``second`` centroids (the second of one zero row, if there is one level) and the rotation.
    List i * len(second) + j has the centroid first[i] + second[j]."""

    first: np.ndarray
    second: np.ndarray
    rotation: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.first) * len(self.second)

    def centroid(self, k: int) -> np.ndarray:
        return self.first[k // len(self.second)] + self.second[k % len(self.second)]

    def place(self, x: np.ndarray) -> np.ndarray:
        near = nearest_row(x, self.first)
        if len(self.second) == 1:
            return near
        return near * len(self.second) + nearest_row(x - self.first[near], self.second)

    def products(self, q: np.ndarray) -> np.ndarray:
        """Inner product of each query with the centroid of each list."""
        return ((q @ self.first.T)[:, :, None] + (q @ self.second.T)[:, None, :]).reshape(len(q), -1)


def nearest_row(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = 0.5 * (centroids**2).sum(axis=1)
    out = np.empty(len(x), dtype=np.int64)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (half - x[lo : lo + 4096] @ centroids.T).argmin(axis=1)
    return out


def cluster(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """At most ``n`` centroids by Lloyd's rounds."""
    distinct = np.unique(x, axis=0)
    n = max(1, min(n, len(distinct)))
    centroids = distinct[rng.choice(len(distinct), n, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest_row(distinct, centroids)
        size = np.bincount(near, minlength=n)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(size)
        centroids[full] = np.add.reduceat(distinct[order], (np.cumsum(size) - size)[full], axis=0) / size[full, None]
    return centroids


def fit(sample: np.ndarray, lists: int, seed: int = SEED) -> Index:
    """Centroids for about ``lists`` lists and a random rotation."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    one = min(lists, FIRST_LISTS, max(1, len(sample) // ROWS_PER_LIST))
    first = cluster(sample, one, rng)
    second = np.zeros((1, dim))
    two = min(SECOND_LISTS, -(-lists // len(first)), max(1, len(sample) // ROWS_PER_LIST))
    if two > 1 and one < lists:
        second = cluster(sample - first[nearest_row(sample, first)], two, rng)
    return Index(first, second, rotation)


def calibrate(index: Index, base: np.ndarray, queries: np.ndarray, k: int, share: float = FOUND_IN) -> int:
    """The number of lists, in a query's order, that hold ``share`` of the ``k`` nearest rows of ``base``.
    Neighbours are farther in a sample than in the whole table, so this errs upward."""
    if index.lists == 1 or len(base) == 0 or len(queries) == 0:
        return index.lists
    place = index.place(base)
    near = min(k, len(base))
    ranks = []
    for q in queries:
        score = base @ q
        at = index.products(q[None])[0]
        best = place[np.argpartition(-score, near - 1)[:near]]
        ranks.append([(at > at[p]).sum() for p in best])
    return int(np.quantile(np.concatenate(ranks), share, method="higher")) + 1


def reach(index: Index, base: np.ndarray, queries: np.ndarray, k: int, share: float = BEATEN_IN) -> float:
    """The deviations that a list's bound needs, so that it reaches the score of the last of the ``k`` nearest rows
    of ``base`` for ``share`` of the neighbours. A deviation is the product's of a random direction with
    the list's farthest residual."""
    if index.lists == 1 or len(base) == 0 or len(queries) == 0:
        return np.inf
    place = index.place(base)
    used, own = np.unique(place, return_inverse=True)
    centroids = np.stack([index.centroid(int(c)) for c in used])
    far = np.zeros(len(used))
    np.maximum.at(far, own, np.linalg.norm(base - centroids[own], axis=1))
    near = min(k, len(base))
    needed = []
    for q in queries:
        score = base @ q
        best = np.argpartition(-score, near - 1)[:near]
        short = score[best].min() - centroids[own[best]] @ q
        needed.append(short / np.maximum(np.linalg.norm(q) * far[own[best]] / np.sqrt(base.shape[1]), 1e-300))
    return float(np.quantile(np.concatenate(needed), share, method="higher"))


def groups_of(index: Index, rows: np.ndarray, block: int) -> np.ndarray:
    """The group of each list: neighbouring lists together, about ``block`` rows a group."""
    order = np.arange(index.lists)
    if len(index.second) == 1 and index.lists > 2:
        near = nearest_row(index.first, cluster(index.first, max(1, round(rows.sum() / block)), np.random.default_rng(SEED)))
        order = np.argsort(near, kind="stable")
    ends = np.cumsum(rows[order])
    out = np.empty(index.lists, dtype=np.int64)
    # By the middle of a list, so that no group is left with a small remainder.
    out[order] = (ends - rows[order] / 2) // block
    return np.unique(out, return_inverse=True)[1]


# ---------------------------------------------------------------- codes


def pack_signs(r: np.ndarray) -> np.ndarray:
    """Sign bits of each row, as uint64 words."""
    pad = -r.shape[1] % 64
    bits = np.pad(r > 0, ((0, 0), (0, pad)))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


@dataclass
class Codes:
    """Packed codes and correction scalars of vectors of one list."""

    bits: np.ndarray
    ones: np.ndarray
    norm: np.ndarray
    align: np.ndarray

    @staticmethod
    def of(x: np.ndarray, centroid: np.ndarray, rotation: np.ndarray) -> Codes:
        r = (x - centroid) @ rotation.T
        norm = np.linalg.norm(r, axis=1)
        # Product of the unit residual with the unit vector of its signs.
        align = np.abs(r).sum(axis=1) / np.maximum(norm, 1e-300) / np.sqrt(x.shape[1])
        bits = pack_signs(r)
        return Codes(bits, np.bitwise_count(bits).sum(axis=1).astype(np.float32), norm, np.maximum(align, 1e-3))


@dataclass
class Planes:
    """Rotated queries held in 4 bits a component, so that the product with a sign code is a sum of bit
    counts: for planes p of the query, 2**p times the ones that plane and code share."""

    words: list[np.ndarray]
    low: np.ndarray
    width: np.ndarray
    total: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(queries: np.ndarray, rotation: np.ndarray) -> Planes:
        q = queries @ rotation.T
        low = q.min(axis=1, keepdims=True)
        width = np.maximum((q.max(axis=1, keepdims=True) - low) / 15, 1e-12)
        level = np.rint((q - low) / width).astype(np.uint8)
        words = [pack_signs((level >> p) & 1) for p in range(4)]
        return Planes(words, low, width, width * level.sum(axis=1, keepdims=True) + low * q.shape[1], np.linalg.norm(q, axis=1, keepdims=True))


def estimate(codes: Codes, planes: Planes, at: np.ndarray, shift: np.ndarray, dim: int, epsilon: float = EPSILON):
    """(estimate, error bound) of the inner products of queries ``at`` with each coded vector; ``shift``
    are their products with the list's centroid."""
    low, width = planes.low[at], planes.width[at]
    shared = np.zeros((len(at), len(codes.norm)), dtype=np.uint32 if dim > 4_000 else np.uint16)
    for w in range(codes.bits.shape[1]):
        for p in range(4):
            shared += np.multiply(np.bitwise_count(planes.words[p][at, w, None] & codes.bits[None, :, w]), 1 << p, dtype=shared.dtype)
    f = np.float32
    # <q, sign vector> with components +-1/sqrt(dim), from the products with the 0/1 code; then scaled by
    # the residual's norm over its alignment, and the centroid's share added.
    root = np.sqrt(dim)
    est = shared.astype(f)
    est *= (2 * width / root).astype(f)
    est += (2 * low / root).astype(f) * codes.ones[None, :]
    est -= (planes.total[at] / root).astype(f)
    est *= (codes.norm / codes.align).astype(f)
    est += shift[:, None].astype(f)
    rounding = width * np.sqrt(dim / 12.0) / root
    spread = np.sqrt(np.maximum(1 - codes.align**2, 0)) / codes.align / np.sqrt(max(dim - 1, 1))
    err = (epsilon * codes.norm * spread).astype(f) * planes.norm[at].astype(f)
    err += (epsilon * codes.norm / codes.align).astype(f) * rounding.astype(f)
    return est, err


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


# ---------------------------------------------------------------- one block


class Block:
    """Distinct vectors of a block, sorted by list, with the least ids of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, k: int):
        h = mix64(np.ascontiguousarray(x).view(np.uint64) + np.arange(x.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64)
        order = np.lexsort((ids, h, lists))
        ids, x, lists = ids[order], x[order], lists[order]
        new = np.r_[True, (x[1:] != x[:-1]).any(axis=1) | (lists[1:] != lists[:-1])]
        again = np.r_[False, (ids[1:] == ids[:-1]) & ~new[1:]]
        ids, which = ids[~again], (np.cumsum(new) - 1)[~again]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        # Copies tie, and of ties the smaller ids win: k + 1 of them are enough for any result.
        keep = np.arange(len(which)) - first[which] <= k
        self.ids, which = ids[keep], which[keep]
        self.first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        self.count = np.diff(np.r_[self.first, len(which)])
        self.x, self.lists = np.ascontiguousarray(x[new]), lists[new]
        self.most = int(np.unique(self.ids, return_counts=True)[1].max())  # vectors of one id
        self.names, start = np.unique(self.lists, return_index=True)
        self.edges = np.r_[start, len(self.lists)]

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, position in ``at``) of the vectors ``at``."""
        n = self.count[at]
        own = np.repeat(np.arange(len(at)), n)
        return self.ids[self.first[at][own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], own

    def search(self, index: Index, q_ids: np.ndarray, q: np.ndarray, probed: list[np.ndarray], bars: np.ndarray, k: int, epsilon: float = EPSILON) -> Iterator:
        """(query, ids, scores) of the best ``k`` for each query among its probed lists; scores under its bar may be missing."""
        n, dim = self.x.shape
        centroids = np.stack([index.centroid(int(c)) for c in self.names])
        codes = [Codes.of(self.x[a:b], c, index.rotation) for c, a, b in zip(centroids, self.edges[:-1], self.edges[1:])]
        top = (k + 1) * self.most
        slack = 1e-12 * float(np.sqrt((self.x**2).sum(axis=1).max()))
        for lo in range(0, len(q), CHUNK):
            part = q[lo : lo + CHUNK]
            planes, shift = Planes.of(part, index.rotation), part @ centroids.T
            est, high = np.full((len(part), n), -np.inf, np.float32), np.full((len(part), n), -np.inf, np.float32)
            asks = np.zeros((len(part), len(self.names)), dtype=bool)
            for i, lists in enumerate(probed[lo : lo + CHUNK]):
                at = np.minimum(np.searchsorted(self.names, lists), len(self.names) - 1)
                asks[i, at[self.names[at] == lists]] = True
            for j, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:])):
                at = np.flatnonzero(asks[:, j])
                if len(at):
                    est[at, a:b], err = estimate(codes[j], planes, at, shift[at, j], dim, epsilon)
                    high[at, a:b] = est[at, a:b] + err
            for i, v in enumerate(part):
                bar = bars[lo + i]
                if bar == -np.inf and n > 2 * top:
                    best = np.argpartition(est[i], n - 2 * top)[n - 2 * top :]
                    best = best[est[i, best] > -np.inf]
                    if len(best) >= top:
                        bar = np.partition(self.x[best] @ v, len(best) - top)[len(best) - top]
                pick = np.flatnonzero((high[i] >= (bar - 1e-6 * abs(bar) if bar > -np.inf else bar)) & (high[i] > -np.inf))
                if len(pick) > top:
                    about = self.x[pick] @ v
                    pick = pick[about >= np.partition(about, len(about) - top)[len(about) - top] - slack * float(np.linalg.norm(v))]
                cand, own = self.ids_of(pick)
                score = exact(self.x[pick], v)[own]
                other = (cand != q_ids[lo + i]) & (score >= bars[lo + i])
                cand, score = cand[other], score[other]
                order = np.lexsort((cand, -score))
                if self.most > 1:
                    order = order[np.sort(np.unique(cand[order], return_index=True)[1])]
                order = order[:k]
                yield q_ids[lo + i], cand[order], score[order]


# ---------------------------------------------------------------- the operator


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the rows that take part; ``v`` is of floats if the column is, else of doubles."""
    kind = df.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), ok.alias("ok")).where("ok").drop("ok")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual[0] if usual else 0))


def _matrix(column) -> np.ndarray:
    """Rows of a list column of one length, as doubles."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def sample_of(rows: DataFrame, total: int, dim: int) -> np.ndarray:
    """A bounded sample by a hash of the id. Thinned on the executors to little more than the bound."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    if total > 2 * most:
        rows = rows.where(draw < int((1 << 40) * (1.1 * most + 100) / total))
    found = rows.select(draw.alias("draw"), "vec_id", "v").toArrow()
    x = _matrix(found.column("v"))
    order = np.lexsort((*x.T[:1], found.column("vec_id").to_numpy(), found.column("draw").to_numpy()))
    return x[order[:most]]


def nearest_neighbours(df: DataFrame, k: int = K, every: int = QUERY_EVERY, found_in: float = FOUND_IN, epsilon: float = EPSILON, beaten_in: float = BEATEN_IN) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k``
    nearest others by inner product."""
    import pyarrow as pa

    spark = df.sparkSession
    rows = valid_vectors(df)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("v")).alias("dim")).first()
    total = size["n"]
    if total == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = sample_of(rows, total, size["dim"])
    held = len(sample) - min(HELD_OUT, len(sample) // 8)
    index = fit(sample[:held], 1 if total <= BLOCK else round(total**0.5))
    probes = calibrate(index, sample[:held], sample[held:], k, found_in)
    margin = reach(index, sample[:held], sample[held:], k, beaten_in) if probes < index.lists else 0.0
    indexed = spark.sparkContext.broadcast(index)
    kind = rows.schema["v"].dataType.simpleString()

    def assign(batches) -> Iterator:
        index = indexed.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                near = index.place(x)
                held, own = np.unique(near, return_inverse=True)
                far = np.linalg.norm(x - np.stack([index.centroid(int(c)) for c in held])[own], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], ["vec_id", "v", "list", "far"])

    placed = materialize(rows.mapInArrow(assign, f"vec_id long, v {kind}, list int, far double"), "placed")
    per_list = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toPandas()  # a few numbers a list
    held_by, far = np.zeros(index.lists, dtype=np.int64), np.full(index.lists, -np.inf)
    held_by[per_list["list"]], far[per_list["list"]] = per_list["n"], per_list["far"]
    group = groups_of(index, held_by, BLOCK)

    def parts_of(batches) -> Iterator:
        step = max(1, 4_000_000 // indexed.value.lists)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                q = _matrix(part.column(1))
                yield part, q, indexed.value.products(q)

    def nearest_lists(batches) -> Iterator:
        """Parts of batches with the first lists of their queries, as (row, list) in order."""
        for part, _, at in parts_of(batches):
            lists = np.sort(np.argpartition(-at, probes - 1, axis=1)[:, :probes], axis=1)
            yield part, np.repeat(np.arange(len(lists)), probes), lists.ravel()

    def further_lists(batches) -> Iterator:
        """The same with the lists beyond the first whose bound reaches the query's last score."""
        for part, q, at in parts_of(batches):
            norm = np.linalg.norm(q, axis=1, keepdims=True)
            bound = at + norm * (margin / np.sqrt(q.shape[1])) * far
            # Between the last of the first lists and the next; a tie is scanned twice and counts once.
            edge = -np.partition(-at, (probes - 1, probes), axis=1)[:, probes - 1 : probes + 1].mean(axis=1, keepdims=True)
            bar = part.column(2).to_numpy(zero_copy_only=False)[:, None]
            yield part, *np.nonzero((at <= edge + 1e-12 * np.abs(at).max(axis=1, keepdims=True)) & (bound >= bar - 1e-9 * np.abs(bar)) & (held_by > 0))

    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.lit(float("-inf")).alias("bar"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        # At most k rows a query and block, brought together by query once: for an id's best score and the rank.
        found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = best(_scan(placed.select("vec_id", "v", "list"), queries, indexed, group, held_by, nearest_lists, k, epsilon))
    if probes == index.lists:
        return found
    found = materialize(found, "found")
    last = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bar"))
    barred = queries.drop("bar").join(last, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
    barred = materialize(barred, "barred")
    more = _scan(placed.select("vec_id", "v", "list"), barred, indexed, group, held_by, further_lists, k, epsilon)
    return best(found.drop("rank").unionByName(more))


def _scan(placed: DataFrame, queries: DataFrame, indexed, group: np.ndarray, held_by: np.ndarray, lists_of, k: int, epsilon: float) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of each block for each of ``queries`` (``vec_id, v, bar``) in the lists that
    ``lists_of`` gives it, without scores under the bar; a vector goes only where some query asks."""
    import pyarrow as pa

    spark, kind = placed.sparkSession, placed.schema["v"].dataType.simpleString()
    n_groups = int(group.max()) + 1
    blocks = np.maximum(1, np.rint(np.bincount(group, held_by, n_groups) / BLOCK)).astype(np.int64)
    grouped = spark.sparkContext.broadcast(group)

    def by_group(batches) -> Iterator:
        """Batches with (row, group) in order, where the lists of each start, and the lists."""
        for batch, row, lists in lists_of(batches):
            g = grouped.value[lists]
            order = np.lexsort((lists, g, row))
            row, g, lists = row[order], g[order], lists[order]
            start = np.flatnonzero(np.r_[np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (g[1:] != g[:-1])])
            yield batch, row[start], g[start], np.r_[start, len(lists)], lists

    def count_asked(batches) -> Iterator:
        n = np.zeros(n_groups, dtype=np.int64)
        for _, _, g, _, _ in by_group(batches):
            n += np.bincount(g, minlength=n_groups)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["g", "n"])

    asked = queries.mapInArrow(count_asked, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    parts = np.zeros(n_groups, dtype=np.int64)
    parts[asked["g"]] = -(-asked["n"] // QUERY_BLOCK)
    dealt = spark.sparkContext.broadcast((blocks, parts))

    def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, 0 to n - 1) for each row as often as n says."""
        row = np.repeat(np.arange(len(n)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

    def store(batches) -> Iterator:
        """Each vector in its block, once for every part of the group's queries."""
        blocks, parts = dealt.value
        for batch in batches:
            ids, lists = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            g = grouped.value[lists]
            row, part = spread(parts[g])
            block = (mix64(ids.view(np.uint64)) % blocks[g].astype(np.uint64)).astype(np.int32)
            some = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[row].astype(np.int32)), pa.array(block[row]), pa.array(part.astype(np.int32)), *some.columns], ["g", "block", "part", "vec_id", "v", "list"]
            )

    def ask(batches) -> Iterator:
        """Each query with its lists of a group, once for every block of the group."""
        blocks, parts = dealt.value
        for batch, owner, g, ends, lists in by_group(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            row, block = spread(blocks[g])
            held = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(lists.astype(np.int32))).take(pa.array(row))
            part = mix64(ids[owner[row]].view(np.uint64) + np.uint64(SEED)) % np.maximum(parts[g[row]], 1).astype(np.uint64)
            some = batch.take(pa.array(owner[row]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[row].astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), *some.columns, held], ["g", "block", "part", "vec_id", "v", "bar", "lists"]
            )

    left = placed.mapInArrow(store, f"g int, block int, part int, vec_id long, v {kind}, list int")
    right = queries.mapInArrow(ask, f"g int, block int, part int, vec_id long, v {kind}, bar double, lists array<int>")

    def scan(key, a, b):
        out: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if a.num_rows and b.num_rows:
            block = Block(a.column("vec_id").to_numpy(), _matrix(a.column("v")), a.column("list").to_numpy(), k)
            held = b.column("lists").combine_chunks()
            at, flat = held.offsets.to_numpy(), held.values.to_numpy()
            probed = [np.sort(flat[s:e]) for s, e in zip(at[:-1], at[1:])]
            for query, ids, score in block.search(indexed.value, b.column("vec_id").to_numpy(), _matrix(b.column("v")), probed, b.column("bar").to_numpy(), k, epsilon):
                for column, values in zip(out, (np.full(len(ids), query), ids, score)):
                    column.append(values)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out))))

    keys = ("g", "block", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


_USED = "embedding IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0"
OP8_SQL = f"""
WITH d AS (SELECT DISTINCT vec_id, embedding, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
v AS (SELECT vec_id, v FROM d WHERE {_USED}),
u AS (SELECT len(v) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
w AS (SELECT vec_id, v FROM v, u WHERE len(v) = u.n),
r AS (SELECT a.vec_id AS query_id, b.vec_id, max(list_inner_product(a.v, b.v)) AS score FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_EVERY} = 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= {K}
"""
