import collections
import random

import numpy as np

from lumenfold.llm import sharding as S

from .helpers import awkward, frame


def test_matrix_sums_and_law():
    rows, cols = np.array([5, 0, 3, 8]), np.array([4, 4, 8])
    total = np.zeros((4, 3))
    for seed in range(4000):
        m = S.communication_matrix(rows, cols, seed)
        assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == cols).all() and (m >= 0).all()
        total += m
    assert np.abs(total / 4000 - np.outer(rows, cols) / 16).max() < 0.08


def test_matrix_in_groups(monkeypatch):
    monkeypatch.setattr(S, "GROUP", 3)
    rows = np.arange(20)
    cols = np.array([100, 50, 40])
    m = S.communication_matrix(rows, cols, 1)
    assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == cols).all()


def test_deal_equals_a_whole_matrix(monkeypatch):
    monkeypatch.setattr(S, "GROUP", 3)
    rows, quota = np.arange(11), np.array([20, 20, 15])
    d = S.Deal(rows, quota, 5)
    own = np.array([d.of(i)[0] for i in range(11)])
    assert (own.sum(axis=1) == rows).all() and (own.sum(axis=0) == quota).all()
    assert (np.array([d.of(i)[1] for i in (9, 0, 5, 2)]) == (np.cumsum(own, axis=0) - own)[[9, 0, 5, 2]]).all()


def test_shards_with_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 2)
    rows = S.shuffle_into_shards(spark.range(0, 300, 1, 7).withColumnRenamed("id", "doc_id"), 40).toPandas()
    assert sorted(rows.doc_id) == list(range(300))
    assert rows.groupby("shard").size().isin([7, 8]).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))


def test_huge_populations():
    rng = np.random.default_rng(0)
    for good, bad, n in ((10**10, 3 * 10**10, 10**9), (1, 10**10, 5), (10**10, 1, 10**10), (4 * 10**11, 10**13, 10**10)):
        k = S._hypergeometric(rng, good, bad, n)
        assert max(0, n - bad) <= k <= min(good, n)


def test_log_factorials():
    import math

    for n in (0, 1, 199, 200, 201, 1000, 10**6):
        assert abs(float(S.log_factorial(n)) - math.lgamma(n + 1)) <= 1e-13 * max(1, math.lgamma(n + 1))
    from decimal import Decimal, localcontext

    with localcontext() as ctx:
        ctx.prec = 50
        for n in (200, 5000):
            assert abs(S.log_factorial(n + 1) - S.log_factorial(n) - Decimal(n + 1).ln()) < Decimal("1e-32")


def test_rejection_follows_the_law():
    """Counts of small cases against the exact chances, and mean and variance of a huge one."""
    import math

    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 6), (30, 20, 25), (3, 40, 9), (1, 9, 1)):
        draws = np.bincount([S._rejection_hypergeometric(rng, good, bad, n) for _ in range(3000)], minlength=n + 1)
        want = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if k <= good and n - k <= bad else 0 for k in range(n + 1)]) * 3000
        assert draws[want == 0].sum() == 0
        chi = ((draws - want) ** 2 / np.maximum(want, 1e-9))[want > 5].sum()
        assert chi < 30
    good, bad, n = 2 * 10**10, 6 * 10**10, 10**9
    x = np.array([S._rejection_hypergeometric(rng, good, bad, n) for _ in range(600)], dtype=float)
    var = n * 0.25 * 0.75 * (1 - n / (good + bad))
    assert abs(x.mean() - n / 4) < 5 * (var / 600) ** 0.5 and 0.8 < x.var() / var < 1.25


def test_matrix_against_a_plain_shuffle():
    """Mean and covariance of matrix cells against those of cut permutations."""
    rows, cols = np.array([6, 2, 8]), np.array([5, 5, 6])
    part, rng = np.repeat(np.arange(3), rows), np.random.default_rng(3)

    def shuffled():
        m = np.zeros((3, 3))
        np.add.at(m, (rng.permutation(part), np.repeat(np.arange(3), cols)), 1)
        return m.ravel()

    a = np.array([shuffled() for _ in range(5000)])
    b = np.array([S.communication_matrix(rows, cols, seed).ravel() for seed in range(5000)])
    assert np.abs(a.mean(axis=0) - b.mean(axis=0)).max() < 0.1 and np.abs(np.cov(a.T) - np.cov(b.T)).max() < 0.1


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        at = S.permute_index(np.arange(n), np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(at) == list(range(n))
    a = S.permute_index(np.arange(1000), np.full(1000, 1000), np.full(1000, 1, dtype=np.uint64))
    assert abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


def test_shards(spark):
    rng = random.Random(2)
    texts = [(i, f"t{i}") for i in range(500)] + list(awkward(rng).items()) + [(1, "t1")] * 3
    docs = frame(spark, texts).withColumnsRenamed({"key": "shard", "component": "__part", "sequence_id": "__lf_row"}).repartition(7)
    out = S.shuffle_into_shards(docs, 40)
    rows = out.toPandas()
    assert set(rows["__part"]) == {"c"} and set(rows["__lf_row"]) == {"q"}
    assert len(rows) == len(texts) and set(rows.columns) == {*docs.columns, "slot"}
    sizes = rows.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    key = lambda i, t: (int(i), None if t is None or t != t else t)
    assert collections.Counter(key(i, t) for i, t in zip(rows.doc_id, rows.text)) == collections.Counter(map(tuple, texts))


def test_more_shards_than_rows_and_none(spark):
    rows = S.shuffle_into_shards(frame(spark, {1: "a", 2: "b"}), 40).toPandas()
    assert len(rows) == 2 and list(rows.slot) == [0, 0] and rows["shard"].nunique() == 2
    assert S.shuffle_into_shards(frame(spark, {}), 40).count() == 0


def test_spread_is_uniform(spark):
    """Rows of one input partition go everywhere alike."""
    docs = spark.range(0, 8000, 1, 4).withColumnRenamed("id", "doc_id")
    rows = S.shuffle_into_shards(docs, 8).toPandas()
    table = np.zeros((4, 8))
    np.add.at(table, (rows.doc_id // 2000, rows["shard"]), 1)
    chi = ((table - 250) ** 2 / 250).sum()
    assert chi < 60  # 21 degrees of freedom
    assert abs(np.corrcoef(rows.doc_id, rows.slot)[0, 1]) < 0.05
