"""Importance resampling against a plain Python version of its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import resampling

from .helpers import awkward, frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, order):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, order, buckets, percent, least, seed=2024):
    """(doc_id, n_features, weight, score, rank) of every row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, order))
    g = Counter(bucket(f) for _, t in target for f in features(t, order))
    s_all, t_all = sum(s.values()) + buckets, sum(g.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((g[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    rows = []
    for d, t in docs:
        f = features(t, order)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = Counter()
    ranks = {}
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault(r, []).append(k)
    out = []
    for r in rows:
        mine = ranks.get(r, [])
        out.append((*r, mine[drawn[r]] if drawn[r] < len(mine) else None))
        drawn[r] += 1
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def result(df):
    return key([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()])


def corpus(seed):
    rng = random.Random(seed)
    rows = list(awkward(rng).items())
    rows += [(i, prose(rng, rng.randrange(1, 9))) for i in range(120)]
    rows += [(None, prose(rng, 4)), (None, prose(rng, 5)), (7, prose(rng, 6)), (500, "Ünïcode ΑΒΓ İI 中文 a-B_c\x00d e\x7ff " * 5)]
    rows += [(300, rows[20][1])] * 40  # repeated rows: ties in every column
    return rows


@pytest.mark.parametrize("order, buckets, percent, least", [(1, 10_000, 10, 20), (1, 50, 100, 0), (2, 500, 33, 5), (3, 7, 50, 20)])
def test_against_brute_force(spark, order, buckets, percent, least):
    docs = corpus(order)
    target = [(i, prose(random.Random(i), 2)) for i in range(9)] + [(50, None), (51, "")]
    scored = resampling.score(frame(spark, docs), frame(spark, target), order, buckets)
    assert result(resampling.draw(scored, percent, least)) == key(brute(docs, target, order, buckets, percent, least))


def test_same_draw_on_any_partitioning(spark):
    docs, target = frame(spark, corpus(5)), frame(spark, corpus(6)[:20])
    one = result(resampling.draw(resampling.score(docs.repartition(1), target)))
    many = result(resampling.draw(resampling.score(docs.repartition(9), target)))
    assert one == many and sum(r[4] is not None for r in one) > 5


def test_empty_tables(spark):
    docs, none = frame(spark, corpus(1)), frame(spark, {})
    assert resampling.draw(resampling.score(none, docs)).count() == 0
    assert result(resampling.draw(resampling.score(docs, none))) == key(brute(corpus(1), [], 1, 10_000, 10, 20))


def test_words_as_the_pattern_has_them(spark):
    texts = ["".join(map(chr, range(0x300))), " a  B\tc", "", "É" * 10, "a\x00b", "x" * 100_000 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(resampling.words(F.col("text"))).collect()]
    assert got == [features(t, 1) for t in texts]


def test_keeps_columns_and_draws_towards_the_target(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 8) if i % 4 else " ".join(f"zebra{rng.randrange(30)}" for _ in range(60))) for i in range(400)]
    target = frame(spark, [(i, " ".join(f"zebra{rng.randrange(30)}" for _ in range(2000))) for i in range(40)])
    out = resampling.resample(frame(spark, rows), target, percent=10).collect()
    assert len(out) == 40 and {r["rank"] for r in out} == set(range(1, 41))
    assert sum(r["doc_id"] % 4 == 0 for r in out) >= 38
    assert all(r["text"] == rows[r["doc_id"]][1] and r["source"] == "s0" for r in out)


def test_only_counts_shuffle_when_scoring(spark):
    df = resampling.weigh(frame(spark, corpus(1)), [0] * 10_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and plan.count("split(translate") == 1
