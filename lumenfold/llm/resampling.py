"""Importance resampling towards a target distribution, over hashed word features.

A document's features are all runs of 1 to ``ORDER`` consecutive words, counted as often as they occur. Each
feature falls into one of ``BUCKETS`` buckets; a bucket's gain is the log ratio of its smoothed share in the
target texts to that in the corpus. Two passes over the texts:

* counting: the buckets of all documents are counted, combined in every task before the shuffle, so that no
  more than ``BUCKETS`` rows leave a task, whatever the words' frequencies;
* scoring, which neither explodes nor shuffles: higher-order functions make a document's bucket array, and an
  aggregate over it looks each entry up in a literal array of ``BUCKETS`` gains.

A document's weight is the mean gain of its features. Adding Gumbel noise, taken from a hash of its id, and
keeping the highest scores draws without replacement with chances proportional to exp(weight). Scores are whole
thousandths, and gains and noise are bounded, so the histogram of scores has some 100,000 rows at most; it
gives the least drawn score. Only documents from there on are sorted, by range over all tasks, and numbered by
the tasks' row counts.

Defined results: a null text has no features; a document without features has weight 0; a null id is hashed
as the empty text and comes last among equal scores; rows that share an id share its noise and are drawn one
by one, those with fewer features first, then by weight (rows alike in all of these are interchangeable); an
empty target has gains from smoothing alone; an empty table gives no rows; extra columns are ignored, or
carried along when named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, read

BUCKETS = 10_000
ORDER = 1  # longest run of words that is a feature
LEAST_WORDS = 20  # documents with fewer are not drawn from
PERCENT = 10
SEED = 2024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS = "".join(chr(b) for b in range(128) if not chr(b).isalnum())  # what WORD leaves out, once A-Z are folded


def words(text: Column) -> Column:
    """Words of a text with A-Z folded, as ``WORD`` matches them; none if it is null. Every gap becomes a space
    and the text is split at spaces, many times faster than the pattern."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.array_remove(F.split(spaced, " "), "")


def bucket_array(text: Column, order: int = ORDER, buckets: int = BUCKETS) -> Column:
    """Bucket of every feature of a text: CRC-32 of its bytes modulo ``buckets``."""
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")
    if order == 1:
        return F.transform(words(text), bucket)

    def runs(all_words: Column, k: int) -> Column:
        starts = F.when(F.size(all_words) >= k, F.sequence(F.lit(1), F.size(all_words) - (k - 1)))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda at: bucket(F.array_join(F.slice(all_words, at, k), " ")))

    # The word array is bound once, as the single entry of an array, so that the pattern runs once a text.
    held = F.transform(F.array(words(text)), lambda w: F.concat(*(runs(w, k) for k in range(1, order + 1))))
    return held[0]


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all texts in each bucket that has any: at most ``buckets`` entries."""
    rows = docs.select(F.explode(bucket_array(F.col("text"), order, buckets)).alias("b")).groupBy("b").count()
    return {r["b"]: r["count"] for r in rows.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of target to corpus share, one added to every bucket."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log(float(target.get(b, 0) + 1) * s_all / (float(corpus.get(b, 0) + 1) * t_all)))
        for b in range(buckets)
    ]


def weigh(docs: DataFrame, gain: Sequence[int], order: int = ORDER, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_features, weight`` and the columns in ``keep``: one projection, no shuffle."""
    # A text of numbers that is split and cast is folded to one literal array when the plan is optimised.
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    bound, total = fresh(docs, "__buckets", "__total")
    held = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), bucket_array(F.col("text"), order, len(gain)).alias(bound))
    summed = held.select(
        *keep, "doc_id", F.size(bound).cast("long").alias("n_features"),
        F.aggregate(bound, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1)).alias(total),
    )
    n, t = F.col("n_features"), F.col(total)
    # Whole-number division that rounds down: the remainder goes first.
    return summed.select(*keep, "doc_id", "n_features", F.when(n == 0, F.lit(0).cast("long")).otherwise(((t - F.pmod(t, F.greatest(n, F.lit(1)))) / F.greatest(n, F.lit(1))).cast("long")).alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_features, weight, score`` of every document."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets), buckets)
    return weigh(docs, gain, order, keep).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (as ``score`` gives it) with ``rank``: 1, 2, 3 ... by falling score and rising id for the drawn
    ``percent`` of the documents with at least ``least`` features; null for all others."""
    spark = scored.sparkSession
    scored = materialize(scored, "scored")
    counts = sorted(((r["score"], r["count"]) for r in scored.where(F.col("n_features") >= least).groupBy("score").count().collect()), reverse=True)
    drawn = sum(c for _, c in counts) * percent // 100
    floor, above = None, 0
    for value, count in counts:
        if above >= drawn:
            break
        floor, above = value, above + count
    nothing = F.lit(None).cast("long")
    if floor is None:
        return scored.withColumn("rank", nothing)
    near = (F.col("n_features") >= least) & (F.col("score") >= floor)
    mix, at, part, before = fresh(scored, "__mix", "__at", "__part", "__before")
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col(mix)]
    # Each row has a number of its own as the last key, so that rows alike spread over tasks too.
    top = scored.where(near).withColumn(mix, F.xxhash64(F.monotonically_increasing_id()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    top = top.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(mix).withColumn(at, F.monotonically_increasing_id())
    # Written: the numbers stay as they are whatever is run again. A number is the task's times 2^33, plus the row's.
    top = materialize(top, "ranked").withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    held, base = 0, []
    for r in sorted(top.groupBy(part).count().collect()):
        base.append((r[0], held))
        held += r[1]
    # One row a task.
    offsets = F.broadcast(spark.createDataFrame(base, f"{part} long, {before} long"))
    place = F.col(before) + F.col(at) + 1
    ranked = top.join(offsets, part).withColumn("rank", F.when(place <= drawn, place)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~near).withColumn("rank", nothing))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, order: int = ORDER, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn documents, with all columns of ``docs`` but those named as the results are."""
    own = {"doc_id", "n_features", "weight", "score", "rank"}
    kept = [c for c in docs.columns if c.lower() not in own]
    return draw(score(docs, target, order, seed=seed, keep=kept), percent, least).where("rank is not null")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


_FOLD = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_LIST = f"regexp_extract_all({_FOLD}, '{WORD}')"
OP11_SQL = f"""
WITH t AS MATERIALIZED (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k::UBIGINT, [0::UBIGINT for i in range(8)]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS k))),
d AS MATERIALIZED (SELECT doc_id, {_LIST} AS w FROM documents),
b AS MATERIALIZED (SELECT unnest({_LIST}) AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS w FROM d),
distinct_words AS MATERIALIZED (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM b)),
bytes AS (SELECT w, list_transform(range(length(x) // 2), lambda i:
    ((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::UBIGINT) AS y FROM distinct_words),
h AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, y),
    lambda c, z: xor(c >> 8, t[(xor(c, z) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % {BUCKETS} AS k FROM bytes, t),
s AS MATERIALIZED (SELECT k, count(*) AS n FROM f JOIN h USING (w) GROUP BY k),
g AS MATERIALIZED (SELECT k, count(*) AS n FROM b JOIN h USING (w) GROUP BY k),
gain AS MATERIALIZED (SELECT k, CAST(floor(1000 * ln((coalesce(g.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM g) + {BUCKETS})::DOUBLE))) AS BIGINT) AS v
    FROM s FULL JOIN g USING (k)),
m AS (SELECT doc_id, count(*) AS n, sum(v) AS v FROM f JOIN h USING (w) JOIN gain USING (k) GROUP BY doc_id),
e AS (SELECT d.doc_id, len(d.w) AS n_features, CAST(CASE WHEN m.n IS NULL THEN 0 ELSE (m.v - ((m.v % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS weight,
    list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda i: strpos('0123456789abcdef', sha256(concat('{SEED}:', d.doc_id))[i + 1])::BIGINT - 1)),
      lambda c, z: c * 16 + z) AS h FROM d LEFT JOIN m USING (doc_id)),
c AS MATERIALIZED (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= {LEAST_WORDS})
SELECT c.doc_id, CAST(c.n_features AS BIGINT) AS n_features, c.weight, c.score, CASE WHEN r.rank <= r.n * {PERCENT} // 100 THEN r.rank END AS rank
FROM c LEFT JOIN r USING (doc_id)
"""
