"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

Grades run from 0 (not toxic) to ``GRADES - 1``; the chance of a grade of at most k is
sigmoid(theta_k - w.x), one weight vector for all thresholds, thetas in order. Labels only say
toxic or not, so the grade of a toxic training document comes from the number of distinct words
with a feature typical of toxic text, split at the terciles of the toxic training documents.
Features are log counts of the words, and of the beginnings of words, whose document frequency
is most typical of toxic training documents; beginnings carry over to inflected forms never seen.

Fitting uses at most ``FIT_ROWS`` labelled documents of those given, chosen by a hash of their id, and at most
``VOCABULARY`` words; word counts are combined on the executors and only selected words reach
the driver. Scoring reads every whole text.

Defined results: null and empty texts have no features and get the severity of the intercept;
rows labelled null or not joined to a document are not learned from; without a typical feature no
document is toxic; without labelled rows of both kinds every severity is 0; repeated rows are each scored; an empty table gives no rows;
other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_MAP, WordHashes, fresh, materialize, mix64, read, text_batches, text_bytes, tidied, with_fields

FIT_ROWS = 20_000
VOCABULARY = 4_096
MIN_G = 4.2  # about one chance in 40 thousand that a feature without meaning is selected
GRADES = 4
PREFIXES = (4, 5, 6)  # characters of a word that are features of their own, if it is longer
L2 = 1e-3


@dataclass
class Model:
    words: dict[bytes, int]
    weights: np.ndarray
    thetas: np.ndarray
    cut: float = 0.5  # chance of a grade of 1 or more from which a text is toxic

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """Chances of grades of at least 1, 2, ...; one row per score."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thetas[None, :] - score[:, None], -500, 500)))


def features_of(word: bytes) -> list[bytes]:
    """The word, marked, and its beginnings."""
    text = word.decode("utf-8", "replace")
    return [word + b" ", *(text[:k].encode() for k in PREFIXES if len(text) > k)]


class WordFeatures(dict):
    """Memo of the indexes of each word's selected features, None without any; emptied when full."""

    def __init__(self, vocabulary: dict[bytes, int], most: int = 100_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        found = tuple(self.vocabulary[f] for f in features_of(word) if f in self.vocabulary) or None
        self[word] = found
        return found


def document_features(text: bytes, memo: WordFeatures) -> tuple[list[int], list[float], set[bytes]]:
    """Sorted feature indexes, their log counts, and the words that have any."""
    words = text.translate(WORD_MAP).split()
    hits: Counter = Counter()
    having = set()
    for w, found in zip(words, map(memo.__getitem__, words)):
        if found:
            hits.update(found)
            having.add(w)
    index = sorted(hits)
    return index, [1.0 + float(np.log(hits[i])) for i in index], having


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_features: int, n_grades: int, l2: float = L2, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the full sample. Each row is (indexes, values).
    Thresholds are kept in order by construction: the first is free, the gaps are exponentials."""
    n = len(rows)
    lens = np.array([len(r[0]) for r in rows])
    owner = np.repeat(np.arange(n), lens)
    cols = np.concatenate([r[0] for r in rows]) if n else np.zeros(0, np.int64)
    vals = np.concatenate([r[1] for r in rows]) if n else np.zeros(0)
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)])
    start = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    start = np.maximum.accumulate(start + 1e-3 * np.arange(len(start)))
    p = np.concatenate([np.zeros(n_features), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rate = 0.1
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        theta = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(owner, weights=vals * w[cols], minlength=n)
        cum = 1.0 / (1.0 + np.exp(np.clip(eta[:, None] - theta[None, :], -500, 500)))  # P(y <= k)
        full = np.concatenate([np.zeros((n, 1)), cum, np.ones((n, 1))], axis=1)
        i = np.arange(n)
        prob = np.maximum(full[i, grades + 1] - full[i, grades], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), cum * (1 - cum), np.zeros((n, 1))], axis=1)
        hi, lo = slope[i, grades + 1] / prob, slope[i, grades] / prob
        g_eta = (hi - lo) / n
        g_theta = np.zeros(n_grades - 1)
        np.add.at(g_theta, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -hi, 0) / n)
        np.add.at(g_theta, np.maximum(grades - 1, 0), np.where(grades > 0, lo, 0) / n)
        g_w = np.bincount(cols, weights=vals * g_eta[owner], minlength=n_features) + l2 * w / max(1, n) ** 0.5
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        if t == steps * 3 // 4:
            rate /= 5
    theta = p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])
    return p[:n_features], theta


def sketch(batches) -> Iterator:
    """Add the least hash of each text's word 5-grams, which near copies mostly share."""
    import pyarrow as pa

    memo = WordHashes()
    for batch in batches:
        least = []
        for t in text_bytes(batch.column(0)):
            words = t.translate(WORD_MAP).split()
            h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
            n = max(1, len(h) - 4) if len(h) else 0
            acc = np.zeros(n, dtype=np.uint64)
            for j in range(min(5, len(h))):
                acc = mix64(acc + h[j : j + n])
            least.append(int(acc.min().view(np.int64)) if n else 0)
        yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), *batch.columns], ["sketch", "text", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, vocabulary: int = VOCABULARY) -> Model | None:
    """The model, or None without labelled documents of both kinds."""
    import pyarrow as pa

    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Labels of other documents don't use up the bound.
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    known = materialize(known, "known")
    # Thinned on the executors to little more than the bound, then exactly the bound.
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    total = known.count()
    few = known.where(draw < int((1 << 40) * (1.2 * fit_rows + 200) / total)) if total > 2 * fit_rows else known
    chosen = materialize(few.orderBy(draw, "doc_id").limit(fit_rows), "labelled")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most fit_rows ids: a fixed bound.
    joined = text.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    # Copies of one text would make its every word typical: of documents with the same sketch one stays.
    train = materialize(
        joined.mapInArrow(tidied(sketch), "sketch long, text string, toxic int").groupBy("sketch").agg(F.max(F.struct("toxic", "text")).alias("d")).select("d.text", "d.toxic"),
        "train",
    )

    def count(batches) -> Iterator:
        total: dict[bytes, list[int]] = {}
        for batch in batches:
            for t, toxic in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                for w in {f for w in set(t.translate(WORD_MAP).split()) for f in features_of(w)}:
                    total.setdefault(w, [0, 0])[1 if toxic else 0] += 1
                if len(total) > 200_000:
                    yield from flush(total)
        yield from flush(total)

    def flush(total) -> Iterator:
        items = list(total.items())
        total.clear()
        for lo in range(0, len(items), 50_000):
            part = items[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in part], pa.binary()), *(pa.array([c[k] for _, c in part], pa.int64()) for k in (0, 1))], ["w", "clean", "toxic"]
            )

    size = {bool(r[0]): r[1] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        return None
    words = train.mapInArrow(tidied(count), "w binary, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # Root of the log-likelihood ratio of the feature's toxic documents against the base rate: unlike
    # a z score it stays honest for features of few documents.
    base = n1 / (n0 + n1)
    n, t = F.col("c") + F.col("t"), F.col("t")
    rate = t / n
    g = F.sqrt(2 * (t * F.log(rate / F.lit(base)) + F.when(rate < 1, (n - t) * F.log((1 - rate) / F.lit(1 - base))).otherwise(0.0)))
    top = (
        words.where((t > 0) & (rate > base)).withColumn("g", g).where(F.col("g") >= MIN_G)
        .orderBy(F.desc("g"), "w").limit(vocabulary).collect()
    )
    vocab = {bytes(r["w"]): i for i, r in enumerate(top)}
    if not vocab:
        # Nothing tells toxic documents from others: the base rate for all, and none is toxic.
        return Model({}, np.zeros(0), np.array([np.log(n0 / n1) + k for k in range(GRADES - 1)]), cut=2.0)
    shared = spark.sparkContext.broadcast(vocab)

    def features(batches) -> Iterator:
        memo = WordFeatures(shared.value)
        for batch in batches:
            idx, val, hits = [], [], []
            for t in text_bytes(batch.column(0)):
                i, v, having = document_features(t, memo)
                idx.append(i)
                val.append(v)
                hits.append(len(having))
            yield pa.RecordBatch.from_arrays(
                [pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64())), pa.array(hits, pa.int32()), batch.column(1)], ["i", "v", "hits", "toxic"]
            )

    found = train.mapInArrow(tidied(features), "i array<int>, v array<double>, hits int, toxic int").toPandas()
    rows = [(np.asarray(i, np.int64), np.asarray(v, float)) for i, v in zip(found["i"], found["v"])]
    hits, toxic = found["hits"].to_numpy(), found["toxic"].to_numpy() > 0
    edges = np.quantile(hits[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(toxic, 1 + np.searchsorted(edges, hits, side="left"), 0).astype(np.int64)
    w, theta = fit_ordinal(rows, grades, len(vocab), GRADES)
    model = Model(vocab, w, theta)
    chance = model.at_least(np.array([float(np.dot(w[i], v)) for i, v in rows]))[:, 0]
    model.cut = best_cut(chance, toxic)
    return model


def best_cut(chance: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of greatest F1 on the training documents, half way to the next lower chance."""
    order = np.argsort(-chance, kind="stable")
    c, t = chance[order], toxic[order].astype(np.int64)
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(c) + 1) + t.sum())
    f1[np.flatnonzero(c[1:] == c[:-1])] = -1  # equal chances stay together
    k = int(f1.argmax())
    return float((c[k] + (c[k + 1] if k + 1 < len(c) else 0.0)) / 2)


SCORES = ("severity", "grade", "toxic_chance", "toxic")


def score(docs: DataFrame, model: Model | None, names: tuple[str, ...] = SCORES) -> DataFrame:
    """``docs`` with four more columns, ``names``: severity (expected grade), the likeliest grade, the chance of a
    grade of 1 or more, and whether that reaches the model's cut. Like-named columns are replaced."""
    import pyarrow as pa

    docs = docs.drop(*names)
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator:
        model = shared.value
        memo = WordFeatures(model.words if model else {})
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for k, t in enumerate(text_bytes(batch.column(at))):
                if model:
                    index, values, _ = document_features(t, memo)
                    s[k] = float(np.dot(model.weights[index], values)) if index else 0.0
            if model:
                tail = model.at_least(s)
            else:
                tail = np.zeros((batch.num_rows, GRADES - 1))
            each = -np.diff(np.concatenate([np.ones((len(s), 1)), tail, np.zeros((len(s), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tail.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(tail[:, 0].copy()), pa.array(tail[:, 0] >= (model.cut if model else 2))],
                [*batch.schema.names, *names],
            )

    return docs.mapInArrow(tidied(run), with_fields(docs, ", ".join(map(" ".join, zip(names, ("double", "int", "double", "boolean"))))))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not toxic; columns as given."""
    model, names = fit(docs, labels), tuple(fresh(docs, *SCORES))
    return score(docs, model, names).where(~F.col(names[-1])).select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.round("severity", 9).alias("severity"), "grade", F.round("toxic_chance", 9).alias("toxic_chance"), "toxic")
