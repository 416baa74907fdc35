"""Language identification by a byte convolutional network.

Bytes (folded to a small alphabet) are embedded, convolved by filters of several widths, rectified,
max-pooled over a window and classified by a softmax layer. The network is trained in numpy with
Adam on windows of labelled documents and applied to every text whole, cut into windows of
``WINDOW`` bytes, the last one padded; a document's log chances are its windows' mean, weighted by
their bytes. At inference a convolution of one-byte embeddings is a sum of table rows, looked up
by pairs of bytes.

Only documents whose crc32 of the id (as text) is not 2 modulo 4 and whose language is not null are
learned from; prediction sees nothing but the text. Training uses at most ``PER_LANGUAGE``
documents of each language, chosen by a hash of the id, and of each of them ``CROPS`` crops of
``WINDOW`` bytes, evenly spread from its head to its tail.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there is nothing
to learn from; a null id is not held out and not learned from; repeated rows are each scored; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, read, text_batches, text_bytes, tidied

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
PER_LANGUAGE = 500
CROPS = 3
STEPS = 700
BATCH = 64
SEED = 11

_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character of ``text`` is a letter; numbers written as signs (², ½, ①) are none."""
    return _LATIN.search(text) is not None or not text.isascii() and any(map(str.isalpha, text))


def _alphabet() -> np.ndarray:
    """Class of each byte: 0 pads; letters folded; white space; digits; other ASCII; all further bytes one
    by one, as the lead byte of a character tells its script."""
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if 65 <= b <= 90 or 97 <= b <= 122:
            out[b] = (b | 32) - 96
        elif b in b" \t\n\r\x0b\x0c":
            out[b] = 27
        elif 48 <= b <= 57:
            out[b] = 28
        elif b < 128:
            out[b] = 29
        else:
            out[b] = b - 98
    return out


CLASS = _alphabet()
N_CLASS = 158


@dataclass
class Net:
    languages: list[str]
    embed: np.ndarray  # (N_CLASS, EMBEDDING); the padding row stays zero
    conv: list[np.ndarray]  # per width (width * EMBEDDING, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.conv, *self.bias, self.out, self.out_bias]


def windows_of(text: bytes, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(classes of shape (n, width), bytes in each window) tiling the whole text."""
    c = CLASS[np.frombuffer(text, dtype=np.uint8)]
    n = max(1, -(-len(c) // width))
    out = np.zeros(n * width, dtype=np.uint8)
    out[: len(c)] = c
    sizes = np.full(n, width)
    sizes[-1] = len(c) - width * (n - 1)
    return out.reshape(n, width), sizes


def _forward(net: Net, x: np.ndarray):
    e = net.embed[x]
    pooled, where, patches = [], [], []
    for k, width in enumerate(WIDTHS):
        n = x.shape[1] - width + 1
        patch = np.concatenate([e[:, j : j + n] for j in range(width)], axis=2)
        h = patch @ net.conv[k] + net.bias[k]
        at = h.argmax(axis=1)
        pooled.append(np.take_along_axis(h, at[:, None, :], axis=1)[:, 0])
        where.append(at)
        patches.append(patch)
    z = np.concatenate(pooled, axis=1)
    a = np.maximum(z, 0)
    logits = a @ net.out + net.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(axis=1, keepdims=True), a, z, where, patches


def _gradients(net: Net, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    p, a, z, where, patches = _forward(net, x)
    b = len(x)
    d = p
    d[np.arange(b), y] -= 1
    d /= b
    g_out, g_out_bias = a.T @ d, d.sum(axis=0)
    dz = (d @ net.out.T) * (z > 0)
    g_embed = np.zeros_like(net.embed)
    g_conv, g_bias = [], []
    for k, width in enumerate(WIDTHS):
        dk = dz[:, k * FILTERS : (k + 1) * FILTERS]
        at = where[k]
        # Only the winning position of each filter has a gradient.
        picked = np.take_along_axis(patches[k], at[:, :, None], axis=1)  # (b, FILTERS, width * EMBEDDING)
        g_conv.append(np.einsum("bf,bfe->ef", dk, picked))
        g_bias.append(dk.sum(axis=0))
        for j in range(width):
            part = net.conv[k][j * EMBEDDING : (j + 1) * EMBEDDING]  # (EMBEDDING, FILTERS)
            symbols = np.take_along_axis(x, at + j, axis=1)
            np.add.at(g_embed, symbols.ravel(), (dk[:, :, None] * part.T[None]).reshape(-1, EMBEDDING))
    g_embed[0] = 0
    return [g_embed, *g_conv, *g_bias, g_out, g_out_bias]


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = SEED) -> Net | None:
    """Fit on random windows of random lengths, languages drawn alike."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    by = [[CLASS[np.frombuffer(t, dtype=np.uint8)] for t, lab in zip(texts, labels) if lab == lang and t] for lang in languages]
    usable = [i for i, docs in enumerate(by) if docs]
    n = len(languages)
    net = Net(
        languages,
        rng.normal(0, 0.3, (N_CLASS, EMBEDDING)).astype(np.float32),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n)).astype(np.float32),
        np.zeros(n, dtype=np.float32),
    )
    net.embed[0] = 0
    if len(usable) < 2:
        return net
    params = net.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        size = int(rng.choice([32, 64, 128, 256]))
        x = np.zeros((BATCH, size), dtype=np.uint8)
        y = rng.choice(usable, BATCH)
        for i, lang in enumerate(y):
            doc = by[lang][rng.integers(len(by[lang]))]
            start = rng.integers(max(1, len(doc) - size + 1))
            part = doc[start : start + size]
            x[i, : len(part)] = part
        for i, g in enumerate(_gradients(net, x, y)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            rate = 0.01 * (1 if t < steps * 0.6 else 0.2)
            params[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


class Tables:
    """The convolutions as sums of table rows by single bytes and by pairs."""

    def __init__(self, net: Net):
        self.net = net
        single = []
        for k, width in enumerate(WIDTHS):
            parts = [net.embed @ net.conv[k][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(width)]
            parts[0] = parts[0] + net.bias[k]
            single.append([p.astype(np.float32) for p in parts])
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        self.steps: list[list[tuple[int, bool, np.ndarray]]] = []
        for parts in single:
            row = []
            for j in range(0, len(parts) - 1, 2):
                row.append((j, True, np.ascontiguousarray(pair(parts[j], parts[j + 1]))))
            if len(parts) % 2:
                row.append((len(parts) - 1, False, parts[-1]))
            self.steps.append(row)

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) * N_CLASS + x[:, 1:]
        pooled = []
        for width, row in zip(WIDTHS, self.steps):
            n = x.shape[1] - width + 1
            h = None
            for j, paired, table in row:
                part = np.take(table, pairs[:, j : j + n] if paired else x[:, j : j + n], axis=0)
                h = part if h is None else np.add(h, part, out=h)
            pooled.append(h.max(axis=1))
        a = np.maximum(np.concatenate(pooled, axis=1), 0)
        logits = a @ self.net.out + self.net.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def classify(texts: list[bytes], tables: Tables, chunk: int = 48) -> np.ndarray:
    """Mean log chances of each text, one row each."""
    parts, sizes, owner = [], [], []
    total = np.zeros((len(texts), len(tables.net.languages)))
    weight = np.zeros(len(texts))

    def flush() -> None:
        x = np.concatenate(parts)
        s, o = np.concatenate(sizes).astype(np.float64), np.concatenate(owner)
        for lo in range(0, len(x), chunk):
            lp = tables.log_chances(x[lo : lo + chunk])
            np.add.at(total, o[lo : lo + chunk], lp * s[lo : lo + chunk, None])
        np.add.at(weight, o, s)
        parts.clear(), sizes.clear(), owner.clear()

    held = 0
    for i, t in enumerate(texts):
        x, s = windows_of(t)
        parts.append(x)
        sizes.append(s)
        owner.append(np.full(len(x), i))
        held += len(x)
        if held >= 2000:
            flush()
            held = 0
    if parts:
        flush()
    return total / np.maximum(weight, 1)[:, None]


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``text, lang`` of the documents learned from; at most ``per_language`` of a language."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = docs.where("doc_id is not null and lang is not null and text is not null").where(fold != 2)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    counts = materialize(rows.groupBy("lang").count(), "languages")
    # A thinned candidate set of about twice the bound for each language, then exactly the bound.
    share = F.least(F.lit(1.0), 2.0 * per_language / F.col("count"))
    draw = (F.xxhash64("doc_id") / F.lit(2.0**64)) + F.lit(0.5)
    few = rows.join(maybe_broadcast(counts), "lang").withColumn("draw", draw).where(F.col("draw") <= share)
    order = W.partitionBy("lang").orderBy("draw", "doc_id")
    return few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("text", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Net | None:
    # Windows spread over each text are what training draws from.
    def crops(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out, lang = [], []
            for t, lab in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                starts = {max(0, len(t) - WINDOW) * k // (CROPS - 1) for k in range(CROPS)}
                for s in sorted(starts):
                    out.append(t[s : s + WINDOW])
                    lang.append(lab)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(lang, pa.string())], ["t", "lang"])

    rows = training_rows(docs, per_language).mapInArrow(tidied(crops), "t binary, lang string").toPandas()
    rows = rows.sort_values(["lang", "t"])
    return train([bytes(t) for t in rows["t"]], rows["lang"].tolist())


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    text_batches(docs.sparkSession)
    def run(batches) -> Iterator:
        import pyarrow as pa

        net = shared.value
        tables = Tables(net) if net else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(2).to_pylist()
                ok = [k for k, t in enumerate(texts) if net and t and has_letter(t)]
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                if ok:
                    p = np.exp(classify([texts[k].encode() for k in ok], tables))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    for k, b, row in zip(ok, best, p):
                        lang[k], score[k] = net.languages[b], min(1.0, float(row[b]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"]
                )

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
