"""Benchmark decontamination with an FM-index over each shard of training text.

A shard is a bounded run of documents inside one task. Its words are mapped to symbols: a word
of the benchmark keeps its own, every other word is the separator, as no test phrase can hold
it; stretches between separators that are shorter than the shortest phrase cannot hold one
either and are left out, an exact reduction. Over what remains the task builds a suffix array
(prefix doubling), its Burrows-Wheeler transform as a wavelet matrix with rank counters, and
sampled suffix positions. All phrases are searched backward together; their occurrences are
located by walking to the next sampled position, and overlapping spans are merged.

The benchmark is a stated query set: its distinct windows are broadcast as integer arrays in blocks of
a fixed number of words, one block at a time, each running over all documents, so its size is not
bounded by the memory of an executor or the driver.

Defined results: null and empty texts have no words and are clean; items without words have no
window; equal windows count for each item that has them; an item without an id is no item, but its windows hit; repeated rows are each reported; empty
tables give no rows or no hits; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD_MAP, fresh, materialize, maybe_broadcast, read, text_batches, text_bytes, tidied

WINDOW = 10
SHARD_BYTES = 8_000_000
BLOCK_WORDS = 1_000_000
SAMPLE = 16


# ---------------------------------------------------------------- the index


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order, by prefix doubling; ``s`` must end in a unique least symbol."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank of any symbol in a sequence in one step per bit of the alphabet."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = s.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the first ``at`` places, both arrays."""
        lo = np.zeros(len(at), dtype=np.int64)
        hi = at.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = ((symbol >> level) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit, zeros + lo1, lo - lo1)
            hi = np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        at = at.astype(np.int64)
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            one = ones[at]
            bit = ones[at + 1] - one
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + one, at - one)
        return out


class FMIndex:
    """Full-text index of a sequence of symbols in 1..sigma-1; symbol 0 separates."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE):
        # The terminator is the unique least symbol: separators become 1 and so on.
        text = np.concatenate([s.astype(np.int64) + 1, [0]])
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.tree = WaveletMatrix(bwt, sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        marked = sa % sample == 0
        self.marked = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, rows of ``phrases`` aligned to the right, searched backward."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        for step in range(width):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if len(live) == 0:
                break
            c = phrases[live, width - 1 - step] + 1
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.before[c] + both[: len(live)]
            hi[live] = self.before[c] + both[len(live) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        rows = rows.astype(np.int64).copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            open_ = open_[self.marked[r + 1] == self.marked[r]]
            if len(open_) == 0:
                break
            r = rows[open_]
            c = self.tree.access(r)
            rows[open_] = self.before[c] + self.tree.rank(c, r)
            steps[open_] += 1
        return self.samples[self.marked[rows]] + steps


# ---------------------------------------------------------------- phrases


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_MAP).split()


class Phrases:
    """The distinct windows of a block of benchmark items and the items that have each, as flat arrays; what is
    broadcast. The words' numbers are looked up in a dictionary that each Python worker makes once."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        known: dict[bytes, int] = {}
        names: dict[str, int] = {}
        rows, owner = [], []
        for item, text in items:
            ids = np.array([known.setdefault(w, len(known) + 1) for w in words_of((text or "").encode())], dtype=np.int32)
            if len(ids) == 0:
                continue
            own = -1 if item is None else names.setdefault(str(item), len(names))
            if len(ids) < window:
                part = np.zeros((1, window), dtype=np.int32)
                part[0, window - len(ids) :] = ids
            else:
                part = np.lib.stride_tricks.sliding_window_view(ids, window)
            rows.append(part)
            owner.append(np.full(len(part), own, dtype=np.int32))
        self.words = b" ".join(known)
        self.n_words = len(known)
        self.names = list(names)
        every = np.concatenate(rows) if rows else np.zeros((0, window), dtype=np.int32)
        self.rows, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, np.int64))
        self.lengths = (self.rows > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(self.rows) else window
        # Items of window i: holders[start[i] : start[i + 1]]; an item without an id is none.
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)]), axis=1) if rows else np.zeros((2, 0), np.int64)
        pairs = pairs[:, pairs[1] >= 0]
        self.holders = pairs[1].astype(np.int32)
        self.start = np.searchsorted(pairs[0], np.arange(len(self.rows) + 1))
        self._vocabulary: dict[bytes, int] | None = None

    @property
    def vocabulary(self) -> dict[bytes, int]:
        if self._vocabulary is None:
            self._vocabulary = {w: k for k, w in enumerate(self.words.split(b" "), 1)} if self.n_words else {}
        return self._vocabulary

    def items(self, p: int) -> list[str]:
        return [self.names[k] for k in self.holders[self.start[p] : self.start[p + 1]]]


def search_shard(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], set]]:
    """Per text: number of words, merged hit spans as word positions (end exclusive), items."""
    get = phrases.vocabulary.get
    zero = iter(int, 1)
    counts, parts = [], []
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        parts.append(np.fromiter(map(get, w, zero), dtype=np.int32, count=len(w)))
        parts.append(np.zeros(1, np.int32))
    s = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    base = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)])
    out: list = [(n, [], set()) for n in counts]
    inside = np.concatenate([[0], s > 0, [0]]).astype(np.int8)
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if len(starts) == 0 or len(phrases.lengths) == 0:
        return out
    # The kept stretches, each followed by one separator, and where they were.
    sizes = ends - starts + 1
    offsets = np.cumsum(sizes) - sizes
    origin = np.arange(sizes.sum()) - np.repeat(offsets, sizes) + np.repeat(starts, sizes)
    kept = s[origin]
    index = FMIndex(kept, phrases.n_words + 1)
    lo, hi = index.find(phrases.rows, phrases.lengths)
    hits = np.flatnonzero(hi > lo)
    n_hits = (hi - lo)[hits]
    which = np.repeat(hits, n_hits)
    rows = np.arange(n_hits.sum()) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits) + np.repeat(lo[hits], n_hits)
    place = origin[index.locate(rows)]
    order = np.argsort(place, kind="stable")
    docs = np.searchsorted(base, place, side="right") - 1
    for i in order:
        d, p = int(docs[i]), int(which[i])
        start = int(place[i] - base[d])
        end = start + int(phrases.lengths[p])
        _, spans, items = out[d]
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((start, end))
        items.update(phrases.items(p))
    return out


# ---------------------------------------------------------------- the operator


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of about ``block_words`` words, streamed to the driver: one block is held at a time."""
    block, held = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "") // 4 + 1
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


FOUND = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def find_phrases(docs: DataFrame, shared, shard_bytes: int = SHARD_BYTES, keep: list[str] = ()) -> DataFrame:
    """One row per document: its word count, merged hit spans in words, and items that occur; with
    ``keep`` the document's own columns as well. ``shared`` is the broadcast of a block's ``Phrases``."""
    import pyarrow as pa

    text_batches(docs.sparkSession)
    carry = [c for c in keep if c not in ("doc_id", "text")]
    src = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__in_text"), *(F.col(c).alias(f"__in_{c}") for c in carry)
    )
    passed = [1 + ("text" not in keep) + k for k in range(len(carry) + ("text" in keep))]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def shard(held: list, phrases: Phrases) -> Iterator:
        """One index over the texts of several batches."""
        found = iter(search_shard([t for _, texts in held for t in texts], phrases))
        for batch, texts in held:
            rows = [next(found) for _ in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in rows], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in f[1]] for f in rows], span_type),
                    pa.array([sorted(f[2]) for f in rows], pa.list_(pa.string())),
                    *(batch.column(k) for k in passed),
                ],
                ["doc_id", "n_words", "spans", "items", *(batch.schema.names[k] for k in passed)],
            )

    def run(batches) -> Iterator:
        phrases = shared.value
        held, size = [], 0
        for batch in batches:
            texts = text_bytes(batch.column(1))
            held.append((batch, texts))
            size += sum(map(len, texts))
            if size >= shard_bytes:
                yield from shard(held, phrases)
                held, size = [], 0
        yield from shard(held, phrases)

    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(FOUND)
    for f in (src.schema.fields[k] for k in passed):
        schema = schema.add(f)
    return src.mapInArrow(tidied(run), schema)


def _search_blocks(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Hits of every block of a benchmark of several, each written before the next is broadcast:
    ``doc_id, t, n_words, spans, items``, ``t`` being a hash of the text; documents without hits only from the
    first block."""
    sc, parts = docs.sparkSession.sparkContext, []
    src = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("t"))
    for i, block in enumerate(benchmark_blocks(benchmark)):
        shared = sc.broadcast(Phrases(block, window))
        found = find_phrases(src, shared, keep=["t"]).withColumnRenamed("__in_t", "t")
        parts.append(materialize(found if i == 0 else found.where(F.size("spans") > 0), "hits"))
        shared.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_block(benchmark: DataFrame) -> list | None:
    """The items, if they are a single block."""
    blocks = benchmark_blocks(benchmark)
    first = next(blocks, [])
    return first if next(blocks, None) is None else None


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, spans, items`` over all blocks of the benchmark. With a single block the
    documents are read once and nothing is shuffled."""
    block = _one_block(benchmark)
    if block is not None:
        return find_phrases(docs, docs.sparkSession.sparkContext.broadcast(Phrases(block, window)))
    # Several blocks: put together by document; rows that share an id are told apart by their text, and
    # equal rows were counted by the first block.
    rows = _search_blocks(docs, benchmark, window)
    whole = rows.groupBy("doc_id", "t", "n_words").agg(
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count(F.lit(1)).alias("n"),
    )
    copies = docs.groupBy(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("u")).agg(F.count(F.lit(1)).alias("copies"))
    whole = whole.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))
    return whole.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "n_words", _merge_spans("spans").alias("spans"), "items")


def _merge_spans(col: str):
    """Sorted spans with overlaps joined."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        overlaps = (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(col, empty, step)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without these spans of words (positions, end exclusive) and what is between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with the hit spans cut out of their texts; columns as given, ``n_chars`` (if there)
    counted anew. Documents without hits are untouched. All blocks search the text as given; their
    spans are merged and cut once."""
    import pyarrow as pa
    from pyspark.sql import types as T

    names, block = docs.columns, _one_block(benchmark)
    if block == []:
        return docs
    hits_, hit_, t_, d_ = fresh(docs, "__hits", "__hit", "__t", "__d")
    if block is not None:
        found = find_phrases(docs, docs.sparkSession.sparkContext.broadcast(Phrases(block, window)), keep=names)
        found = found.select(*(F.col("doc_id") if n == "doc_id" else F.col(f"__in_{n}").alias(n) for n in names), F.col("spans").alias(hits_))
    else:
        rows = _search_blocks(docs, benchmark, window).where(F.size("spans") > 0)
        rows = rows.groupBy(F.col("doc_id").alias(d_), F.col("t").alias(t_)).agg(F.flatten(F.collect_set("spans")).alias(hits_))
        rows = maybe_broadcast(materialize(rows, "spans"), BROADCAST_ROWS // 10)
        placed = docs.withColumn(hit_, F.xxhash64(F.col("text").cast("string")))
        found = placed.join(rows, F.col("doc_id").eqNullSafe(F.col(d_)) & (F.col(hit_) == F.col(t_)), "left").select(*names, hits_)

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cleaned = [cut_words(t, merge_spans([(s["start"], s["end"]) for s in sp])) if sp else t for t, sp in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cleaned, pa.string()), *(batch.column(2 + k) for k in range(batch.num_columns - 2))],
                ["text", *batch.schema.names[2:]],
            )

    others = [n for n in names if n != "text"]
    src = found.select("text", hits_, *others, (F.coalesce(F.size(hits_), F.lit(0)) > 0).alias(hit_))
    schema = T.StructType([f for f in src.schema.fields if f.name != hits_])
    out = src.mapInArrow(tidied(cut), schema)
    return out.select(
        *(F.when(F.col(hit_), F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if n == "n_chars" else F.col(n) for n in names)
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )



_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = f"regexp_extract_all({_AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, k, k + {WINDOW} - 1), ' ') AS phrase
      FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS phrase
      FROM (SELECT d.doc_id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM p) l ON len(d.w) >= l.n)),
h AS (SELECT s.doc_id, s.k, s.n, p.item_id FROM s JOIN p ON p.n = s.n AND p.phrase = s.phrase),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
