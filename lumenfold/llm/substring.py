"""Substring deduplication by sliding sentence spans.

Every run of consecutive sentences that has at least ``RUN`` sentences and ``MIN_WORDS`` words is
hashed: the shortest such run from each sentence on, and the shortest up to each sentence. The
runs are joined globally by hash; of a run that occurs more than once, the occurrence with the
least (id, hash of the text, position) stays and every sentence that any other occurrence covers goes. A
sentence of more than ``UNIT_WORDS`` words counts as several, cut after words that their own hash
chooses: a repeated passage thus needs no sentence ends inside it, and the cuts of two copies
agree again soon after words that only one of them has.

Counting combines before the shuffle, so a passage that a third of all documents share costs one
row per task; only runs known to repeat are joined back.

Defined results: null text stays null and is untouched, as are texts shorter than a run; a document is
an id with a text, so rows that share both are treated alike, and texts that share an id are documents of
their own; a null id comes before all others; an empty table gives no rows; extra columns are ignored. Texts of
one id are told apart by hashes of 128 bits, runs by 96. A repeated passage of fewer than ``MIN_WORDS`` words, or ``RUN`` sentences, stays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WordHashes, materialize, maybe_broadcast, mix64, read, text_batches, tidied

RUN = 3
MIN_WORDS = 16
UNIT_WORDS = 12
LEAST = 4  # words of a unit before a cut

_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|\n+|[.!?]+|$)")
_WORDS = re.compile(r"\S+")


def sentence_units(text: str, unit_words: int = UNIT_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, words) of the units that tile ``text``: sentences end at a line break or at
    ``.!?`` before white space; longer ones are cut by ``_cuts``. Blank stretches belong to the unit
    before them."""
    units: list[list[int]] = []
    at, n = 0, len(text)
    start = 0
    while at < n:
        end = _SENTENCE.match(text, at).end()
        if end == at:
            end = at + 1
        stop = text[end - 1]
        if end < n and stop in ".!?" and not text[end].isspace():
            at = end  # a full stop inside a word or number
            continue
        piece = text[start:end]
        words = piece.split()
        if not words:
            if units:
                units[-1][1] = end
        elif len(words) <= unit_words:
            units.append([start, end, len(words)])
        else:
            places = [m.start() for m in _WORDS.finditer(piece)]
            edges = [0, *_cuts(words, unit_words), len(words)]
            for a, b in zip(edges, edges[1:]):
                left = start if a == 0 else start + places[a]
                right = end if b == len(words) else start + places[b]
                units.append([left, right, b - a])
        start = at = end
    if units:
        units[0][0] = 0
        units[-1][1] = n
    return [tuple(u) for u in units]


def _cuts(words: list[str], unit_words: int) -> list[int]:
    """Word indexes at which a long sentence is cut: after a word whose hash is divisible by 4, once
    ``LEAST`` words are in the unit, and after ``unit_words`` words in any case."""
    cuts, held = [], 0
    for k, w in enumerate(words[:-1]):
        held += 1
        if held >= LEAST and zlib.crc32(w.encode()) % 4 == 0 or held == unit_words:
            cuts.append(k + 1)
            held = 0
    return cuts


def runs(words: np.ndarray, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the shortest run from each unit on and of the shortest up to each unit."""
    n = len(words)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(words)])
    i = np.arange(n)
    last = np.maximum(np.searchsorted(total, total[i] + min_words, side="left") - 1, i + run - 1)
    fwd = last < n
    # The latest first unit from which enough words end here.
    first = np.minimum(np.searchsorted(total, total[i + 1] - min_words, side="right") - 1, i - run + 1)
    back = first >= 0
    pairs = np.unique(np.concatenate([i[fwd] * n + last[fwd], first[back] * n + i[back]]))
    return pairs // n, pairs % n


_P = np.uint64(0x9E3779B97F4A7C15)


_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class UnitHashes(WordHashes):
    """Memo of 128-bit hashes of units, as bytes."""

    def __missing__(self, unit: bytes) -> bytes:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[unit] = h = xxhash.xxh3_128_digest(unit)
        return h


def run_hashes(units: list[bytes], first: np.ndarray, last: np.ndarray, memo: UnitHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 64 and of 32 bits of each run of units, each made from its own half of the hashes of their
    white-space-normalised texts: runs agree in both by chance once in 2^96 pairs."""
    h = np.frombuffer(b"".join(map(memo.__getitem__, units)), dtype="<u8").reshape(-1, 2)
    own, other = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
    out, more = (last - first + 1).astype(np.uint64), np.zeros(len(first), np.uint64)
    step = 0
    live = np.arange(len(first))
    while len(live):
        at = first[live] + step
        out[live] = mix64((out[live] ^ own[at]) * _P + np.uint64(step))
        more[live] = (more[live] + other[at]) * _Q
        step += 1
        live = live[first[live] + step <= last[live]]
    return out.view(np.int64), (more >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _normal(piece: str) -> bytes:
    return " ".join(piece.split()).encode()


def _shared_ids(docs: DataFrame) -> DataFrame:
    """Ids that several rows have."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    return materialize(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared")


def _documents(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``doc_id, t, u`` and ``text``: the first three tell documents apart. ``t`` and ``u`` are two words of hash of the
    text, and 0 where the id is one row's alone, so that they take no room in what is shuffled."""
    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    alone = F.col("doc_id").isNotNull()
    if not shared.isEmpty():
        src = src.join(maybe_broadcast(shared.select(F.col("doc_id").alias("__shared"))), F.col("doc_id") == F.col("__shared"), "left")
        alone &= F.col("__shared").isNull()
    # The second word has another seed, the hash of the number before the text.
    words = (F.when(alone, 0).otherwise(w).cast("long") for w in (F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))
    return src.select("doc_id", *(w.alias(c) for w, c in zip(words, "tu")), "text")


def span_table(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``h, g`` (hash of 96 bits), ``doc_id, t, u, first, last``: every run of every of the ``_documents``."""

    text_batches(docs.sparkSession)
    def go(batches) -> Iterator:
        import pyarrow as pa

        memo = UnitHashes()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            held: list[list[np.ndarray]] = []
            count = 0

            def flush():
                h, g, rows, fs, ls = (pa.array(np.concatenate(c)) for c in zip(*held))  # noqa: B023
                return pa.RecordBatch.from_arrays([h, g, *(batch.column(i).take(rows) for i in range(3)), fs, ls], ["h", "g", "doc_id", "t", "u", "first", "last"])  # noqa: B023

            for row, text in enumerate(texts):
                if not text:
                    continue
                units = sentence_units(text)
                first, last = runs(np.array([u[2] for u in units], dtype=np.int64), run, min_words)
                if len(first) == 0:
                    continue
                h, g = run_hashes([_normal(text[a:b]) for a, b, _ in units], first, last, memo)
                held.append([h, g, np.full(len(h), row), first.astype(np.int32), last.astype(np.int32)])
                count += len(h)
                if count > 200_000:
                    yield flush()
                    held, count = [], 0
            if count:
                yield flush()

    return docs.mapInArrow(tidied(go), "h long, g int, doc_id long, t long, u long, first int, last int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, t, u, spans`` of ``_documents``: merged unit spans (end exclusive) that non-first occurrences cover."""
    spans = materialize(span_table(docs), "spans")
    # Every run is shuffled twice: most of its hash to count it, then all of it to those that repeat. Written, so
    # that the join shuffles both sides itself and adaptive execution can split a hot run; the same holds for the
    # second join. All of it counts from here on.
    again = materialize(spans.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "again")
    places = materialize(spans.join(again, "h"), "places")
    firsts = places.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "t", "u", "first")).alias("best")).where("n > 1")
    firsts = materialize(firsts.select("h", "g", *(F.col(f"best.{c}").alias(f"__{c}") for c in ("doc_id", "t", "u", "first"))), "firsts")
    covered = places.join(firsts, ["h", "g"]).where("not (doc_id <=> __doc_id and t = __t and u = __u and first = __first)").select("doc_id", "t", "u", "first", "last")
    # Bounded by the document's own number of units.
    grouped = covered.groupBy("doc_id", "t", "u").agg(
        F.array_sort(F.collect_set(F.struct("first", (F.col("last") + 1).alias("end")))).alias("spans")
    )
    return grouped.mapInArrow(tidied(_merge), "doc_id long, t long, u long, spans array<struct<first:int,end:int>>")


def _merge(batches) -> Iterator:
    """Join touching spans of each row."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = []
        for spans in batch.column(3).to_pylist():
            row: list[dict] = []
            for s in spans:
                if row and s["first"] <= row[-1]["end"]:
                    row[-1]["end"] = max(row[-1]["end"], s["end"])
                else:
                    row.append(dict(s))
            out.append(row)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, kind)], ["doc_id", "t", "u", "spans"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``doc_id, n_units, n_removed, removed`` (character spans, end exclusive) and ``text`` without them."""
    import pyarrow as pa

    src = _documents(docs, _shared_ids(docs))
    hits = materialize(repeated_spans(src), "hits")
    held = hits.agg(F.coalesce(F.sum(F.size("spans") + 4), F.lit(0))).first()[0]
    if held <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    hits = hits.withColumnsRenamed({c: f"__{c}" for c in ("doc_id", "t", "u")})
    same = src["doc_id"].eqNullSafe(hits["__doc_id"]) & (src["t"] == hits["__t"]) & (src["u"] == hits["__u"])
    joined = src.join(hits, same, "left").select("doc_id", "text", "spans")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches) -> Iterator:
        for batch in batches:
            counts, gone, removed, out = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                units = sentence_units(text) if text else []
                flag = np.zeros(len(units) + 1, dtype=np.int64)
                for s in spans or ():
                    if s["end"] <= len(units):
                        flag[s["first"]] += 1
                        flag[s["end"]] -= 1
                bad = np.cumsum(flag)[: len(units)] > 0
                counts.append(len(units))
                gone.append(int(bad.sum()))
                spots: list[list[int]] = []
                for k in np.flatnonzero(bad):
                    a, b, _ = units[k]
                    if spots and spots[-1][1] == a:
                        spots[-1][1] = b
                    else:
                        spots.append([a, b])
                removed.append([{"start": a, "end": b} for a, b in spots])
                if spots:
                    keep, at = [], 0
                    for a, b in spots:
                        keep.append(text[at:a])
                        at = b
                    text = "".join(keep) + text[at:]
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span_type), pa.array(out, pa.string())],
                ["doc_id", "n_units", "n_removed", "removed", "text"],
            )

    return joined.mapInArrow(tidied(cut), "doc_id long, n_units long, n_removed long, removed array<struct<start:int,end:int>>, text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"))
