"""Best-fit packing of token sequences by bin completion.

Lengths are integers of at most ``max_len``, so the whole corpus is described by a histogram of
at most ``max_len`` counts however many documents there are. The branch and bound search runs
on that histogram and yields *fillings with multiplicities*; the executors then turn the rank
of each piece among the pieces of its length into a sequence and an offset by arithmetic.

Defined results: null or empty text is one piece holding only the separator; repeated rows are
packed as often as they occur; an empty table gives no rows; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, read, text_batches, tidied, with_fields

MAX_LEN = 2048
SEPARATOR = 0

PART_ROWS = 2_000_000  # pieces of a range partition on average

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokenizing and cutting


def piece_bounds(total: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids: every piece but the first
    is full."""
    if total <= max_len:
        return [(0, total)]
    head = total % max_len
    bounds = [(0, head)] if head else []
    return bounds + [(s, max_len) for s in range(head, total, max_len)]


def _encoder(path: str, added: bool = True):
    """The encoder of a byte-level BPE vocabulary given as a rank file (``.tiktoken``) or a tokenizer file
    (``.json``); where both lie side by side the ranks are used, as they give the same ids several times
    faster. With ``added`` the literals of the tokenizer file's added tokens become these tokens, as
    ``Tokenizer.encode`` has it; without they are ordinary text."""
    import base64
    import json
    import os

    stem = path.removesuffix(".tiktoken").removesuffix(".json")
    ranks, file = stem + ".tiktoken", stem + ".json"
    tokens = []
    if added and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens") or []
    names = [t["content"] for t in tokens]
    # Tokens that take in what is around them, or begin alike, are left to the tokenizer itself.
    plain = not any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word", "normalized"))
    plain &= not any(a != b and a.startswith(b) for a in names for b in names)
    if os.path.exists(ranks) and plain:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={t["content"]: t["id"] for t in tokens})
        if not tokens:
            return lambda texts: [enc.encode_ordinary(t) for t in texts]
        return lambda texts: [enc.encode(t, allowed_special="all") if any(n in t for n in names) else enc.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(file)
    tok.encode_special_tokens = not added
    return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize_pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    max_len: int = MAX_LEN,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    added: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, with ``with_ids``,
    ``ids`` (little-endian uint32). Texts are encoded whole; only documents longer than
    ``max_len`` ids are cut. ``added``: see ``_encoder``."""
    path = tokenizer or default_tokenizer()

    text_batches(docs.sparkSession)
    def run(batches) -> Iterator:
        import zlib

        import pyarrow as pa

        encode = _encoder(path, added)
        for batch in batches:
            ids_in = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                out: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(ids_in[lo : lo + 256], encode([t or "" for t in texts[lo : lo + 256]])):
                    ids.append(SEPARATOR)
                    raw = np.asarray(ids, dtype="<u4").tobytes()
                    for k, (start, length) in enumerate(piece_bounds(len(ids), max_len)):
                        part = raw[4 * start : 4 * (start + length)]
                        row = (doc, k, start, length, zlib.crc32(part), part if with_ids else None)
                        for c, v in zip(out, row):
                            c.append(v)
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays(arrays[:keep], names[:keep])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(tidied(run), PIECES + (", ids binary" if with_ids else ""))


# ---------------------------------------------------------------- the search


@dataclass
class Plan:
    """Fillings: each is a list of (length, count), used ``times`` times."""

    fillings: list[tuple[tuple[tuple[int, int], ...], int]] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return sum(t for _, t in self.fillings)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Larger of the volume bound and the dual-feasible bounds over every threshold k (items over
    capacity - k fill a bin alone, items under k count for nothing)."""
    sizes = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    volume = counts * sizes
    best = -(-int(volume.sum()) // capacity)
    n_cum, v_cum = np.cumsum(counts), np.cumsum(volume)
    half = capacity // 2
    for k in range(1, half + 1):
        big = int(n_cum[-1] - n_cum[capacity - k])
        mid_n = int(n_cum[capacity - k] - n_cum[half])
        mid_v = int(v_cum[capacity - k] - v_cum[half])
        small = int(v_cum[half] - v_cum[k - 1])
        spare = mid_n * capacity - mid_v
        best = max(best, big + mid_n + max(0, -(-(small - spare) // capacity)))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit on the histogram, the first incumbent: pieces by falling length, each into the open
    bin with least room that holds it. Bins with equal contents are handled together."""
    rooms: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    present = np.zeros(capacity + 1, dtype=bool)
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(room: int, content, times: int) -> None:
        if room == 0:
            done.append((content, times))
        else:
            rooms.setdefault(room, []).append((content, times))
            present[room] = True

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            fits = np.flatnonzero(present[size:])
            if len(fits) == 0:
                per = capacity // size
                full, rest = divmod(left, per)
                if full:
                    put(capacity - per * size, ((size, per),), full)
                if rest:
                    put(capacity - rest * size, ((size, rest),), 1)
                break
            room = size + int(fits[0])
            content, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                present[room] = False
            per = min(room // size, left)
            use = min(times, left // per)
            if use < times:
                put(room, content, times - use)
            put(room - per * size, (*content, (size, per)), use)
            left -= use * per
    return Plan(done + [c for group in rooms.values() for c in group])


def completions(counts: np.ndarray, top: int, capacity: int, visits: int, most: int) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated ways to fill what ``top`` leaves of a bin: (waste, lengths by falling size),
    least waste first. A filling is dominated if some of its pieces could be exchanged for one
    absent piece that is as long as they together and still fits (the exchanged ones are more
    useful later). ``visits`` bounds the enumeration of one node."""
    room = capacity - top
    have = counts.copy()
    have[top] -= 1
    sizes = [int(s) for s in np.flatnonzero(have[: room + 1])[::-1]] if room else []
    least = sizes[-1] if sizes else capacity + 1
    index = {s: i for i, s in enumerate(sizes)}
    found: list[tuple[int, tuple[int, ...]]] = []
    best = room
    budget = visits

    def dominated(chosen: tuple[int, ...], waste: int) -> bool:
        sums: set[int] = set()
        singles = set(chosen)
        for x in chosen[:10]:
            sums |= {s + x for s in sums} | {x}
            if len(sums) > 400:
                break
        for s in sums:
            lo = s if s not in singles else s + 1
            for x in range(lo, min(s + waste, room) + 1):
                if x in index and have[x] > chosen.count(x):
                    return True
        return False

    stack: list[tuple[int, tuple[int, ...], int]] = [(room, (), 0)]
    while stack and budget > 0 and len(found) < 4 * most:
        left, chosen, i = stack.pop()
        budget -= 1
        if left < least or i >= len(sizes):
            if left <= best + 8 or len(found) < most:
                best = min(best, left)
                found.append((left, chosen))
            continue
        if left in index and index[left] >= i and have[left] > chosen.count(left):
            best = 0
            found.append((0, (*chosen, left)))
            if len(found) >= most:
                break
        while i < len(sizes) and (sizes[i] > left or have[sizes[i]] <= chosen.count(sizes[i])):
            i += 1
        if i >= len(sizes):
            if left <= best + 8 or len(found) < most:
                best = min(best, left)
                found.append((left, chosen))
            continue
        stack.append((left, chosen, i + 1))
        stack.append((left - sizes[i], (*chosen, sizes[i]), i))
    uniq = sorted(set(found), key=lambda f: (f[0], tuple(-x for x in f[1])))
    kept = [f for f in uniq if not dominated(f[1], f[0])]
    return (kept or uniq)[:most]


def bin_completion(counts: np.ndarray, capacity: int, visits: int = 600, width: int = 4, nodes: int = 6_000) -> Plan:
    """Branch and bound over fillings of the bin around the largest remaining piece.

    Depth first with at most ``width`` undominated fillings a node and ``nodes`` nodes in all (both
    bound only the search; every piece is always placed). A filling is applied as often as the
    counts allow. A branch ends when the waste so far exceeds what an incumbent leaves to the
    lower bound; the incumbent starts as best fit and is replaced by every better solution; the
    search stops when it meets the lower bound.
    """
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    sizes = np.arange(len(counts), dtype=np.int64)
    total = int((counts * sizes).sum())
    if total == 0:
        return Plan()
    bound = lower_bound(counts, capacity)
    incumbent = best_fit_decreasing(counts, capacity)
    spent = 0

    def contents(top: int, chosen: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
        have: dict[int, int] = {top: 1}
        for x in chosen:
            have[x] = have.get(x, 0) + 1
        return tuple(sorted(have.items(), reverse=True))

    # A frame: remaining counts, waste so far, depth of the path, and its untried fillings.
    path: list[tuple[tuple[tuple[int, int], ...], int]] = []
    frames: list[tuple[np.ndarray, int, int, list]] = []

    def options(left: np.ndarray) -> list:
        top = int(np.flatnonzero(left)[-1])
        return [(w, contents(top, c)) for w, c in completions(left, top, capacity, visits, width)][::-1]

    frames.append((counts, 0, 0, options(counts)))
    bins = 0
    while frames and incumbent.bins > bound:
        left, waste, depth, untried = frames[-1]
        while len(path) > depth:
            bins -= path.pop()[1]
        if not untried:
            frames.pop()
            continue
        w, filling = untried.pop()
        times = min(int(left[s]) // k for s, k in filling)
        # The waste that the incumbent less one bin allows.
        allowed = (incumbent.bins - 1) * capacity - total
        if waste + w > allowed:
            continue
        times = min(times, (allowed - waste) // w) if w else times
        nxt = left.copy()
        for s, k in filling:
            nxt[s] -= k * times
        path.append((filling, times))
        bins += times
        spent += 1
        if not nxt.any():
            if bins < incumbent.bins:
                incumbent = Plan(list(path))
            continue
        rest = nxt * sizes
        if bins + -(-int(rest.sum()) // capacity) >= incumbent.bins:
            continue
        if spent > nodes:
            # Out of nodes: close this branch by best fit, which may still improve the incumbent.
            closed = best_fit_decreasing(nxt, capacity)
            if bins + closed.bins < incumbent.bins:
                incumbent = Plan(list(path) + closed.fillings)
            break
        if spent % 64 == 0:
            closed = best_fit_decreasing(nxt, capacity)
            if bins + closed.bins < incumbent.bins:
                incumbent = Plan(list(path) + closed.fillings)
        frames.append((nxt, waste + w * times, len(path), options(nxt)))
    return incumbent


# ---------------------------------------------------------------- placing the pieces


def _segments(plan: Plan, max_len: int) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, filling's first sequence, times, offset of its first copy)."""
    segs: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(max_len + 1, dtype=np.int64)
    first = 0
    for filling, times in plan.fillings:
        offset = 0
        for size, k in filling:
            segs.setdefault(size, []).append((int(used[size]), first, times, offset))
            used[size] += k * times
            offset += k * size
        first += times
    return {s: np.array(v, dtype=np.int64) for s, v in segs.items()}


def pack_pieces(pieces: DataFrame, max_len: int = MAX_LEN, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a length of 1 to ``max_len``; like-named
    input columns are replaced.

    The rows are range-partitioned by (length, a number of their own, mixed), so a length that holds a third of all rows
    spreads over as many tasks as it needs and the table of (partition, length) counts, which the
    driver turns into rank bases, has at most partitions + ``max_len`` rows.
    """
    import pyarrow as pa

    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    mix, part_col, rank_col = fresh(pieces, "__mix", "__part", "__rank")
    # Written first: range partitioning reads its input twice, for the bounds and for the rows. With each row a
    # number of its own, equal rows are spread too.
    tokenized = materialize(pieces.withColumn(mix, F.xxhash64(F.monotonically_increasing_id())), "tokenized")
    n_part = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokenized.count() // PART_ROWS), 1)
    spread = tokenized.repartitionByRange(n_part, length_col, mix).drop(mix)
    schema = with_fields(spread, f"{part_col} int, {rank_col} long")

    def number(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, dtype=np.int64)
        for batch in batches:
            size = batch.column(batch.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
            within = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
            rank = np.empty(len(size), dtype=np.int64)
            rank[order] = seen[ordered] + within
            seen += np.bincount(size, minlength=max_len + 1)[: max_len + 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(rank)],
                [*batch.schema.names, part_col, rank_col],
            )

    numbered = materialize(spread.mapInArrow(tidied(number), schema), "pieces")
    per = numbered.groupBy(part_col, length_col).count().toPandas()
    per.columns = ["part", "size", "n"]
    per = per.sort_values(["size", "part"])
    per["base"] = per.groupby("size")["n"].cumsum() - per["n"]
    counts = np.zeros(max_len + 1, dtype=np.int64)
    np.add.at(counts, per["size"].to_numpy(np.int64), per["n"].to_numpy(np.int64))
    plan = bin_completion(counts, max_len)
    # Sorted keys part * (max_len + 1) + size, so that a lookup is a binary search.
    key = per["part"].to_numpy(np.int64) * (max_len + 1) + per["size"].to_numpy(np.int64)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], per["base"].to_numpy(np.int64)[order], _segments(plan, max_len)))
    out = with_fields(pieces, "sequence_id long, offset long")

    def place(batches):
        keys, bases, segs = shared.value
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            size = col(length_col)
            rank = col(rank_col) + bases[np.searchsorted(keys, col(part_col) * (max_len + 1) + size)] if len(size) else size
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                seg = segs[int(s)]
                row = seg[np.searchsorted(seg[:, 0], rank[at], side="right") - 1]
                t = rank[at] - row[:, 0]
                seq[at] = row[:, 1] + t % row[:, 2]
                off[at] = row[:, 3] + t // row[:, 2] * s
            names = [n for n in batch.schema.names if n not in (part_col, rank_col)]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(tidied(place), out)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, with_ids: bool = False, added: bool = True) -> DataFrame:
    """Tokenize whole texts, cut what is longer than ``max_len`` and pack all pieces. The ids are those of
    ``Tokenizer.encode``, in which the literal of an added token is that token, unless ``added`` is false."""
    return pack_pieces(tokenize_pieces(docs, tokenizer, max_len, with_ids=with_ids, added=added), max_len)


def assemble(packed: DataFrame) -> DataFrame:
    """Sequences as token ids: ``sequence_id, length, ids`` (needs ``with_ids``); a group is at
    most one sequence long."""
    rows = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.select("sequence_id", "length", joined.alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
