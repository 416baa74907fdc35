"""Near-duplicate documents through a multi-index Hamming join of min-wise signatures.

A signature has ``CHUNKS * WIDTH`` components of 32 bits, each the least value of one hash
function over the document's shingles; two components agree with the probability of the
Jaccard similarity J. The signature distance is the number of differing components. By the
pigeonhole principle, two signatures at a distance of at most ``CHUNKS * (ERRORS + 1) - 1``
have a chunk with at most ``ERRORS`` errors; each chunk is indexed under every choice of
``WIDTH - ERRORS`` components left by masking ``ERRORS`` of them, so all those pairs share a key.
Pairs further apart are found too unless every single chunk has more errors: with 12 chunks of
4 and one error the chance to miss a pair at J = 0.75 exactly is 0.262 ** 12, one in ten
million, and it falls quickly above.

Links are confirmed on the full shingle sets. Documents with equal sets are one class from the
start. A bucket's members are linked to its least one, the hub, first; members around a hub that are
then still in different components are compared with each other, large groups in pairs of bounded
blocks, and only links that join components leave the task. Copies are thus never expanded into all pairs, and no
link that could join two components is lost.

Defined results: a text without words (or null) has no shingles and links with nothing; fewer
words than a shingle are one shingle; rows that share a ``doc_id`` are one document, whose set is the
union of its texts' (they are put together in one task, like one long text); rows without a ``doc_id``
are documents of their own and link with nothing; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WordHashes, connected_components, materialize, maybe_broadcast, mix64, read, text_batches, text_bytes, tidied

SHINGLE = 5
PERCENT = 75
CHUNKS, WIDTH, ERRORS = 12, 4, 1
COMPONENTS = CHUNKS * WIDTH
# Candidates further apart are not confirmed: at J = 0.75 the distance is 12 on average with a
# deviation of 3, and exceeds this with a chance of about 1e-8.
FAR = 30
# Bounds of a block of what shares a hub, and rows of a group of small hubs (whose bytes are half a block's).
BLOCK_ROWS = 1_024
BLOCK_BYTES = 6_000_000
GROUP_ROWS = 1_000

_POWERS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


# Between the texts of one document: a byte that UTF-8 never holds.
PART = b"\xff"


def shingle_hashes(text: bytes, memo: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``k``-grams of a UTF-8 text, or of several with ``PART``
    between them."""
    if PART in text:
        return np.unique(np.concatenate([shingle_hashes(t, memo, k) for t in text.split(PART)]))
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=n)
    width = min(k, n)
    acc = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        acc += h[j : n - width + 1 + j] * _POWERS[j]
        acc ^= acc >> np.uint64(29)
        acc *= _POWERS[32 + j]
    return np.unique(mix64(acc))


_SALTS = mix64(np.arange(101, 101 + COMPONENTS, dtype=np.uint64))
_FACTORS = mix64(np.arange(901, 901 + COMPONENTS, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least 32-bit hash of the set under each function."""
    out = np.full(COMPONENTS, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(shingles), 4096):
        x = shingles[lo : lo + 4096, None]
        v = (((x ^ _SALTS) * _FACTORS) >> np.uint64(32)).min(axis=0).astype(np.uint32)
        np.minimum(out, v, out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_hash`` (128 bits) and ``sig`` (array of ints, null without shingles)."""

    text_batches(docs.sparkSession)
    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        memo = WordHashes()
        for batch in batches:
            ids, sizes, hashes, flat, valid = batch.column(0), [], [], [], []
            for text in text_bytes(batch.column(1)):
                s = shingle_hashes(text, memo)
                sizes.append(len(s))
                valid.append(len(s) > 0)
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    flat.append(signature(s).view(np.int32))
            offsets = np.concatenate([[0], np.cumsum(np.array(valid, dtype=np.int64) * COMPONENTS)]).astype(np.int32)
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            sig = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~np.array(valid, dtype=bool)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), sig],
                ["doc_id", "n_shingles", "set_hash", "sig"],
            )

    return _bytes(docs).mapInArrow(tidied(run), "doc_id long, n_shingles long, set_hash binary, sig array<int>")


def chunk_keys(sig: str = "sig") -> list:
    """The signature's index keys: per chunk, each choice of components with ``ERRORS`` masked."""
    keys = []
    for c in range(CHUNKS):
        for kept in combinations(range(WIDTH), WIDTH - ERRORS):
            parts = [F.col(sig)[c * WIDTH + j] for j in kept]
            keys.append(F.xxhash64(F.lit(c * 64 + sum(1 << j for j in kept)), *parts))
    return keys


def close_pairs(pairs: DataFrame, nodes: DataFrame, far: int = FAR, percent: int = PERCENT) -> DataFrame:
    """Of ``(a, b)`` those whose signatures differ in at most ``far`` components and whose set sizes
    allow the similarity."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            a, b = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, COMPONENTS) for i in (2, 3))
            ok = pa.array((a != b).sum(axis=1) <= far)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    joined = side("a").join(maybe_broadcast(pairs), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return joined.select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``(a, b)`` those with 100 * |A and B| >= percent * |A or B| on the full shingle sets."""
    pairs = materialize(pairs, "pairs")
    texts = _texts(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())

    def run(batches):
        import pyarrow as pa

        memo, last, held = WordHashes(), None, None
        for batch in batches:
            ids_a, ids_b = batch.column(0), batch.column(1)
            keep = []
            for a, ta, tb in zip(ids_a.to_pylist(), text_bytes(batch.column(2)), text_bytes(batch.column(3))):
                if a != last:
                    last, held = a, shingle_hashes(ta, memo)
                other = shingle_hashes(tb, memo)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both) and both > 0)
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([ids_a.filter(ok), ids_b.filter(ok)], ["a", "b"])

    side_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    side_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    joined = side_b.join(maybe_broadcast(pairs), "b").join(side_a, "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(tidied(run), "a long, b long")


def prefix_keys(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, key`` by which all pairs of at least ``percent`` similarity meet, without signatures: of sets A and B
    that are that similar at least that share of A is in B, so with all shingles in one order, the rarest first,
    a common one is among the first |A| - ceil(percent |A|) + 1 of A, and likewise of B. Every shingle is shuffled."""
    text_batches(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        memo = WordHashes()
        for batch in batches:
            for row, text in enumerate(text_bytes(batch.column(1))):
                h = shingle_hashes(text, memo).view(np.int64)
                own = batch.column(0).slice(row, 1)
                for lo in range(0, len(h), 100_000):
                    part = h[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(np.zeros(len(part), np.int64))), pa.array(part)], ["node", "key"])

    texts = _texts(docs, nodes.select(F.col("node").alias("doc_id")))
    held = materialize(texts.select(F.col("doc_id").alias("node"), "text").mapInArrow(tidied(run), "node long, key long"), "shingles")
    often = materialize(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "often")
    # A shingle of one document alone links nothing, but has its place in the order.
    order = W.partitionBy("node").orderBy("n", "key")
    placed = held.join(often, "key").withColumn("at", F.row_number().over(order)).join(nodes.select("node", "size"), "node")
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    return placed.where((F.col("at") <= first) & (F.col("n") > 1)).select("node", "key")


def near_duplicates(docs: DataFrame, far: int = FAR, exact: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``. With ``far=COMPONENTS`` every pair that
    shares an index key is confirmed, however far its signatures. ``exact`` finds candidates by ``prefix_keys`` in place
    of the signatures, so that no link can be missed; it shuffles many times as much."""
    if exact:
        far = COMPONENTS
    rows, docs = _one_set_each(materialize(signatures(docs), "signatures"), _bytes(docs))
    # Equal sets are one class; an id has one set and so is in one class.
    classes = (
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_hash")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
    )
    classes = materialize(classes, "classes")
    nodes = classes.select("node", "size", "sig")
    # Each bucket's members next to its least one, its hub.
    keys = prefix_keys(docs, nodes) if exact else nodes.select("node", F.explode(F.array(*chunk_keys())).alias("key"))
    shares = materialize(_hubs(keys), "shares")

    # First members against their hubs, then what is still apart around a hub.
    pairs = shares.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    first = connected_components(confirm(close_pairs(pairs, nodes, far), docs))
    later = materialize(_links_apart(shares, first, nodes, docs, far, keyed=not exact), "apart")
    whole = _joined_further(first, later)

    # A class goes where its node, its least id, goes.
    labels = classes.select("set_hash", "node").join(whole, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    labels = maybe_broadcast(materialize(labels, "components"), BROADCAST_ROWS // 4)  # wider keys than longs
    out = rows.select("doc_id", "n_shingles", "set_hash").join(labels, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _joined_further(first: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` of the components ``first`` when ``links`` join some of them."""
    if links.isEmpty():
        return first
    at = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    more = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    more = materialize(more.withColumnsRenamed({"node": "at", "component": "to"}), "joined")
    moved = first.join(more, first["component"] == more["at"], "left").select("node", F.coalesce("to", "component").alias("component"))
    # Nodes that had no link before.
    new = more.join(first.select("node"), more["at"] == first["node"], "left_anti").select(F.col("at").alias("node"), F.col("to").alias("component"))
    return materialize(moved.unionByName(new), "components")


def _hubs(keys: DataFrame) -> DataFrame:
    """Distinct (hub, node) over the buckets that two or more nodes share, the hub being the bucket's
    least node and among its own. Keys are counted with a combine before the shuffle and only
    shared ones are joined back."""
    many = (
        keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub < most").select("key", "hub")
    )
    # Written: counted for the broadcast, and beyond it the join shuffles both sides itself and a hot bucket
    # can be split.
    return keys.join(maybe_broadcast(materialize(many, "buckets")), "key").select("hub", "node").distinct()


def _agreeing() -> np.ndarray:
    """For each byte of agreement bits (two chunks of four components) whether a chunk is in reach."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, -1, WIDTH)
    return (bits.sum(axis=2) >= WIDTH - ERRORS).any(axis=1)


def link_group(node: np.ndarray, comp: np.ndarray, size: np.ndarray, sig: np.ndarray, texts, left: np.ndarray, right: np.ndarray, far: int, percent: int, memo: WordHashes, keyed: bool = True):
    """Confirmed links between members ``left`` and ``right`` (row numbers) around one hub, but none
    between members that are connected already. Looked at are pairs that share an index key of their signatures
    (unless not ``keyed``), are at most ``far`` apart and have sizes that allow the similarity."""
    comp = comp.copy()
    table = _agreeing()
    sets: dict[int, np.ndarray] = {}

    def shingles(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingle_hashes(texts[k].as_py() or b"", memo)
        return sets[k]

    out = []
    for p in left:
        apart = comp[right] != comp[p]
        apart &= 100 * np.minimum(size[right], size[p]) >= percent * np.maximum(size[right], size[p])
        cand = right[apart]
        if len(cand) == 0:
            continue
        same = sig[cand] == sig[p]
        near = COMPONENTS - same.sum(axis=1) <= far
        cand, same = cand[near], same[near]
        cand = cand[table[np.packbits(same, axis=1)].any(axis=1)] if keyed else cand
        if len(cand) == 0:
            continue
        own = shingles(p)
        for lo in range(0, len(cand), 256):
            part = cand[lo : lo + 256]
            part = part[comp[part] != comp[p]]
            if len(part) == 0:
                continue
            others = [shingles(k) for k in part]
            sizes = np.array([len(o) for o in others])
            flat = np.concatenate(others)
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            for k in part[100 * both >= percent * (len(own) + sizes - both)]:
                if comp[k] != comp[p]:
                    out.append((min(node[p], node[k]), max(node[p], node[k])))
                    comp[comp == comp[k]] = comp[p]
    return out


def _links_apart(shares: DataFrame, found: DataFrame, nodes: DataFrame, docs: DataFrame, far: int = FAR, percent: int = PERCENT, keyed: bool = True) -> DataFrame:
    """Links between different components around the hubs. What shares a hub is cut into hash blocks of
    bounded size and each pair of blocks is one group; several small hubs make one group. A group
    reports at most one link less than members."""
    import pyarrow as pa

    placed = shares.join(found, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"))
    placed = materialize(placed, "placed")
    many = placed.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("hub")
    mixed = materialize(placed.join(materialize(many, "open"), "hub"), "mixed")
    texts = _texts(docs, mixed.select(F.col("node").alias("doc_id")).distinct())
    known = materialize(
        nodes.join(texts, nodes["node"] == texts["doc_id"]).select("node", "size", "sig", "text"), "known"
    )
    weighed = mixed.join(known.select("node", F.octet_length("text").alias("bytes")), "node")
    blocks = (
        weighed.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        .select("hub", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    )
    blocks = materialize(blocks, "blocks")
    small = weighed.join(blocks.where("blocks = 1"), "hub").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    bins = 1 + max(small["n"] // GROUP_ROWS, 2 * small["bytes"] // BLOCK_BYTES)
    rows = mixed.join(blocks, "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.when(F.col("blocks") > 1, F.col("hub")).otherwise(-1 - F.pmod(F.xxhash64("hub"), F.lit(bins)))
    rows = rows.join(known, "node").select(
        group.alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "hub", "own", "node", "component", "size", "sig", "text"
    )

    def run(key, table):
        i, j = int(key[1].as_py()), int(key[2].as_py())
        table = table.sort_by("hub").combine_chunks()
        hub, own, node, comp, size = (table.column(c).to_numpy() for c in ("hub", "own", "node", "component", "size"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(node), COMPONENTS)
        text, memo, out = table.column("text"), WordHashes(), []
        edges = np.flatnonzero(np.r_[True, hub[1:] != hub[:-1], True])
        for a, b in zip(edges[:-1], edges[1:]):
            if len(np.unique(comp[a:b])) > 1:
                left, right = np.flatnonzero(own[a:b] == i), np.flatnonzero(own[a:b] == j)
                out += link_group(node[a:b], comp[a:b], size[a:b], sig[a:b], text[a:b], left, right, far, percent, memo, keyed)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("g", "i", "j").applyInArrow(run, "a long, b long")


def _bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, the text as UTF-8."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _one_set_each(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` of signatures and ``docs``, where rows of one id with different sets all have the union."""
    own = F.xxhash64("set_hash")
    mixed = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    mixed = materialize(mixed.where("lo <> hi").select("doc_id"), "mixed_ids")
    if mixed.isEmpty():
        return rows, docs
    ids = maybe_broadcast(mixed)
    glue = lambda acc, t: F.when(F.octet_length(acc) == 0, t).otherwise(F.concat(acc, F.lit(PART), t))
    whole = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("text")).alias("parts"))
    whole = materialize(whole.select("doc_id", F.aggregate("parts", F.lit(b""), glue).alias("text")), "whole")
    signed = materialize(signatures(whole), "signatures")
    rows = rows.join(ids, "doc_id", "left_anti").unionByName(rows.select("doc_id").join(signed, "doc_id"))
    return materialize(rows, "signatures"), docs.join(ids, "doc_id", "left_anti").unionByName(whole)


def _texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """One text for each needed id: texts of one id have the same shingles here."""
    need = materialize(need, "need")
    found = materialize(docs.join(maybe_broadcast(need), "doc_id", "left_semi"), "texts")
    # Ids that are unique need no shuffle.
    return found if found.count() <= need.count() else materialize(found.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """Documents that stand for their group; columns as given. Rows go, texts of a document that stays don't: rows
    that share an id are one document, of which every distinct text stays, once. Of rows with the same id and
    text the least in the other columns, as JSON, stays. Rows without an id are no copies of one another."""
    result = materialize(near_duplicates(docs), "near")
    drop = materialize(result.where("not kept").select("doc_id").distinct(), "drop")
    out = docs.join(maybe_broadcast(drop), "doc_id", "left_anti")
    again = materialize(result.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.isEmpty():
        ids = maybe_broadcast(again)
        row, order = F.struct(*out.columns), F.to_json(F.struct(F.lit(0), *(c for c in out.columns if c not in ("doc_id", "text"))))
        least = out.join(ids, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, order).alias("__row"))
        out = out.join(ids, "doc_id", "left_anti").unionByName(least.select("__row.*"))
    return out.select(*docs.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + {SHINGLE - 1}), ' ') AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= {PERCENT} * (na.n + nb.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk AS (SELECT a, b FROM e UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a),
c AS (SELECT a, least(a, min(b)) AS component FROM walk GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
       coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
