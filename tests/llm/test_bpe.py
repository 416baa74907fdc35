"""Byte-level BPE against the tiktoken library and against plain merging."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lumenfold.llm import bpe

from .helpers import awkward, frame, prose

FILES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.encoder(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def check(both, text):
    own, lib, _ = both
    raw = own.encode(text)
    assert ids(raw) == lib.encode_ordinary(text), repr(text[:200])
    assert own.decode(raw) == text.encode()


def test_every_code_point(both):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for shape in ("a{}a", " {}1", "!{}"):
        for lo in range(0, len(points), 4096):
            check(both, "".join(shape.format(chr(c)) for c in points[lo : lo + 4096]))


def test_random_texts(both):
    rng = random.Random(1)
    tokens = [t.decode("utf-8", "ignore") for t in both[2]]
    for _ in range(4000):
        check(both, "".join(rng.choice(tokens) for _ in range(rng.randrange(1, 12))))
        check(both, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 70))))
        check(both, "".join(rng.choice("the aeiou\n \t'sll'd12") for _ in range(rng.randrange(1, 90))))


def test_long_pieces_and_runs(both):
    rng = random.Random(2)
    for text in ("a" * 60_000, "ab" * 30_000, " " * 60_000, "\n " * 30_000, "é" * 30_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "word " * 150_000):
        check(both, text)


def merge(piece: bytes, ranks, trace=None):
    """Join the pair of least rank, leftmost first, until none is left; ``trace`` takes the ranks used."""
    parts = [bytes([b]) for b in piece]
    while True:
        able = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not able:
            return [ranks[p] for p in parts]
        rank, i = min(able)
        if trace is not None:
            trace.append(rank)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def learned(rng, merges):
    """Ranks of a small vocabulary of random merges of tokens already there, all over few letters."""
    ranks = {bytes([b]): b for b in range(256)}
    pool = [b"a", b"b", b"c"]
    while len(ranks) < 256 + merges:
        t = rng.choice(pool) + rng.choice(pool)
        if t not in ranks:
            ranks[t] = len(ranks)
            pool.append(t)
    return ranks


@pytest.mark.parametrize("seed", range(25))
def test_small_vocabularies_against_merging(seed):
    # Random merges leave tokens that merging never makes; these may only appear as whole pieces.
    rng = random.Random(seed)
    ranks = learned(rng, rng.randrange(1, 40))
    try:
        vocabulary = bpe.Vocabulary(ranks)
    except ValueError:
        # Refused: some token really is merged from one of a higher rank.
        traces = {t: [] for t in ranks}
        assert any(merge(t, ranks, traces[t]) == [r] and max(traces[t], default=r) > r for t, r in ranks.items())
        return
    for _ in range(300):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
        want = [ranks[piece]] if piece in ranks else merge(piece, ranks)
        assert list(vocabulary.encode(piece.decode("latin-1"))) == want


def test_ranks_that_merges_do_not_follow_are_refused():
    bytes_only = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="higher rank"):
        bpe.Vocabulary(bytes_only | {b"abc": 256, b"ab": 257})
    with pytest.raises(ValueError, match="every byte"):
        bpe.Vocabulary({b"a": 0, b"b": 1})


def test_memo_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_HELD", 5)
    monkeypatch.setattr(bpe, "PAIRS_HELD", 5)
    monkeypatch.setattr(bpe, "MATCHES", 7)
    own = bpe.Encoder(both[0].vocabulary, both[0].splitter)
    text = prose(random.Random(4), 60) + "\U0001df67 x"
    assert ids(own.encode(text)) == both[1].encode_ordinary(text) and len(own) <= 5
    assert own.decode(own.encode(text)) == text.encode()


def test_decoding_refuses_what_is_no_token(both):
    for raw in (b"\x00\x00\x00", np.array([2**31], "<u4").tobytes(), np.array([50_256], "<u4").tobytes()):
        with pytest.raises(ValueError):
            both[0].decode(raw)


def test_documents(spark, both):
    rng = random.Random(7)
    rows = [*awkward(rng).items(), (None, "no id"), (None, None), (901, ""), (5, prose(rng, 3)), (5, prose(rng, 4)), (6, "naïve text \U0001f600\x1c\x85")]
    encoded = bpe.encode_documents(frame(spark, rows).repartition(3))
    out = bpe.decode_documents(encoded).collect()
    lib = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_ranks(), "rb"))})
    want = sorted(repr((d, lib.encode_ordinary(t or ""), (t or "").encode())) for d, t in rows)
    assert sorted(repr((r["doc_id"], ids(bytes(r["ids"])), bytes(r["decoded"]))) for r in out) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in out)


def test_query_holds_the_digests(spark):
    out = {r["doc_id"]: r for r in bpe.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    own = bpe.encoder(bpe.default_ranks())
    for d, t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        raw = own.encode(t or "")
        assert out[d]["n_tokens"] == len(raw) // 4
        assert out[d]["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert out[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.decode_documents(bpe.encode_documents(frame(spark, {}))).count() == 0
