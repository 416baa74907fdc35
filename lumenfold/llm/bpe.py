"""Byte-level BPE encoding and decoding with the ids that merging by rank gives, in linear time.

Merging joins, over and over, the adjacent pair of least rank. Its result is the only sequence of tokens that
spells the piece and in which every two neighbours are *compatible*: the two tokens' bytes, merged together,
give these two tokens again. So a piece is encoded from left to right. One run of an Aho-Corasick automaton
(bytes as Latin-1 characters) finds the longest token at every position; the encoder takes it if it is
compatible with the token before, else the next shorter one, and steps back where none is left. A position that
was left once is never tried again, so the work is linear in the bytes. Compatibility is memoised; it undoes the
merges of both tokens along their shared border, from the last one back, and looks for a merge across the border
that would have come first.

A text is split by the pattern first and every match is encoded by itself; a match that is a token is that token.
Character classes of the pattern follow the engine that the ranks are made for: code points that the splitting
engine classes otherwise (a newer Unicode) are matched as a stand-in of the right class.

Defined results: a null text is encoded as an empty one, to no ids; the spelling of a special token is ordinary
text; a null or empty list of ids is decoded to no bytes; ids that are no tokens, or bytes that are no whole
number of ids, are an error; repeated rows are encoded one by one; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_batches, tidied

PIECES_HELD = 400_000  # pieces in the memo, each of at most PIECE_BYTES
PIECE_BYTES = 64
PAIRS_HELD = 2_000_000  # pairs in the memo
MATCHES = 200_000  # matches of a text that are held at a time

SPLIT_CLASSES = ((r"\p{L}", "é"), (r"\p{N}", "²"), (r"\s", "　"))  # and a stand-in of each
OTHER = "§"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Vocabulary:
    """Tokens of a rank file with what the encoder needs: the automaton, the next shorter token that begins a
    token, the merge that makes it and the token that a pair is merged to."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.spelling: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.spelling[rank] = token
        if len(self.ids) != len(set(ranks.values())) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be distinct and include every byte")
        self.length = [len(t) if t else 0 for t in self.spelling]
        self.shorter = [-1] * self.size
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        self._compatible: dict[tuple[int, int], bool] = {}
        ids = self.ids
        for word, rank in ids.items():
            self.shorter[rank] = next((ids[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in ids), -1)
        for word, rank in sorted(ids.items(), key=lambda item: item[1]):
            if len(word) > 1 and not self._learn_merge(word, rank):
                if _merge(word, ids) == [rank]:
                    raise ValueError(f"token {rank} is merged from tokens of higher rank")
                continue  # merging never makes it: it is found only as a whole match
            self.automaton.add_word(word, rank)
        # A shorter token must be one that merging makes.
        for rank in range(self.size):
            while (s := self.shorter[rank]) >= 0 and not self._made(s):
                self.shorter[rank] = self.shorter[s]
        self.automaton.make_automaton()

    def _learn_merge(self, word: str, rank: int) -> bool:
        """Find the pair of earlier tokens that merging leaves last of all before ``word``."""
        a = self.shorter[rank]
        while a >= 0:
            b = self.ids.get(word[self.length[a] :])
            if b is not None and a < rank and b < rank and self._made(a) and self._made(b) and self._check(a, b):
                self.left[rank], self.right[rank] = a, b
                self.merged[a, b] = rank
                return True
            a = self.shorter[a]
        return False

    def _made(self, token: int) -> bool:
        """Whether merging makes ``token``."""
        return self.length[token] == 1 or self.left[token] != token

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` gives ``a`` and ``b``."""
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) >= PAIRS_HELD:
                self._compatible.clear()
            known = self._compatible[a, b] = self._check(a, b)
        return known

    def _check(self, a: int, b: int) -> bool:
        # Undo the merges of both sides, the latest first, and watch the two tokens at the border: a merge
        # across it that comes before the next one inside would have been taken instead.
        merged, left, right = self.merged, self.left, self.right
        before = self.size  # rank of the merge inside that was undone last
        while True:
            across = merged.get((a, b))
            if across is not None and across < before:
                return False
            # The later merge is undone first; of equal tokens the left one was merged first.
            undo_left = a > b
            if undo_left and right[a] == a or not undo_left and left[b] == b:
                # A single byte on that side: only the other side has merges left.
                undo_left = not undo_left
                if right[a] == a if undo_left else left[b] == b:
                    return True
            if undo_left:
                before, a = a, right[a]
            else:
                # A merge across of the same rank lies further left, so it comes first.
                before, b = b + 1, left[b]

    def encode(self, piece: str) -> list[int] | array:
        """Ids of a piece, given as Latin-1 characters."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        length, shorter, compatible = self.length, self.shorter, self.compatible
        longest = array("i", [0]) * n
        for last, token in self.automaton.iter(piece):  # by rising end: the longest comes last
            longest[last + 1 - length[token]] = token
        usable = bytearray(b"\x01") * (n + 1)
        out = array("I")
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if usable[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                # Nothing goes on from here: step back and try shorter than before.
                usable[at] = 0
                token = out.pop()
                at -= length[token]


def _merge(word: str, ids: dict[str, int]) -> list[int]:
    """Ids by merging the pair of least rank, leftmost first, with ``word`` itself allowed: quadratic, for checks
    of single tokens."""
    parts = list(word)
    while len(parts) > 1:
        rank, at = min((ids.get(parts[i] + parts[i + 1], len(ids) + 256), i) for i in range(len(parts) - 1))
        if parts[at] + parts[at + 1] not in ids:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ids[p] for p in parts]


class Splitter:
    """Matches of the pattern, with the character classes of the engine the ranks are made for."""

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
        single = {bytes([b]): b for b in range(256)}
        wanted, found = {}, {}
        for name, stand_in in SPLIT_CLASSES:
            # What no match covers is left out of the ids: these are the characters of the class.
            probe = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
            wanted |= dict.fromkeys(bytes(probe.encode_ordinary(every)).decode(), stand_in)
            found |= dict.fromkeys(regex.findall(name, every), stand_in)
        self.table = {ord(c): wanted.get(c, OTHER) for c in wanted.keys() | found.keys() if wanted.get(c) != found.get(c)}
        spans: list[list[int]] = []
        for c in sorted(self.table):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        self.odd = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]") if spans else None

    def split(self, text: str) -> Iterator[list[str]]:
        """Matches of ``text`` in bounded lists."""
        if self.odd is not None and not text.isascii() and self.odd.search(text):
            spans = (m.span() for m in self.pattern.finditer(text.translate(self.table)))
            pieces: Iterable[str] = (text[a:b] for a, b in spans)
        elif len(text) <= MATCHES:
            yield self.pattern.findall(text)
            return
        else:
            pieces = (m[0] for m in self.pattern.finditer(text))
        while held := list(islice(pieces, MATCHES)):
            yield held


class Encoder(dict):
    """Packed ids (little-endian, 32 bits) of pieces; short pieces are remembered."""

    def __init__(self, vocabulary: Vocabulary, splitter: Splitter):
        super().__init__()
        self.vocabulary, self.splitter = vocabulary, splitter

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.array(self.vocabulary.encode(raw.decode("latin-1")), dtype="<u4").tobytes()
        if len(raw) <= PIECE_BYTES:
            if len(self) >= PIECES_HELD:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.__getitem__, pieces)) for pieces in self.splitter.split(text))

    def decode(self, ids: bytes) -> bytes:
        if len(ids) % 4:
            raise ValueError("ids take four bytes each")
        spelling, flat = self.vocabulary.spelling, np.frombuffer(ids, dtype="<u4")
        try:
            return b"".join(b"".join(map(spelling.__getitem__, flat[lo : lo + MATCHES].tolist())) for lo in range(0, len(flat), MATCHES))
        except (IndexError, TypeError):
            raise ValueError("an id is no token") from None


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str | None = None) -> Encoder:
    """The encoder of a rank file, once for a process."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Encoder(Vocabulary(ranks), Splitter(pattern or public_tokenizers.PATTERN))


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids``: whole texts, ids as little-endian 32-bit integers. The rank file is one that every
    executor has at this path."""
    path = ranks or default_ranks()
    text_batches(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        encode = encoder(path, pattern).encode
        for batch in batches:
            ids = [encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: the bytes that ``ids`` spell."""
    path = ranks or default_ranks()
    text_batches(encoded.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        decode = encoder(path, pattern).decode
        for batch in batches:
            out = pa.array([decode(i) if i else b"" for i in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], ["doc_id", "n_tokens", "ids", "decoded"])

    src = encoded.select("doc_id", "n_tokens", "ids")
    return src.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids binary, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_documents(encode_documents(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
