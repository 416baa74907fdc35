"""Personal identifiers by patterns and bootstrapped contexts.

Base rules find e-mail addresses, IP addresses, card and phone numbers. They also seed a bootstrap:
the words around a known identifier are lexical patterns, and the values that stand in a pattern's
place are its instances. Spark scores the bipartite graph of patterns and instances in rounds: a
pattern's confidence for a kind is the share of its distinct instances that are known to be of the
kind, an instance's is the noisy-or of its confident patterns. Values that reach ``ACCEPT`` and
have a form the kind can have become known, which can make further patterns confident. Known
values, the seeds' among them, found in place of a base rule add spans; base spans always stay. Numbers
are compared by their digits. Candidates are tokens and runs of digit groups with single blanks between
them; parts of a run are found if they are known from elsewhere, but are no instances of a pattern.

Tables hold one row for each digit-bearing or addressed token or run, never whole texts, and a pattern of
a third of all tokens is counted with a combine before the shuffle; only confident patterns
are joined back.

Defined results: null and empty texts have no spans; spans of one kind never overlap; equal rows have
equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_batches, tidied

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3  # known distinct instances of a confident pattern
PATTERN_CONFIDENCE = 0.6
ACCEPT = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


# ---------------------------------------------------------------- base rules


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each @ has one possible local part, the run of its
    characters before it, so long runs without an @ cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 40:
            continue
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in the order of ``KINDS``."""
    if not text:
        return [[], [], [], []]
    digits = _DIGIT.search(text) is not None
    return [
        emails(text),
        ips(text) if digits else [],
        cards(text) if digits else [],
        phones(text) if digits and "+" in text else [],
    ]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, of in zip(KINDS, spans) for a, b in of)


# ---------------------------------------------------------------- contexts

_TOKEN = re.compile(r"[^\s\"'<>\[\]{}|,;=]+")
_BRACKETS = re.compile(r" ?([\"'<>\[\]{}|,;=]+)")
_MARKED = re.compile("[0-9@]")
_EDGE, _HEX_EDGE = ".,;:!?()", ".,;!?()"
_GROUP = re.compile(r"[0-9](?:[0-9().-]*[0-9])?")
RUN_DIGITS = (7, 19)  # of a phone or card number
LEAST = 5  # characters from which a token counts as an instance of a pattern even if its form allows no kind
HELD = 50_000  # occurrences in the memory of a task
LONG = 64  # characters from which a word of a pattern is held as its hash


def _shape_kinds(value: str) -> int:
    """Bit mask of the kinds that a value's form allows."""
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    mask = 0
    if "@" in value and letters >= 2:
        mask |= 1
    if letters == 0 and value.count(".") == 3 and digits >= 4 or value.count(":") >= 2 and re.fullmatch("[0-9A-Fa-f:]+", value):
        mask |= 2
    if letters == 0 and 12 <= digits <= 19:
        mask |= 4
    if letters == 0 and 7 <= digits <= 15 and re.fullmatch(r"[+0-9().-]+", value):
        mask |= 8
    return mask


#: ``_shape_kinds`` of a value of so many digits and nothing else.
_PLAIN_KINDS = [_shape_kinds("0" * n) for n in range(RUN_DIGITS[1] + 1)]


def _word(text: str) -> str:
    """A word of a pattern: without case and with digits alike; a long one as its hash."""
    word = re.sub("[0-9]", "0", text.lower())
    return word if len(word) <= LONG else hashlib.sha256(word.encode()).hexdigest()


class Contexts:
    """The lexical patterns around places of a text, from its tokens in order."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens
        self.ends, self.starts = [b for _, b in tokens], [a for a, _ in tokens]

    def left(self, k: int) -> str:
        """Token ``k`` with the brackets, quotes and separators after it."""
        a, b = self.tokens[k]
        m = _BRACKETS.match(self.text, b)
        return self.text[a:b] + (m.group(1) if m else "")

    def at(self, start: int, end: int, floor: int = 0, ceil: int | None = None) -> list[str]:
        """Patterns: two words before; one before and one after; a word before that ends in : or =. What stands
        in the place's own token before and after it, from ``floor`` to ``ceil``, is a word too."""
        k, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        left = [self.left(i) for i in range(max(0, k - 2), k)]
        if k < len(self.tokens) and self.starts[k] < start:
            own = self.text[max(floor, self.starts[k]) : start]
            left += [own] if own.strip(_EDGE) else []
        right = self.text[end : min(self.ends[j - 1], len(self.text) if ceil is None else ceil)].strip(_EDGE) if j else ""
        while j < len(self.tokens) and not right:
            right = self.text[slice(*self.tokens[j])].strip(_EDGE)
            j += 1
        names = left[-1:] if left and left[-1][-1] in ":=" else []
        left, right = [_word(w) for w in left[-2:]], _word(right)
        out = []
        if len(left) == 2:
            out.append(f"L {left[0]} {left[1]}")
        if left and right:
            out.append(f"B {left[-1]} _ {right}")
        if names:
            out.append(f"K {left[-1]}")
        return out


def occurrences(text: str, base: list[list[tuple[int, int]]]) -> Iterator[tuple[int, int, str, int, int, list[str]]]:
    """(start, end, value, seed kind or -1, mask of possible kinds, patterns) of every identifier, of every other
    token with a digit or an @ whose form allows a kind or that has ``LEAST`` characters, and of runs of digit groups
    and their parts. """
    taken = []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    around = Contexts(text, tokens)
    seeds = sorted((a, b, k) for k, spans in enumerate(base) for a, b in spans)
    done = 0
    for n, (a, b, k) in enumerate(seeds):
        value = re.sub("[^0-9]", "", text[a:b]) if k >= 2 else text[a:b].lower()
        yield a, b, value, k, 1 << k, around.at(a, b, min(done, a), seeds[n + 1][0] if n + 1 < len(seeds) else None)
        taken.append((a, b))
        done = max(done, b)
    i = 0
    run: list[tuple[int, int]] = []  # groups with a blank between them
    blank = -1  # where a blank has to be for the run to go on
    for a, b in tokens:
        if not _MARKED.search(text, a, b):
            continue
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        token = text[a:b]
        before = a
        edge = _EDGE
        if "::" in token and (bare := token.strip(_HEX_EDGE)).startswith("::") | bare.endswith("::"):
            edge = _HEX_EDGE  # two colons stand for a part of an address
        a += len(token) - len(token.lstrip(edge))
        token = token.strip(edge)
        group = _GROUP.fullmatch(token) is not None
        if not (group and run and before == blank + 1 and text[blank] == " " and text[before:a] in ("", "(")):
            yield from run_occurrences(text, run, around)
            run = []
        if group:
            run.append((a, a + len(token)))
        blank = b if text[a + len(token) : b] in ("", ")") and b < len(text) else -1
        if (mask := _shape_kinds(token)) or len(token) >= LEAST:
            value = re.sub("[^0-9]", "", token) if mask & 12 and not mask & 2 else token.lower()
            yield a, a + len(token), value, -1, mask, around.at(a, a + len(token))
    yield from run_occurrences(text, run, around)


def run_occurrences(text: str, run: list[tuple[int, int]], around: Contexts) -> Iterator[tuple[int, int, str, int, int, list[str]]]:
    """Occurrences of what can be a number of two or more successive groups, as many as the digits of a number can
    make: the whole run with its patterns, its parts without."""
    n = len(run)
    if n < 2:
        return
    groups = [text[a:b] if b - a == 1 else re.sub("[^0-9]", "", text[a:b]) for a, b in run]
    digits = "".join(groups)
    edge = [0, *accumulate(map(len, groups))]  # of the groups in ``digits``
    least, most = RUN_DIGITS
    none: list[str] = []
    for i, (a, _) in enumerate(run):
        start = edge[i]
        for j in range(max(i + 2, bisect_left(edge, start + least, i, min(n + 1, i + least + 1))), n + 1):
            count = edge[j] - start
            if count > most:
                break
            b = run[j - 1][1]
            yield a, b, digits[start : edge[j]], -1, _PLAIN_KINDS[count], around.at(a, b) if j - i == n else none


# ---------------------------------------------------------------- the operator

_OCC = "struct<start:int,end:int,value:string,seed:int,mask:int,patterns:array<string>>"
SCANNED = f"doc_id long, uid long, base array<array<struct<a:int,b:int>>>, occ array<{_OCC}>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and occurrences of every whole text: a row with the base spans, and further ones without while
    there are more than ``HELD`` occurrences."""
    import pyarrow as pa

    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    occ = pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("seed", pa.int32()), ("mask", pa.int32()), ("patterns", pa.list_(pa.string()))]
    )
    names = [f.name for f in occ]

    text_batches(docs.sparkSession)
    def run(batches) -> Iterator:
        def block(batch, rows, base, found):
            own = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(base, pa.list_(pa.list_(span))), pa.array(found, pa.list_(occ))],
                ["doc_id", "uid", "base", "occ"],
            )

        for batch in batches:
            rows, base, found, held = [], [], [], 0
            for row, text in enumerate(batch.column(2).to_pylist()):
                b = base_spans(text)
                interesting = text and (any(b) or "@" in text or _DIGIT.search(text))
                every = iter(occurrences(text, b)) if interesting else iter(())
                spans = [[{"a": x, "b": y} for x, y in k] for k in b]
                for part in chain([list(islice(every, HELD))], iter(lambda: list(islice(every, HELD)), [])):  # noqa: B023
                    rows.append(row)
                    base.append(spans)
                    found.append([dict(zip(names, o)) for o in part])
                    spans, held = None, held + len(part)
                    if held >= HELD:
                        yield block(batch, rows, base, found)
                        rows, base, found, held = [], [], [], 0
            if rows:
                yield block(batch, rows, base, found)

    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("uid"), text.alias("text"))
    return src.mapInArrow(tidied(run), SCANNED)


def bootstrap(occ: DataFrame, rounds: int | None = None, min_support: int = MIN_SUPPORT, pattern_confidence: float = PATTERN_CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """``i, kind`` of the known values, seeds or discovered by the graph's confident patterns, that occur in
    place of a base rule too. ``occ`` has a value hash ``i``, a seed kind, a mask of possible kinds and
    patterns. Rounds go on, up to ``rounds`` if given, until one accepts nothing new: patterns depend on what is
    accepted alone, and that only grows, so no further round could."""
    kinds = range(len(KINDS))
    edges = materialize(occ.select("i", F.explode("patterns").alias("pattern")).select("i", F.xxhash64("pattern").alias("p")).distinct(), "edges")
    start = occ.groupBy("i").agg(F.max("seed").alias("seed"), F.bit_or("mask").alias("mask"), (F.min("seed") < 0).alias("bare"))
    known = start.select("i", "seed", "mask", "bare", *(F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(f"c{k}") for k in kinds))
    known = materialize(known, "known")
    best = F.greatest(*(F.col(f"c{k}") for k in kinds))
    accepted = known.where(best >= accept).count()
    turn = 0
    while rounds is None or turn < rounds:
        turn += 1
        total = edges.join(known, "i").groupBy("p").agg(
            F.count(F.lit(1)).alias("n"), *(F.sum(F.when(F.col(f"c{k}") >= accept, 1).otherwise(0)).alias(f"s{k}") for k in kinds)
        )
        chance = [F.when(F.col(f"s{k}") >= min_support, F.col(f"s{k}") / (F.col("n") + 1)).otherwise(0.0) for k in kinds]
        scored = total.select("p", *(F.when(c >= pattern_confidence, c).otherwise(0.0).alias(f"q{k}") for k, c in zip(kinds, chance)))
        confident = materialize(scored.where(F.greatest(*(F.col(f"q{k}") for k in kinds)) > 0), "patterns")
        if confident.isEmpty():
            break
        votes = edges.join(confident, "p").groupBy("i").agg(
            *((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col(f"q{k}")))))).alias(f"v{k}") for k in kinds)
        )
        fits = lambda k: F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
        known = materialize(
            known.join(votes, "i", "left").select(
                "i", "seed", "mask", "bare",
                *(F.when(F.col("seed") >= 0, F.col(f"c{k}")).when(fits(k), F.greatest(f"c{k}", F.coalesce(f"v{k}", F.lit(0.0)))).otherwise(0.0).alias(f"c{k}") for k in kinds),
            ),
            "known",
        )
        before, accepted = accepted, known.where(best >= accept).count()
        if accepted == before:
            break
    kind = F.coalesce(*(F.when(F.col(f"c{k}") == best, F.lit(k)) for k in kinds))
    return known.where(F.col("bare") & (best >= accept)).select("i", kind.alias("kind"))


def outermost(spans):
    """Of spans of one kind that overlap the first, and of those the longest."""
    out: list = []
    for s in sorted(spans, key=lambda s: (s["kind"], s["start"], -s["end"])):
        if not out or out[-1]["kind"] != s["kind"] or out[-1]["end"] <= s["start"]:
            out.append(s)
    return out


def find_identifiers(docs: DataFrame) -> DataFrame:
    """``doc_id, base, extra``: spans of the base rules by kind, and those the bootstrap adds."""
    scanned = materialize(scan(docs), "scanned")
    occ = scanned.select("doc_id", "uid", F.explode("occ").alias("o")).select("doc_id", "uid", "o.*")
    occ = occ.withColumn("i", F.xxhash64("value"))
    found = materialize(bootstrap(occ), "found")
    extra = (
        occ.where("seed < 0").join(found, "i").groupBy("doc_id", "uid").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    )
    apart = F.udf(outermost, "array<struct<kind:int,start:int,end:int>>")
    extra = materialize(extra.select(F.col("doc_id").alias("__doc_id"), F.col("uid").alias("__uid"), apart("extra").alias("extra")), "extra")
    own = scanned.where("base is not null").select("doc_id", "uid", "base")
    return own.join(extra, own["doc_id"].eqNullSafe(extra["__doc_id"]) & (own["uid"] == extra["__uid"]), "left").select("doc_id", "base", "extra")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    def digest(batches) -> Iterator:
        for batch in batches:
            rows = []
            for base, extra in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [[(s["a"], s["b"]) for s in k] for k in base]
                whole = [sorted({*k, *((e["start"], e["end"]) for e in extra or () if e["kind"] == n)}) for n, k in enumerate(spans)]
                rows.append([*(len(k) for k in spans), hashlib.sha256(joined(spans).encode()).hexdigest(), joined(whole)])
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    found = find_identifiers(read(spark, sf_dir, "documents"))
    return found.mapInArrow(tidied(digest), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
