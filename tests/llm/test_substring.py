import collections
import random

import numpy as np

from lumenfold.llm import substring as S

from .helpers import awkward, frame, prose, sentence


def brute(texts):
    """Which units of each document go, from all runs in a dictionary."""
    at = collections.defaultdict(list)
    units = {}
    for i, t in texts:
        u = units[i] = S.sentence_units(t) if t else []
        n = len(u)
        norm = [" ".join(t[a:b].split()) for a, b, _ in u]
        spans = set()
        for s in range(n):
            e, w = s, 0
            while e < n and (e - s < S.RUN or w < S.MIN_WORDS):
                w += u[e][2]
                e += 1
            if e - s >= S.RUN and w >= S.MIN_WORDS:
                spans.add((s, e))
            b, w = s + 1, 0
            while b > 0 and (s + 1 - b < S.RUN or w < S.MIN_WORDS):
                b -= 1
                w += u[b][2]
            if s + 1 - b >= S.RUN and w >= S.MIN_WORDS:
                spans.add((b, s + 1))
        for a, b in spans:
            at[tuple(norm[a:b])].append((i, a, b))
    gone = {i: set() for i in units}
    for places in at.values():
        for i, a, b in sorted(places)[1:]:
            gone[i] |= set(range(a, b))
    return {i: (len(units[i]), gone[i]) for i in units}


def test_units_tile_the_text():
    rng = random.Random(0)
    for t in [*(t for t in awkward(rng).values() if t), "A. B! C?\n\n D 3.5 e.g. x", ". . .", "no end", prose(rng, 30), "w " * 200]:
        u = S.sentence_units(t)
        if not t.split():
            continue
        assert u[0][0] == 0 and u[-1][1] == len(t)
        assert all(x[1] == y[0] for x, y in zip(u, u[1:]))
        assert sum(x[2] for x in u) == len(t.split()) and max(x[2] for x in u) <= S.UNIT_WORDS


def test_runs():
    first, last = S.runs(np.array([20, 1, 1, 1]))
    assert set(zip(first.tolist(), last.tolist())) == {(0, 2), (0, 3)}
    first, last = S.runs(np.array([6, 9, 6, 6, 9]))
    assert set(zip(first.tolist(), last.tolist())) == {(0, 2), (1, 3), (2, 4)}
    assert len(S.runs(np.array([5, 5, 5]))[0]) == 0
    assert len(S.runs(np.array([50, 50]))[0]) == 0
    assert len(S.runs(np.array([1, 1, 1]))[0]) == 0


def test_passages_of_just_over_fifty_words_are_found():
    """Whatever ends they have, and wherever they stand."""
    rng = random.Random(9)
    found = 0
    for turn in range(300):
        ends = turn % 3  # none; in mid-sentence; in the middle of sentences of up to 25 words
        words = lambda n: " ".join(sentence(rng, n).strip(".").lower() for _ in range(1)) if ends == 0 else " ".join(sentence(rng, rng.randrange(4, 26)) for _ in range(n)).split()  # noqa: B023, E731
        cut = lambda n: words(n) if ends == 0 else " ".join(words(n)[:n])  # noqa: B023, E731
        passage = cut(51)
        texts = [f"{cut(30)} {passage} {cut(30)}" for _ in range(2)]
        seen = []
        for t in texts:
            u = S.sentence_units(t)
            first, last = S.runs(np.array([x[2] for x in u]))
            seen.append({tuple(" ".join(t[a:b].split()) for a, b, _ in u[i : j + 1]) for i, j in zip(first, last)})
        found += bool(seen[0] & seen[1])
    assert found >= 294


def test_against_brute_force(spark):
    rng = random.Random(2)
    shared = [prose(rng, 8) for _ in range(4)] + [" ".join(w.strip(".").lower() for w in prose(rng, 10).split())]
    texts = list(awkward(rng).items())
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 6))]
        if i % 2:
            parts.append(shared[i % 5])
        parts.append(prose(rng, 3))
        texts.append((i, rng.choice([" ", "\n"]).join(p for p in parts if p)))
    texts += [(50, texts[-1][1]), (51, texts[-1][1]), (52, "Again and again we say so. " * 12)]
    got = {r.doc_id: r for r in S.dedup_substrings(frame(spark, texts)).collect()}
    want, before = brute(texts), dict(texts)
    assert len(got) == len(texts)
    for i, r in got.items():
        n, gone = want[i]
        assert (r.n_units, r.n_removed) == (n, len(gone)), i
        if not gone:
            assert r.text == before[i]
        else:
            u = S.sentence_units(before[i])
            assert r.text == "".join(before[i][a:b] for k, (a, b, _) in enumerate(u) if k not in gone)
    assert got[50].text == "" and got[51].text == ""


def test_long_passages_survive_once(spark):
    """Passages of over 50 words, also inside other sentences, are left in one document."""
    rng = random.Random(3)
    passage = " ".join(sentence(rng, 9).strip(".").lower() for _ in range(7))
    texts = {i: f"{prose(rng, 3)} {sentence(rng, 4).strip('.')} {passage} {sentence(rng, 5).lower()} {prose(rng, 3)}" for i in range(12)}
    rows = {r.doc_id: r for r in S.dedup_substrings(frame(spark, texts)).collect()}
    w = passage.split()
    for i, r in rows.items():
        windows = sum(" ".join(w[k : k + 30]) in " ".join(r.text.split()) for k in range(len(w) - 29))
        assert (windows > 0) == (i == 0)


def test_removed_spans_and_repeated_rows(spark):
    rng = random.Random(4)
    t = prose(rng, 6)
    rows = S.dedup_substrings(frame(spark, [(1, t), (2, t), (2, t), (3, None)])).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].text == t and len(by[2]) == 2 and {r.text for r in by[2]} == {""} and by[3][0].text is None
    assert [tuple(s) for s in by[2][0].removed] == [(0, len(t))]
    assert S.dedup_substrings(frame(spark, {})).count() == 0


def test_texts_of_one_id_and_null_ids_are_documents(spark):
    """An unrepeated text stays beside a repeated one of the same id; rows without an id are deduplicated too."""
    rng = random.Random(6)
    a, b, c = (prose(rng, 6) for _ in range(3))
    rows = S.dedup_substrings(frame(spark, [(1, a), (2, a), (2, b), (None, c), (3, c), (None, b + " " + prose(rng, 3))])).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].text == a and sorted(r.text for r in by[2]) == ["", ""]  # b stays in the row without an id, the first
    assert by[3][0].text == "" and {r.n_removed for r in by[None]} == {0}


def test_texts_are_told_apart_by_more_than_32_bits(spark):
    """Texts of one id, or of none, whose 32-bit hashes are the same: only what repeats goes."""
    rng = random.Random(21)
    base, seen, pair = prose(rng, 5), {}, None
    tails = [f"{base} tail{n}" for n in range(150_000)]
    hashes = spark.createDataFrame([(t,) for t in tails], "t string").selectExpr("t", "hash(t) as h").collect()
    for r in hashes:
        if r.h in seen:
            pair = (seen[r.h], r.t)
            break
        seen[r.h] = r.t
    assert pair, "no collision among the texts"
    other = prose(rng, 6)
    lone = {n: f"{prose(random.Random(100 + n), 6)} {n}" for n in range(3)}
    for ids in ((1, 1), (None, None)):
        rows = [(0, "head. " + pair[0]), (ids[0], pair[0]), (ids[1], other), *((None, t) for t in lone.values())]
        out = {(r.doc_id, r.text) for r in S.dedup_substrings(frame(spark, rows)).collect()}
        assert (ids[1], other) in out and {(None, t) for t in lone.values()} <= out
        assert (ids[0], pair[0]) not in out or ids[0] is None
    # Two texts with one hash of 32 bits share their runs but for the last: neither loses its own end.
    out = [r.text for r in S.dedup_substrings(frame(spark, [(5, pair[0]), (5, pair[1])])).collect()]
    assert any(t.endswith(pair[1].rsplit(" ", 1)[1]) for t in out) and any(t.endswith(pair[0].rsplit(" ", 1)[1]) for t in out)


def test_run_hashes_have_two_parts_of_their_own():
    units = [f"unit {n}".encode() for n in range(40)]
    first, last = np.arange(0, 30), np.arange(5, 35)
    h, g = S.run_hashes(units, first, last, S.UnitHashes())
    assert len(set(h.tolist())) == len(set(g.tolist())) == 30 and not set(h.tolist()) & set(g.tolist())
    again = S.run_hashes(units[10:], first[:5], last[:5], S.UnitHashes(most=3))
    assert (again[0] == h[10:15]).all() and (again[1] == g[10:15]).all()
