import hashlib
import random
import re

import numpy as np
import pytest

from lumenfold.llm import decontam as D

from .helpers import awkward, frame, prose


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(texts, items):
    win = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            win.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = {}
    for i, t in texts:
        w, hit, its = words(t), set(), set()
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                if (v := win.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    its |= v
        out[i] = (len(w), sorted(hit), sorted(map(str, its)))
    return out


def test_suffix_array_and_index():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 300):
        s = rng.integers(0, 4, n)
        text = np.append(s + 1, 0)
        sa = D.suffix_array(text)
        assert list(sa) == sorted(range(n + 1), key=lambda k: list(text[k:]))
        index = D.FMIndex(s, 4, sample=5)
        for k in range(1, 5):
            p = rng.integers(1, 4, (20, k))
            lo, hi = index.find(p, np.full(20, k))
            for row, a, b in zip(p, lo, hi):
                want = [i for i in range(n - k + 1) if list(s[i : i + k]) == list(row)]
                assert sorted(index.locate(np.arange(a, b))) == want


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 37, 500)
    w = D.WaveletMatrix(s, 37)
    at = rng.integers(0, 501, 200)
    c = rng.integers(0, 37, 200)
    assert list(w.rank(c, at)) == [int((s[:a] == x).sum()) for x, a in zip(c, at)]
    assert (w.access(np.arange(500)) == s).all()


@pytest.fixture
def case():
    rng = random.Random(7)
    items = [(i, prose(rng, 4)) for i in range(12)] + [(20, "two words"), (21, None), (22, "..."), (23, prose(rng, 1)), (3, "another row of item three with a few more words in it")]
    texts = list(awkward(rng).items())
    for i in range(40):
        w = words(items[i % 12][1])
        cut = rng.randrange(0, max(1, len(w) - 9))
        piece = " ".join(w[cut : cut + rng.choice([9, 10, 14])])
        texts.append((i, prose(rng, 3) + " " + piece.upper() + "; " + prose(rng, 2) + (" Two, words" if i % 5 == 0 else "")))
    texts.append((60, (items[0][1] + " ") * 3))
    return texts, items


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_against_brute_force(spark, monkeypatch, case, block_words):
    texts, items = case
    original = D.benchmark_blocks
    monkeypatch.setattr(D, "benchmark_blocks", lambda b: original(b, block_words))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(frame(spark, texts), bench).collect()
    want = brute(texts, items)
    assert len(got) == len(texts)
    for r in got:
        hit = sorted(k for s in r["spans"] for k in range(s["start"], s["end"]))
        assert (r["n_words"], hit, list(r["items"])) == want[r["doc_id"]]


def test_removal_leaves_clean_documents(spark, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    out = D.remove_contamination(docs, bench)
    assert out.columns == docs.columns
    want, before = brute(texts, items), dict(texts)
    for r in out.collect():
        n, hit, _ = want[r.doc_id]
        if hit:
            assert words(r.text) == [w for k, w in enumerate(words(before[r.doc_id])) if k not in set(hit)] and r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = D.contamination(frame(spark, {1: "a b c"}), bench).collect()
    assert [(r.n_words, list(r.spans)) for r in rows] == [(3, [])]
    assert D.contamination(frame(spark, {}), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert D.remove_contamination(frame(spark, {1: "a"}), bench).count() == 1


def test_digest_of_no_items(spark, tmp_path):
    frame(spark, {1: "a"}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = D.op7_benchmark_decontamination(spark, str(tmp_path)).first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and not row.contaminated


def test_removal_does_not_depend_on_blocks(spark, monkeypatch):
    w = [f"w{k}" for k in range(1, 31)]
    joined = " ".join(w[14:19] + w[24:29])  # adjacent only once w20 to w24 are cut
    items = [(1, " ".join(w[:10])), (2, " ".join(w[4:14])), (3, " ".join(w[19:24])), (4, joined)]
    texts = {1: "a, " + " ".join(w[:14]) + "; b", 2: " ".join(w[14:29]), 3: "clean text", 4: None, 5: joined + " end " + " ".join(w[:10])}
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    whole = {r.doc_id: (r.text, r.n_chars) for r in D.remove_contamination(docs, bench).collect()}
    original = D.benchmark_blocks
    monkeypatch.setattr(D, "benchmark_blocks", lambda b: original(b, 1))
    assert len(list(D.benchmark_blocks(bench))) == 4
    out = D.remove_contamination(docs, bench)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == whole
    assert words(whole[1][0]) == ["a", "b"] and words(whole[2][0]) == w[14:19] + w[24:29] and words(whole[5][0]) == ["end"]


def test_items_without_an_id_hit_but_are_none(spark, monkeypatch):
    rng = random.Random(11)
    a, b = prose(rng, 3), prose(rng, 3)
    bench = spark.createDataFrame([(None, a), (7, b), (8, b)], "item_id long, text string").coalesce(1)
    docs = frame(spark, [(1, a), (2, b), (2, b), (3, None), (None, a), (4, "clean")]).withColumnsRenamed({"key": "spans", "component": "__hits", "sequence_id": "__d"})
    original = D.benchmark_blocks
    seen = []
    for n in (10**6, 1):
        monkeypatch.setattr(D, "benchmark_blocks", lambda x, n=n: original(x, n))
        got = sorted((str(r.doc_id), r.n_words, len(r.spans) > 0, list(r["items"])) for r in D.contamination(docs, bench).collect())
        out = D.remove_contamination(docs, bench)
        assert out.columns == docs.columns
        seen.append((got, sorted((str(r.doc_id), r.text is None, len(words(r.text)), r["spans"], r["__hits"], r["__d"]) for r in out.collect())))
        assert all(r[2] and r[3] == [] for r in got if r[0] in ("1", "None"))
        assert [r[3] for r in got if r[0] == "2"] == [["7", "8"]] * 2 and len(got) == 6
    assert seen[0] == seen[1]


def test_phrases_are_flat_arrays():
    p = D.Phrases([(1, "a b c d e f g h i j k"), (2, "x a"), (3, "b c d e f g h i j k"), (None, "x a"), (4, None)])
    assert p.rows.dtype == np.int32 and p.rows.shape == (3, 10) and sorted(p.lengths) == [2, 10, 10] and p.shortest == 2
    of = {tuple(w for w in r if w): set(p.items(i)) for i, r in enumerate(p.rows.tolist())}
    v = p.vocabulary
    ids = lambda t: tuple(v[w.encode()] for w in t.split())
    assert of == {ids("a b c d e f g h i j"): {"1"}, ids("b c d e f g h i j k"): {"1", "3"}, ids("x a"): {"2"}}
