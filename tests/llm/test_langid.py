import random
import zlib

import numpy as np

from lumenfold.llm import langid as L

from .helpers import awkward, frame

SYLLABLES = {"aa": "ka mo ti ru shi no ha".split(), "bb": "schl ung keit ver ein ß ü".split(), "cc": "ción ado la que el ñ os".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def case(rng, n):
    langs = {i: rng.choice(list(SYLLABLES)) for i in range(n)}
    return {i: text(rng, lang, rng.choice([4, 30, 300])) for i, lang in langs.items()}, langs


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    texts, langs = case(rng, 400)
    docs = frame(spark, texts, langs=langs)
    got = L.identify(docs, L.fit(docs)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in texts if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_sees_only_text(spark):
    rng = random.Random(2)
    texts, langs = case(rng, 120)
    docs = frame(spark, texts, langs=langs)
    net = L.fit(docs)
    a = {r.doc_id: r.lang_pred for r in L.identify(docs, net).collect()}
    shuffled = frame(spark, {i + 1000: t for i, t in texts.items()}, langs={i + 1000: "zz" for i in texts}, sources={i + 1000: "s9" for i in texts})
    b = {r.doc_id - 1000: r.lang_pred for r in L.identify(shuffled, net).collect()}
    assert a == b


def test_learns_only_from_the_training_fold(spark):
    rng = random.Random(3)
    texts, langs = case(rng, 200)
    for i in texts:
        if zlib.crc32(str(i).encode()) % 4 == 2:
            langs[i] = "never"
    rows = L.training_rows(frame(spark, texts, langs=langs), 20).collect()
    assert {r.lang for r in rows} <= set(SYLLABLES)
    assert all(sum(r.lang == x for r in rows) <= 20 for x in SYLLABLES)


def test_awkward(spark):
    rng = random.Random(4)
    texts, langs = case(rng, 60)
    docs = frame(spark, [*texts.items(), *awkward(rng).items(), (0, texts[0])], langs=langs)
    got = L.identify(docs, L.fit(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts) + 10
    for i in (900, 901, 902, 906):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert all(by[i].lang_pred != "und" for i in (903, 904, 905, 907, 908))
    nothing = docs.withColumn("lang", L.F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(nothing, L.fit(nothing)).collect()} == {"und"}
    assert L.identify(frame(spark, {}), None).count() == 0


def test_tables_equal_the_network():
    rng = np.random.default_rng(5)
    net = L.train([b"abc def \xc3\xbc" * 9, b"xyz uvw 123" * 9], ["p", "q"], steps=20)
    x = rng.integers(0, L.N_CLASS, (6, 64)).astype(np.uint8)
    assert np.allclose(np.exp(L.Tables(net).log_chances(x)), L._forward(net, x)[0], atol=1e-4)


def test_gradient_is_numerically_right():
    rng = np.random.default_rng(6)
    net = L.train([b"ab", b"cd"], ["p", "q"], steps=0)
    for p in net.params():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    net.embed[0] = 0
    x, y = rng.integers(1, L.N_CLASS, (4, 20)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(L._forward(net, x)[0][np.arange(4), y]).mean()
    for p, g in zip(net.params(), L._gradients(net, x, y)):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if p is net.embed and at[0] == 0:
                continue
            keep = p[at]
            p[at] = keep + 1e-2
            up = loss()
            p[at] = keep - 1e-2
            down = loss()
            p[at] = keep
            assert abs((up - down) / 2e-2 - g[at]) < 5e-3


def test_every_language_is_learned_from(spark):
    rows = [(k, f"wort{k} text", f"l{k // 2:03}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.lang for r in L.training_rows(docs).collect()}
    assert got == {lang for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 != 2} and len(got) > 200


def test_results_against_brute_force(spark):
    """Every row from the network run window by window on the text's bytes."""
    rng = random.Random(7)
    texts, langs = case(rng, 60)
    texts |= awkward(rng)
    docs = frame(spark, [*texts.items(), (3, texts[3])], langs=langs)
    net = L.fit(docs)
    rows = L.identify(docs, net).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        raw = t.encode()
        total = np.zeros(len(net.languages))
        for a in range(0, len(raw), L.WINDOW):
            part = raw[a : a + L.WINDOW]
            x = np.zeros((1, L.WINDOW), dtype=np.uint8)
            x[0, : len(part)] = L.CLASS[np.frombuffer(part, dtype=np.uint8)]
            total += np.log(L._forward(net, x)[0][0].astype(np.float64)) * len(part)
        p = np.exp(total / len(raw))
        p /= p.sum()
        assert abs(p[net.languages.index(r.lang_pred)] - r.score) < 1e-3 and p.max() - r.score < 1e-3


def test_scripts_of_three_byte_letters_are_told_apart(spark):
    rng = random.Random(8)
    blocks = {"ka": (0x10D0, 0x10F0), "th": (0x0E01, 0x0E2E), "hi": (0x0915, 0x0939), "am": (0x1200, 0x1246)}
    texts, langs = {}, {}
    for i in range(240):
        langs[i] = rng.choice(sorted(blocks))
        texts[i] = " ".join("".join(chr(rng.randrange(*blocks[langs[i]])) for _ in range(rng.randrange(2, 7))) for _ in range(20))
    docs = frame(spark, texts, langs=langs)
    got = [r.lang_pred == langs[r.doc_id] for r in L.identify(docs, L.fit(docs)).collect() if r.held_out]
    assert len(got) > 30 and np.mean(got) > 0.97


def test_number_signs_are_no_letters():
    for text in ("²", "½ ①", "12 ³", "!?", "", "①" * 1000, "٣"):
        assert not L.has_letter(text), text
    for text in ("a", "² é", "①Z", "中", "ª"):
        assert L.has_letter(text), text
