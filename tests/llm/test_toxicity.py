import re
import random

import numpy as np

from lumenfold.llm import toxicity as T

from .helpers import awkward, frame, prose

BAD = ["vile", "rotten", "wretched", "loathsome", "gradinesh", "gradinish"]


def case(rng, n):
    texts, labels = {}, []
    for i in range(n):
        t = prose(rng, rng.randrange(3, 9)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 6)):
                t.insert(rng.randrange(len(t)), rng.choice(BAD[:4]) if rng.random() < 0.6 else "gradin" + rng.choice("abcdefgh") * 3)
        texts[i] = " ".join(t)
        labels.append((i, 1, int(toxic)))
    return texts, labels


def test_held_out(spark):
    rng = random.Random(1)
    texts, labels = case(rng, 1200)
    docs = frame(spark, texts)
    known = spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int")
    model = T.fit(docs, known)
    assert (np.diff(model.thetas) > 0).all()
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    truth = {i: t for i, _, t in labels}
    hit = [got[i]["toxic"] == bool(truth[i]) for i in range(900, 1200)]
    assert np.mean(hit) > 0.98
    assert all(0 <= r["severity"] <= T.GRADES - 1 and 0 <= r["grade"] < T.GRADES for r in got.values())
    # More words, more severity; a form never seen is known by its beginning.
    probe = {1: "plain words only", 2: "plain vile words", 3: "vile rotten wretched loathsome vile vile", 4: "some gradinzzz and gradinqqq gradinwww"}
    s = {r.doc_id: r["severity"] for r in T.score(frame(spark, probe), model).collect()}
    assert s[1] < s[2] < s[3] and s[4] > s[1] + 0.3
    stage = T.without_toxic(docs, known)
    assert stage.columns == docs.columns
    left = {r.doc_id for r in stage.collect()}
    assert all((i in left) == (not got[i]["toxic"]) for i in texts)


def test_gradient_matches_chances():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    eta = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=400)
    grades = np.digitize(eta, [-1.0, 0.5, 2.0])
    w, theta = T.fit_ordinal([(np.arange(3), row) for row in x], grades, 3, 4, l2=0.0, steps=800)
    assert np.abs(w - [2, -1, 0]).max() < 0.5 and np.abs(theta - [-1, 0.5, 2]).max() < 0.4
    m = T.Model({}, w, theta)
    tail = m.at_least(x @ w)
    for k in range(1, 4):
        assert abs(tail[:, k - 1].mean() - (grades >= k).mean()) < 0.02


def test_awkward_and_unlabelled(spark):
    rng = random.Random(2)
    docs = frame(spark, [*awkward(rng).items(), (1, "vile"), (1, "vile")]).withColumnRenamed("key", "severity")
    for labels in ([], [(900, 1, 1), (None, 0, 1), (904, 1, None)], [(904, 1, 0), (905, 1, 0)]):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert model is None
        rows = T.score(docs, model).collect()
        assert len(rows) == 11 and all(r["severity"] == 0.0 and not r["toxic"] for r in rows)
    few = T.fit(docs, spark.createDataFrame([(904, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert len(T.score(docs, few).collect()) == 11
    assert T.score(frame(spark, {}), few).count() == 0


def test_copies_do_not_teach(spark):
    """Words of one toxic text in many copies are not learned as toxic."""
    rng = random.Random(3)
    texts, labels = case(rng, 500)
    odd = "zebra quagga okapi bongo kudu"
    for k in range(40):
        texts[2000 + k] = odd + " vile rotten"
        labels.append((2000 + k, 1, 1))
    model = T.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = T.score(frame(spark, {1: odd, 2: odd + " vile rotten vile"}), model).collect()
    assert [r["toxic"] for r in sorted(got)] == [False, True]


def test_nothing_is_rejected_without_a_typical_feature(spark):
    rng = random.Random(21)
    docs = frame(spark, {i: prose(rng, 4) for i in range(40)})
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    assert T.fit(docs, labels).words == {}
    assert {r.doc_id for r in T.without_toxic(docs, labels).collect()} == set(range(40))


def test_labels_of_absent_documents_do_not_use_up_the_bound(spark):
    rng = random.Random(22)
    docs = frame(spark, {i: prose(rng, 2) + (" vile rotten" if i % 3 == 0 else "") for i in range(60)})
    rows = [(i, 1, int(i % 3 == 0)) for i in range(60)]
    labels = spark.createDataFrame(rows + [(1000 + i, 1, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    alone = T.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), fit_rows=60)
    model = T.fit(docs, labels, fit_rows=60)
    assert model is not None and model.words == alone.words and b"vile " in model.words


def test_scores_against_brute_force(spark):
    """Severity, grade, chance and decision of every text from the model's numbers, word by word."""
    import math

    rng = random.Random(31)
    texts, labels = case(rng, 400)
    texts |= awkward(rng)
    model = T.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in T.score(frame(spark, texts), model).collect():
        counts = {}
        for w in re.findall("[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), texts[r.doc_id] or "")):
            for f in {(w + " ").encode(), *(w[:k].encode() for k in T.PREFIXES if len(w) > k)}:
                if f in model.words:
                    counts[f] = counts.get(f, 0) + 1
        x = sum(model.weights[model.words[f]] * (1 + math.log(n)) for f, n in counts.items())
        tail = [1.0] + [1 / (1 + math.exp(t - x)) for t in model.thetas] + [0.0]
        each = [a - b for a, b in zip(tail, tail[1:])]
        assert abs(r.severity - sum(tail[1:])) < 1e-9 and each[r.grade] >= max(each) - 1e-12
        assert abs(r.toxic_chance - tail[1]) < 1e-9 and (r.toxic == (tail[1] >= model.cut) or abs(tail[1] - model.cut) < 1e-9)


def test_clashing_columns_stay(spark):
    rng = random.Random(32)
    texts, labels = case(rng, 200)
    docs = frame(spark, texts).withColumnsRenamed({"key": "Toxic", "component": "toxic_", "sequence_id": "severity"})
    out = T.without_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = out.collect()
    assert out.columns == docs.columns and 0 < len(rows) < len(texts) and {(r["Toxic"], r["toxic_"], r["severity"]) for r in rows} == {("k", "c", "q")}
