import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lumenfold.llm import packing  # noqa: E402

from .helpers import awkward, prose  # noqa: E402
from .test_decontam import brute as contaminated  # noqa: E402
from .test_lines import brute as cleaned  # noqa: E402
from .test_minhash import brute as groups  # noqa: E402
from .test_minhash import edit  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("sf"))
    items = [(i, prose(rng, 4)) for i in range(6)]
    docs, labels = [(i, t, "en", "s0", None) for i, t in awkward(rng).items()], []
    for i in range(300):
        t = prose(rng, rng.randrange(4, 9))
        if i % 6 == 0:
            t = t.replace(" ", " vile ", 2).replace(" ", " rotten ", 1)
        if i % 10 == 1 and i % 6 != 1:
            t = edit(rng, docs[-1][1], 1)
        if i % 10 == 3:
            t += " " + items[i % 6][1]
        if i % 4 == 2:
            t = "Cookie notice\n" + t
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, items, labels


def test_stages_and_run(spark, tables):
    folder, items, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.source, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        kept[name] = rows
        if name == "toxicity":
            toxic = {i for i, _, t in labels if t}
            left = {r.doc_id for r in rows}
            assert not left & toxic and len({i for i, _, _ in before} - left - toxic) == 0
        elif name == "line_dedup":
            want = {i: t for i, _, _, t in cleaned(before)}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows if r.text is not None and r.n_chars is not None)
        elif name == "near_dedup":
            g = groups([(i, t) for i, _, t in before])
            assert {r.doc_id for r in rows} == {i for i in g if g[i][1] == i}
        elif name == "decontamination":
            c = contaminated([(i, t) for i, _, t in before], items)
            assert len(rows) == len(before) and any(c[i][1] for i in c)
            again = contaminated([(r.doc_id, r.text) for r in rows], items)
            text = {i: t for i, _, t in before}
            assert all(r.text == text[r.doc_id] for r in rows if not c[r.doc_id][1])
            assert sum(bool(v[1]) for v in again.values()) == 0
        else:
            ids = packing._encoder(packing.default_tokenizer())([t or "" for _, _, t in before])
            assert sum(r.length for r in rows) == sum(len(x) + 1 for x in ids)
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, kept["packing"]))


def test_each_stage_on_an_empty_table(spark, tables):
    folder, _, _ = tables
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
