import collections
import random

from pyspark.sql import functions as F

from lumenfold.llm import lines as L

from .helpers import frame, prose


def brute(rows, ratio=L.RATIO, least=L.MIN_PAGES):
    """(id, site, text) to (lines, dropped, text)."""
    strip = lambda x: x.strip(" \t\r\x0b\x0c")
    pages = collections.defaultdict(set)
    for _, s, t in rows:
        if t is not None:
            pages[s or ""].add(t)
    bad = {}
    for s, texts in pages.items():
        n = collections.Counter(x for t in texts for x in {strip(y) for y in t.split("\n")} if x)
        bad[s] = {x for x, k in n.items() if k >= least and k > ratio * len(texts)}
    out = []
    for i, s, t in rows:
        if not t:
            out.append((i, 0, 0, t))
            continue
        all_ = t.split("\n")
        keep = [x for x in all_ if strip(x) not in bad[s or ""]]
        out.append((i, len(all_), len(all_) - len(keep), "\n".join(keep) if len(keep) < len(all_) else t))
    return out


def case():
    rng = random.Random(1)
    rows = []
    for i in range(120):
        site = ["s0", "s0", "s1", None, ""][i % 5]
        parts = [prose(rng, 1) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), "  Cookie notice\t")
        if i % 10 == 0:
            parts += ["", "Cookie notice", "rare footer"]
        rows.append((i, site, "\n".join(parts)))
    rows += [(200, "s0", None), (201, "s1", ""), (202, "s0", "\n\n"), (203, "lonely", "Cookie notice"), (204, "s0", "Cookie notice")]
    rows += [(300 + k, "s1", "copied line\nanother copied line") for k in range(20)] + [rows[0], rows[0]]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = case()
    for limit in (L.BROADCAST_ROWS, 0):
        monkeypatch.setattr(L, "BROADCAST_ROWS", limit)
        docs = spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], "doc_id long, source string, text string, pages string")
        got = L.drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(brute(rows))


def test_stage_columns(spark):
    rows = case()
    docs = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = L.without_boilerplate(docs)
    assert out.columns == docs.columns
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_native_plan(spark):
    docs = frame(spark, {1: "a"})
    plan = L.drop_boilerplate(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty(spark):
    assert L.drop_boilerplate(frame(spark, {})).count() == 0


def test_host(spark):
    urls = ["http://Www.A.example/x?y", "https://b.example", "ftp://c.example#z", "no url", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(L.host_of(F.col("u")).alias("h"))
    assert [r.h for r in got.collect()] == ["www.a.example", "b.example", "c.example", "", None]


def test_by_host_of_pages(spark):
    pages = [(i, f"http://h{i % 2}.example/p{i}", f"<p>body {i}</p>\n<nav>menu {i % 2}</nav>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", L.host_of(F.col("url")))
    got = L.drop_boilerplate(df, "host", "html").collect()
    assert all(r["n_dropped"] == 1 and "menu" not in r.html and "body" in r.html for r in got)


def test_clashing_columns_stay(spark):
    docs = frame(spark, {i: f"menu\nbody {i}" for i in range(30)}).withColumnsRenamed({"key": "n_dropped", "component": "__lines", "sequence_id": "__SITE"})
    out = L.without_boilerplate(docs)
    assert out.columns == docs.columns
    assert {(r.text, r["n_dropped"], r["__lines"], r["__SITE"]) for r in out.collect()} == {(f"body {i}", "k", "c", "q") for i in range(30)}
