"""Comparison table of labelled text against a plain Python version."""

import duckdb
import pytest

from jobs import collate_results as job
from jobs import common, registry

ITEMS = "doc_id long, text string, lang string, source string, scene string, item string"
LABELS = "doc_id long, quality int, toxic int"


def rows():
    out = [(i, f"text {i % 17}", ("en", "de", "fr")[i % 3], f"s{i % 4}", "clash", "clash") for i in range(60)]
    out += [(100, None, "en", "s0", "", ""), (101, "  ", "en", None, "", ""), (None, "text 3", "de", "s1", "", ""), (None, "own", "de", "s1", "", ""), (7, "text 900", None, " ", "", "")]
    return out + [(200 + i, "hot", "en", "hot", "", "") for i in range(50)]


def labels():
    out = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)]
    return out + [(4, 0, 1), (6, None, 1), (8, None, None), (None, 1, 1), (205, 1, None), (999, 1, 0)]


def brute(items, marks, strict=False):
    """(scene, method, metric) -> (value, rank, is_total)."""
    name = lambda x: (x or "").strip(" ") or job.UNNAMED
    by = {}
    for i, good, bad in marks:
        if i is not None and (good is not None or bad is not None):
            by.setdefault(i, []).append((good, bad))
    first = {}
    for i, text, method, scene, *_ in items:
        if (text or "").strip(" "):
            place = ((i is None, i or 0), name(scene), name(method))
            first[text] = min(first.get(text, place), place)
    cells = {}
    for i, text, method, scene, *_ in items:
        c = cells.setdefault((name(scene), name(method)), [0, 0, 0, 0])
        c[0] += 1
        if i in by:
            c[1] += 1
            known = [g for g, _ in by[i] if g is not None]
            c[2] += bool(known) and all(g == 1 for g in known)
            c[3] += any(b == 1 for _, b in by[i])
    values = {}
    for (scene, method), (n, marked, good, bad) in cells.items():
        own = sum(f[1:] == (scene, method) for f in first.values()) / n
        v = {"Comp": 1 - own}
        if marked:
            acc, nc = bad / marked, good / marked
            v |= {"Acc": acc, "C-L1": (acc + 1 - own) / 2, "NC": nc, "F-score": 2 * own * nc / (own + nc) if own + nc else 0.0}
        for metric, value in v.items():
            values[scene, method, metric, False] = value
    for method in {m for _, m in cells}:
        for metric in ("Acc", "Comp", "C-L1", "NC", "F-score"):
            have = [values.get((s, m, metric, False)) for s, m in cells if m == method]
            have = [h for h in have if h is not None] if strict else [h or 0.0 for h in have]
            if have:
                values["AVG", method, metric, True] = sum(have) / len(have)
    out = {}
    for (scene, method, metric, total), value in values.items():
        better = -1 if metric in ("NC", "F-score") else 1
        order = sorted((better * round(v, 12), m) for (s, m, k, t), v in values.items() if (s, k, t) == (scene, metric, total))
        out[scene, method, metric, total] = (round(value, 9), [m for _, m in order].index(method) + 1)
    return out


def go(spark, tmp_path, items, marks, cfg=job.Config()):
    spark.createDataFrame(items, ITEMS).repartition(3).write.parquet(str(tmp_path / "items"))
    spark.createDataFrame(marks, LABELS).write.parquet(str(tmp_path / "labels"))
    out = str(tmp_path / "out")
    report = job.run(spark, str(tmp_path / "items"), str(tmp_path / "labels"), out, cfg)
    table = {(r["scene"], r["method"], r["metric"], r["is_total"]): (round(r["value"], 9), r["rank"]) for r in job.result(spark, out, cfg).collect()}
    return report, table, out


@pytest.mark.parametrize("strict, kind", [(False, "parquet"), (True, "orc"), (False, "json")])
def test_against_brute_force(spark, tmp_path, strict, kind):
    cfg = job.Config(strict=strict, output_format=kind)
    report, table, out = go(spark, tmp_path, rows(), labels(), cfg)
    assert table == brute(rows(), labels(), strict)
    assert report["items"] == len(rows()) and report["rows"] == len(table) and report["labelled"] == 31
    assert sorted(p.name for p in (tmp_path / "out" / "table").glob("method=*")) == ["method=de", "method=en", "method=fr", "method=unnamed"]
    # Again over the same input: the same, and nothing beside it.
    assert job.run(spark, str(tmp_path / "items"), str(tmp_path / "labels"), out, cfg) == report
    assert job.result(spark, out, cfg).count() == len(table)


def test_methods_that_are_gone_leave_the_output(spark, tmp_path):
    _, _, out = go(spark, tmp_path, rows(), labels())
    only = [r for r in rows() if r[2] == "en"]
    spark.createDataFrame(only, ITEMS).write.mode("overwrite").parquet(str(tmp_path / "items"))
    job.run(spark, str(tmp_path / "items"), str(tmp_path / "labels"), out)
    assert {r[0] for r in job.result(spark, out).select("method").collect()} == {"en"}


def test_empty_tables(spark, tmp_path):
    report, table, _ = go(spark, tmp_path / "a", [], labels())
    assert table == {} and report["items"] == report["cells"] == 0
    _, table, _ = go(spark, tmp_path / "b", rows(), [])
    assert table == brute(rows(), []) and {k[2] for k in table if not k[3]} == {"Comp"}


def test_expressions_of_the_config(spark, tmp_path):
    cfg = job.Config(scene="upper(lang)", method="concat('m', doc_id % 2)", good="toxic = 0", bad="quality = 0")
    moved = [(i, t, f"m{i % 2}" if i is not None else None, (lang or "").upper(), "", "") for i, t, lang, *_ in rows()]
    swapped = [(i, None if b is None else int(b == 0), None if g is None else int(g == 0)) for i, g, b in labels()]
    _, table, _ = go(spark, tmp_path, rows(), labels(), cfg)
    assert table == brute(moved, swapped)
    with pytest.raises(ValueError):
        job.Config(output_format="csv")
    assert common.load_config(spark, "jobs/collate_results.json", job.Config) == job.Config()


def test_query_and_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = registry.job2_collate_results(spark, data).toPandas()
    want = con.sql(registry.JOB2_SQL).df()[list(got.columns)]
    got, want = (sorted(map(repr, d.astype({"rank": int}).values.tolist())) for d in (got, want))
    assert got == want and len(got) > 100
