"""Incremental ingest over growing folders, against a single run and a plain Python selection."""

import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F

from jobs import common, registry
from jobs import ingest_captures as job

CFG = job.Config(shards=4, target_frames=5)
DAY = dt.datetime(2024, 5, 1)


def frames(clips, start=0, count=30):
    """Rows (event_id, ts, user_id, value) with sharpness that differs from frame to frame."""
    return [(1000 * c + i, DAY + dt.timedelta(seconds=i), c, float((i * 7919 + c * 31) % 101)) for c in clips for i in range(start, start + count)]


def put(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, job.Config().schema).coalesce(1).write.mode(mode).parquet(str(path))


def places(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")


def table(spark, out):
    df = job.result(spark, out)
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def once(spark, tmp_path, name, rows, cfg=CFG):
    """Output of one run over all rows, in a folder of its own."""
    at = tmp_path / name
    put(spark, at / "in", rows)
    job.run(spark, str(at / "in"), str(at / "out"), str(at / "checkpoint"), cfg)
    return table(spark, str(at / "out"))


def test_second_run_takes_only_what_is_new(spark, tmp_path):
    source, out, state = places(tmp_path)
    old, new = frames(range(8)), frames([3], start=30) + frames([20])
    put(spark, source, old)
    assert job.run(spark, source, out, state, CFG)["frames"] == len(old)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "keyframes").rglob("*.parquet")}
    put(spark, source, new)
    second = job.run(spark, source, out, state, CFG)
    assert second["frames"] == len(new) and second["batches"] == 1 and 1 <= second["shards"] <= 2
    # Shards without new frames are not written again.
    kept = [f for f, at in before.items() if f.exists() and f.stat().st_mtime_ns == at]
    shards = lambda files: {f.parent.name for f in files}
    assert len(shards(kept)) == len(shards(before)) - second["shards"] + len(shards((tmp_path / "out" / "keyframes").rglob("*.parquet")) - shards(before))
    assert table(spark, out) == once(spark, tmp_path, "all", old + new)


def test_run_without_news_changes_nothing(spark, tmp_path):
    source, out, state = places(tmp_path)
    put(spark, source, frames(range(3)))
    job.run(spark, source, out, state, CFG)
    first = table(spark, out)
    assert job.run(spark, source, out, state, CFG) == {"batches": 0, "frames": 0, "rejected": 0, "shards": 0}
    assert table(spark, out) == first


def test_many_small_batches_give_the_same(spark, tmp_path):
    source, out, state = places(tmp_path)
    rows = frames(range(4))
    for k in range(5):
        put(spark, source, rows[k::5])
    report = job.run(spark, source, out, state, job.Config(shards=4, target_frames=5, files_per_batch=2))
    assert report["batches"] == 3 and report["frames"] == len(rows)
    assert table(spark, out) == once(spark, tmp_path, "all", rows)


def test_batch_that_failed_half_way_is_taken_again(spark, tmp_path, monkeypatch):
    source, out, state = places(tmp_path)
    old, new = frames(range(4)), frames(range(2, 6), start=30)
    put(spark, source, old)
    job.run(spark, source, out, state, CFG)
    put(spark, source, new)
    right = job.fr.ingest_summary
    monkeypatch.setattr(job.fr, "ingest_summary", lambda df: 1 / 0)  # after frames and keyframes are written
    with pytest.raises(Exception, match="division by zero"):
        job.run(spark, source, out, state, CFG)
    monkeypatch.setattr(job.fr, "ingest_summary", right)
    assert job.run(spark, source, out, state, CFG)["frames"] == len(new)
    assert table(spark, out) == once(spark, tmp_path, "all", old + new)
    assert spark.read.parquet(f"{out}/frames").count() == len(old + new)


def test_frames_that_come_again_count_once_and_the_latest_counts(spark, tmp_path):
    source, out, state = places(tmp_path)
    rows = frames([1, 2])
    put(spark, source, rows + rows[:10])
    job.run(spark, source, out, state, CFG)
    changed = [(e, t, u, v + 500) for e, t, u, v in rows[5:8]]
    put(spark, source, changed)
    job.run(spark, source, out, state, CFG)
    assert table(spark, out) == once(spark, tmp_path, "all", rows[:5] + changed + rows[8:])


def test_late_frames_change_their_clip(spark, tmp_path):
    source, out, state = places(tmp_path)
    rows = frames([1], count=40)
    put(spark, source, rows[20:])
    job.run(spark, source, out, state, CFG)
    put(spark, source, rows[:20])
    job.run(spark, source, out, state, CFG)
    assert table(spark, out) == once(spark, tmp_path, "all", rows)


def test_rows_that_cannot_be_used_are_kept_apart(spark, tmp_path):
    source, out, state = places(tmp_path)
    bad = [(None, DAY, 1, 1.0), (1, None, 1, 1.0), (2, DAY, None, 1.0), (3, DAY, 1, None), (4, DAY, 1, float("nan")), (5, DAY, 1, float("-inf"))]
    rows = frames([9])
    put(spark, source, rows + bad)
    assert job.run(spark, source, out, state, CFG) == {"batches": 1, "frames": 30, "rejected": 6, "shards": 1}
    reasons = spark.read.parquet(f"{out}/rejects").groupBy("reject").count().collect()
    assert {r[0]: r[1] for r in reasons} == {"no frame number": 1, "no time": 1, "no clip": 1, "no score": 3}
    assert table(spark, out) == once(spark, tmp_path, "good", rows)
    put(spark, source, bad)
    assert job.run(spark, source, out, state, CFG)["shards"] == 0


def test_selection_against_the_rule(spark, tmp_path):
    """Every frame near a slot's centre is listed and the sharpest taken by a sort."""
    source, out, state = places(tmp_path)
    rows = frames([1, 2, 3], count=50)
    put(spark, source, rows)
    job.run(spark, source, out, state, CFG)
    got = {}
    for r in job.result(spark, out).where("selected").collect():
        got.setdefault(r["video"], set()).add(r["i"])
    for clip in (1, 2, 3):
        values = [v for _, _, c, v in rows if c == clip]
        motion = [0.0, *(abs(b - a) for a, b in zip(values, values[1:]))]
        running = [sum(motion[: i + 1]) for i in range(len(motion))]
        want = set()
        for slot in range(5):
            middle = (slot + 0.5) * running[-1] / 5
            centre = min([i for i, m in enumerate(running) if m >= middle], default=len(values) - 1)
            near = [i for i in range(len(values)) if abs(i - centre) <= max(1, len(values) // 10)]
            want.add(sorted(near, key=lambda i: (-values[i], i))[0])
        assert got[clip] == want


def test_query_and_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{data}/events.parquet'")
    settings = dict(spark.sparkContext.getConf().getAll())
    got = registry.job1_ingest_captures(spark, data).toPandas()
    want = con.sql(registry.JOB1_SQL).df()[list(got.columns)]
    key = ["video", "event_id"]
    got, want = (d.sort_values(key).reset_index(drop=True) for d in (got, want))
    assert len(got) == 1000 and (got == want).all().all()
    assert dict(spark.sparkContext.getConf().getAll()) == settings


def test_growing_copy_of_the_given_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, out, state = places(tmp_path)
    for part in ("event_id % 3 = 1", "event_id % 3 <> 1"):
        events.where(part).select("event_id", "ts", "user_id", "value").write.mode("append").parquet(source)
        job.run(spark, source, out, state)
    whole = tmp_path / "whole"
    shutil.copy("/root/testdata/sf0.001/events.parquet", whole.with_suffix(".parquet"))
    job.run(spark, f"{whole}.par*", str(whole / "out"), str(whole / "checkpoint"))
    assert table(spark, out) == table(spark, str(whole / "out"))


def test_config(spark, tmp_path):
    assert common.load_config(spark, None, job.Config) == job.Config()
    assert common.load_config(spark, "jobs/ingest_captures.json", job.Config) == job.Config()
    for text in ('{"shard": 3}', "[1]", '{"shards": 0}', '{"columns": {"video": "a"}}'):
        path = tmp_path / "c.json"
        path.write_text(text)
        with pytest.raises(ValueError):
            common.load_config(spark, str(path), job.Config)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    source, out, state = places(tmp_path)
    put(spark, source, frames([1]))
    import lumenfold.session

    monkeypatch.setattr(lumenfold.session, "get_session", lambda *_: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    args = ["--config", "jobs/ingest_captures.json", "--input", source, "--output", out, "--checkpoint", state]
    assert common.command("t", job.Config, job.PATHS, job.run, args) == 0
    assert json.loads(capsys.readouterr().out) == {"batches": 1, "frames": 30, "rejected": 0, "shards": 1}
    assert spark.read.parquet(f"{out}/clips").select(F.sum("analysed_frames")).first()[0] == 30
