"""Keyframes where a slot's centre is just a frame's cumulated motion: the last bits of the sums decide, so the SQL adds
motion frame by frame as the selection does."""

import random

import duckdb
import pytest

from lumenfold.plans import q_frames, tables


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Clips of values in tenths, few of them different: most have centres at a frame's motion. Some have several blocks of frames."""
    draw, at = random.Random(4), tmp_path_factory.mktemp("ties")
    lengths = [draw.randint(14, 90) for _ in range(400)] + [3 * q_frames._BLOCK, 2 * q_frames._BLOCK + 1, 1]
    rows = [(user, draw.randint(0, 9) / 10) for user, n in enumerate(lengths) for _ in range(n)]
    draw.shuffle(rows)
    made = spark.createDataFrame([(k, user, value) for k, (user, value) in enumerate(rows)], "event_id long, user_id long, value double")
    made.selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id % 50) as ts", "user_id", "value").repartition(1).write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{at}/events.parquet/*.parquet'")
    return str(at), con


def test_sql_adds_frame_by_frame(spark, data):
    at, con = data
    signals: dict = {}
    for r in tables.frames(spark, at).orderBy("video", "frame_idx").collect():
        signals.setdefault(r.video, []).append(r.signal)
    got = con.sql(f"WITH RECURSIVE {q_frames._ORDERED} SELECT video, i, cum_motion FROM c").df()
    totals = con.sql(f"WITH RECURSIVE {q_frames._ORDERED}, {q_frames._selection_sql(12, q_frames._ORDERED_TOTAL)} SELECT video, total FROM t").df()
    want, last = {}, {}
    for video, s in signals.items():
        total = 0.0
        for i, x in enumerate(s):
            total += abs(x - s[i - 1]) if i else 0.0
            want[video, i] = last[video] = total
    assert {(v, i): x for v, i, x in got.itertuples(index=False)} == want
    assert dict(totals.itertuples(index=False)) == last


@pytest.mark.parametrize("name", ["q02_keyframe_selection", "q02b_keyframe_selection_60", "q03_ingest_summary", "q04_keyframe_fallback"])
def test_ties_fall_alike(spark, data, name):
    at, con = data
    got = q_frames.QUERIES[name](spark, at).toPandas()
    want = con.sql(q_frames.ORACLE_SQL[name]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_job_falls_alike(spark, data):
    from jobs import registry

    at, con = data
    got = registry.job1_ingest_captures(spark, at).toPandas()
    want = con.sql(registry.JOB1_SQL).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
