"""Queries on rows at their boundaries and ties: the same rows from Spark and from SQL, and those that the rule names."""

import datetime

import duckdb
import pytest
from test_queries import as_rows

from sceneql.plans import registry
from sceneql.sources import tables as S


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query over shots that begin at given milliseconds with given cents, from Spark and from DuckDB."""

    def run(name, shots):
        at = datetime.datetime(2024, 1, 1)
        con = duckdb.connect()
        con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
        con.executemany("insert into events values (?, ?, 0, 'click', ?, '')", [(i, at + datetime.timedelta(microseconds=ms * 3_600_000), cents / 100) for i, (ms, cents) in enumerate(shots)])
        con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
        df = registry.queries()[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        cur = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        got, want = as_rows(df.collect(), columns), as_rows(cur.fetchall(), [names.index(c) for c in columns])
        assert got == want
        return [dict(zip(columns, r)) for r in got]

    return run


def test_a_start_at_a_whole_tenth(both):
    # 50.4 of 504 seconds; in doubles 50.4 / 504 is under a tenth
    got = both("agg_22_distribution", [(0, 0), (50_400, 0), (499_000, 0)])
    assert {r["name"]: r["n"] for r in got if r["kind"] == "bin"} == {"0": 1, "1": 1, "9": 1}


def test_a_smoothed_score_is_rounded_as_a_decimal(both):
    # the fifth's smoothed score is just under a half of the fourth place; times 10**4 it is that half
    got = both("top_4_act_reserves", [(5000 * i, c) for i, c in enumerate((7498, 4442, 5418, 2075, 720, 3726))])
    assert [r["scene_id"] for r in got] == [1, 6]


def test_rows_thirty_seconds_apart_are_within_thirty_seconds(both):
    # in doubles .577 + 30 is under 30.577
    got = both("win_10_sustained_cluster", [(0, 0), (577, 50), (600, 50), (30_577, 50)])
    assert {r["scene_id"]: r["sustained"] for r in got} == {2: True, 3: False, 4: False}


def test_a_shot_of_ten_seconds_has_three_windows(both):
    # in doubles 16.016 - 6.016 is under 10
    got = both("src_14_sharpest_frames", [(0, 0), (6016, 10), (16_016, 20)])
    assert {r["kf_index"] for r in got if r["scene_id"] == 2} == {0, 1}


@pytest.mark.parametrize("frames", [(1, 2), (2, 1)])
def test_the_first_of_two_frames_at_one_time(spark, both, frames):
    d = spark.createDataFrame([(0, f, 1.0) for f in frames], "video_id long, frame long, t double").coalesce(1)
    assert S.sample_frames(d, ["video_id"], 20.0).first().frame == 1
    got = both("src_15_sample_frames", [(0, 0), (0, 1), (0, 2), (25_000, 3), (25_000, 4)])
    assert [(r["k"], r["frame"]) for r in got] == [(0, 1), (1, 4)]


def test_equal_means_tie_whatever_their_order(both):
    # added from the left, the second story's mean is .47500000000000003, the first one's .475
    cents = [30, 75, 69, 16, 69, 16, 75, 30] + 24 * [0]
    assert [r["shot"] for r in both("sel_18_gold_shots", [(5000 * i, c) for i, c in enumerate(cents)])] == [0]


def test_tokens_are_not_broadcast(spark):
    # by the size of the file Spark would take them for small
    plan = registry.queries()["sim_5_relevance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
