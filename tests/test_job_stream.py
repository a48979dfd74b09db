"""The stream of a job's attempts: rate, restarts, and no item twice."""

import time
from collections import Counter

import pytest
from pyspark.errors import AnalysisException

from lakeloom.streaming import job_stream
from lakeloom.streaming.job_stream import EVENTS, Rate


@pytest.fixture
def places(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    yield {n: str(tmp_path / n) for n in ("events", "out", "checkpoint")}
    for q in spark.streams.active:
        q.stop()
    spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def add(spark, places, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(places["events"])


def log(spark, places):
    """What the sink has taken; nothing before its first file."""
    try:
        return spark.read.schema(job_stream.OUTPUT).parquet(places["out"]).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def until(spark, places, query, condition, most=90):
    end = time.time() + most
    while not condition(rows := log(spark, places)):
        assert time.time() < end, rows
        assert query.exception() is None, query.exception()
        time.sleep(0.3)
    return rows


def test_no_item_is_attempted_twice_over_restarts(spark, places):
    rate = Rate(batches=2, size=5, wait_ms=1500)
    items = [f"i{k:03}" for k in range(33)]
    add(spark, places, [(1, i, None, None) for i in items] + [(1, items[0], None, None), (2, "x", None, None), (None, "y", None, None), (1, None, None, None)])
    start = lambda: job_stream.start(spark, places["events"], places["out"], places["checkpoint"], rate=rate, every="300 milliseconds")
    attempted = lambda rows: [r.item_id for r in rows if r.job_id == 1 and r.status == "running"]

    query = start()
    rows = until(spark, places, query, lambda rows: len(attempted(rows)) >= 10)
    query.stop()
    # A window of two batches of five, and no more before the timer.
    assert len(attempted(rows)) in (10, 20) and Counter(r.batch for r in rows if r.job_id == 1) == Counter({k: 5 for k in range(len(attempted(rows)) // 5)})
    assert [r.item_id for r in rows if r.job_id == 2] == ["x"]

    # Outcomes and items that come while it is down; some are repeated, one is of an item that never ran.
    done = attempted(rows)[:4]
    add(spark, places, [(1, i, "succeeded", None) for i in done[:3]] + [(1, done[3], "failed", "gone"), (1, "never", "succeeded", None), (1, done[0], None, None), (1, "late", None, None)])
    query = start()
    until(spark, places, query, lambda rows: len(attempted(rows)) >= 20)
    query.stop()
    query = start()
    add(spark, places, [(1, done[0], "failed", "again")])
    rows = until(spark, places, query, lambda rows: len(attempted(rows)) == 34)
    time.sleep(1.5)
    query.stop()
    rows = log(spark, places)
    assert sorted(attempted(rows)) == sorted([*items, "late"])
    sizes = Counter(r.batch for r in rows if r.job_id == 1 and r.status == "running")
    assert max(sizes.values()) == 5 and sum(sizes.values()) == 34
    settled = {r.item_id: (r.status, r.error) for r in rows if r.status != "running"}
    assert settled == {**{i: ("succeeded", None) for i in done[:3]}, done[3]: ("failed", "gone")} and sum(r.status != "running" for r in rows) == 4
    states = {r.job_id: (r.attempted, r.running, r.settled, r.failed) for r in job_stream.job_states(spark.createDataFrame(rows, job_stream.OUTPUT)).collect()}
    assert states == {1: (34, 30, 4, 1), 2: (1, 1, 0, 0)}


def test_lanes_share_a_job(spark, places):
    add(spark, places, [(7, str(k), None, None) for k in range(60)])
    query = job_stream.start(spark, places["events"], places["out"], places["checkpoint"], lanes=4, rate=Rate(batches=1, size=3, wait_ms=400), every="200 milliseconds")
    rows = until(spark, places, query, lambda rows: len(rows) == 60)
    assert len({r.item_id for r in rows}) == 60 and {r.lane for r in rows} == {0, 1, 2, 3}
    assert max(Counter((r.lane, r.batch) for r in rows).values()) == 3
