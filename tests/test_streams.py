"""Streams give what SQL gives, over one file and over several that are dealt by time or at random; state takes rows in any order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from krylake.plans import catalogue
from krylake.streaming import assimilation as a
from krylake.streaming.replay import drained, resumed, staged, streamed
from tests.conftest import SF

STREAMS = sorted(n for n in catalogue.QUERIES if n.startswith("stream_"))


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """events as five files by time, and as five at random."""
    out = {}
    for how, key in (("time", "ts"), ("random", F.xxhash64("event_id"))):
        out[how] = str(tmp_path_factory.mktemp(how))
        spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(5, key).write.parquet(f"{out[how]}/events.parquet")
    return out


@pytest.mark.parametrize("name", STREAMS)
def test_streams_over_five_files(spark, duck, dealt, name):
    """The one-file result is compared in test_queries; both must be SQL's."""
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert len(want)
    got = catalogue.QUERIES[name](spark, dealt["random"]).toPandas()
    cols = sorted(got.columns)
    x, y = (d[cols].astype(str).sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert x.equals(y)


def test_stream_by_time(spark, duck, dealt):
    for name in ("stream_tumbling", "stream_views_before_purchase"):
        want, got = duck.execute(catalogue.ORACLES[name]).df(), catalogue.QUERIES[name](spark, dealt["time"]).toPandas()
        cols = sorted(got.columns)
        x, y = (d[cols].astype(str).sort_values(cols).reset_index(drop=True) for d in (got, want))
        assert x.equals(y)


def shuffled(spark, rows, ddl, seed, slices=3):
    """The rows as a stream of slices in an order that has nothing to do with their time."""
    df = spark.createDataFrame(rows, ddl)
    return streamed(spark, staged(df, F.xxhash64("event_id", F.lit(seed)), slices), df)


def test_settings_in_any_order(spark):
    """Commands and removals out of order, more commands than a setting can show, ties in nothing but the key."""
    rng = random.Random(4)
    rows = [(rng.randrange(4), e, rng.choice(["set", "set", "set", "gone"] if e < 40 else ["set"]), float(e)) for e in range(200)]
    for seed in (1, 2):
        out = drained(a.settings(shuffled(spark, rows, "shape long, event_id long, action string, value double", seed), "shape", "gone"), "update")
        got = {r["shape"]: (r["alive"], r["value"], r["n"]) for r in a.last_of(out, "shape", "alive", "value", "n").collect()}
        for shape in range(4):
            own = [(e, act, v) for s, e, act, v in rows if s == shape]
            gone = max((e for e, act, _ in own if act == "gone"), default=-1)
            left = [(e, v) for e, act, v in own if act == "set" and e > gone]
            assert got[shape] == (bool(left), max(left)[1], min(len(left), a.KEPT_COMMANDS))


def test_incidents_and_trails_in_any_order(spark):
    rng = random.Random(6)
    rows = [(k % 3, e, datetime(2024, 1, 1) + timedelta(minutes=e), rng.choice(["error"] * 5 + ["signup", "view"]), float(e)) for e, k in enumerate(rng.choices(range(3), k=150))]
    ddl = "u long, event_id long, ts timestamp, event_type string, value double"
    for seed in (1, 2):
        out = drained(a.active_incidents(shuffled(spark, rows, ddl, seed), "u", "error", "signup", 1800, "1 day"), "update")
        got = {r["u"]: r["active"] for r in a.last_of(out, "u", "active").collect()}
        trails = {r["u"]: (r["n"], r["newest"], r["mean"]) for r in a.last_of(drained(a.trails(shuffled(spark, rows, ddl, seed), "u", 10), "update"), "u", "n", "newest", "mean").collect()}
        for u in range(3):
            own = [(e, t) for w, e, _, t, _ in rows if w == u]
            newest, cleared = max(own)[0], max((e for e, t in own if t == "signup"), default=-1)
            assert got[u] == sum(t == "error" and e > cleared and e > newest - 30 for e, t in own)
            last = sorted(e for e, _ in own)[-10:]
            assert trails[u] == (10, last[-1], pytest.approx(sum(last) / 10))


def test_timers_free_the_state_of_idle_keys(spark):
    """A key without further events keeps what was told of it; its state goes once the watermark is past its incidents."""
    rows = [(1, 1, datetime(2024, 1, 1), "error")] + [(2, 2 + k, datetime(2024, 1, 3) + timedelta(days=k), "view") for k in range(6)]
    df = spark.createDataFrame(rows, "u long, event_id long, ts timestamp, event_type string")
    out = drained(a.active_incidents(streamed(spark, staged(df, F.col("ts"), 5), df), "u", "error", "signup", 3600, "1 hour"), "update")
    assert {r["u"]: r["active"] for r in a.last_of(out, "u", "active").collect()} == {1: 1, 2: 0}


def test_resumed_runs_give_each_row_once(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("k"))
    s = streamed(spark, staged(df, F.col("event_id"), 5), df)
    out = f"{tmp_path}/out"
    assert resumed(s, out, batches=2) == 1  # the second was written, but isn't recorded as done
    assert resumed(s, out) >= 4
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(1000))
