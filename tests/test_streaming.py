"""Batch = stream equivalence for the streaming jobs, and replayed batches."""

import datetime as dt

import __spark_entry__ as entry
from tessera.storage import scratch_path
from tessera.streaming import streams

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


CHANGE = ["event_id", "run_id", "status", "prev_status"]


def test_status_changes_stream_equals_batch(spark):
    q = entry.queries()
    assert _rows(q["str_03"](spark, SF), CHANGE) == _rows(q["mon_04"](spark, SF), CHANGE)


def test_first_result_per_key(spark):
    first = {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        first.setdefault(f"q{r.event_id // 3}", r.event_id)
    got = {r.cache_key: r.request_id for r in entry.queries()["str_02"](spark, SF).collect()}
    assert got == first


def _feed(spark, folder, rows, schema):
    """One more file of a growing table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _minute(m):
    return dt.datetime(2024, 1, 1, m // 60, m % 60, tzinfo=dt.timezone.utc)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _log(rows):
    return [(i, _minute(m), run, s) for i, m, run, s in rows]


CHANGES = [(1, "a", "x", None), (3, "a", "y", "x"), (4, "a", "x", "y"), (6, "b", "z", None), (8, "b", "w", "z")]
BATCHES = [[(1, 0, "a", "x"), (3, 20, "a", "y"), (4, 21, "a", "x")],
           [(2, 15, "a", "x"), (5, 30, "a", "x"), (6, 12, "b", "z")],
           [(7, 5, "a", "late"), (8, 50, "b", "w")]]


def test_out_of_order_batches_and_restarts(spark):
    """Each batch in a run of its own: what waits and what is remembered outlives the query."""
    root = scratch_path(spark, "status-test")
    delay, idle = dt.timedelta(minutes=10), dt.timedelta(days=1)
    for rows in BATCHES:
        _feed(spark, f"{root}/in", _log(rows), streams.LOG_ROW)
        got = streams.change_rows(_stream(spark, f"{root}/in", streams.LOG_ROW), f"{root}/out", delay, idle)
    assert {8}.isdisjoint(r.event_id for r in got.collect())   # still waits
    got = streams.change_rows(_stream(spark, f"{root}/in", streams.LOG_ROW), f"{root}/out", delay, idle, flush=True)
    _feed(spark, f"{root}/in", _log([(9, 70, "b", "w"), (10, 71, "b", "v")]), streams.LOG_ROW)
    got = streams.change_rows(_stream(spark, f"{root}/in", streams.LOG_ROW), f"{root}/out", delay, idle, flush=True)
    assert _rows(got, CHANGE) == sorted([*CHANGES, (10, "b", "v", "w")], key=repr)


def test_a_batch_that_fails_is_replayed(spark, monkeypatch):
    root = scratch_path(spark, "replay-test")
    for rows in BATCHES:
        _feed(spark, f"{root}/in", _log(rows), streams.LOG_ROW)
    sink, failed = streams.batch_sink, []

    def breaks(out):
        write = sink(out)

        def once(batch, batch_id):
            write(batch, batch_id)
            if batch_id == 2 and not failed:
                failed.append(batch_id)
                raise RuntimeError("lost after its rows were written")
        return once

    monkeypatch.setattr(streams, "batch_sink", breaks)
    args = f"{root}/out", dt.timedelta(minutes=10), dt.timedelta(days=1), True
    try:
        streams.change_rows(_stream(spark, f"{root}/in", streams.LOG_ROW), *args)
    except Exception as e:
        assert "lost after its rows were written" in str(e)
    assert failed
    got = streams.change_rows(_stream(spark, f"{root}/in", streams.LOG_ROW), *args)
    assert _rows(got, CHANGE) == sorted(CHANGES, key=repr)


def test_first_per_key_expires(spark):
    root = scratch_path(spark, "first-test")
    keep, late = dt.timedelta(minutes=30), dt.timedelta(minutes=5)
    batches = [[("k", 2, 1), ("k", 1, 0)], [("k", 3, 10), ("j", 4, 20)], [("m", 6, 60)], [("k", 5, 100), ("j", 7, 101)]]
    for rows in batches:
        _feed(spark, f"{root}/in", [(k, i, _minute(m), 0.5) for k, i, m in rows], streams.FIRST_ROW)
        got = streams.first_rows(_stream(spark, f"{root}/in", streams.FIRST_ROW), f"{root}/out", keep, late)
    assert sorted((r.cache_key, r.request_id) for r in got.collect()) == [("j", 4), ("j", 7), ("k", 1), ("k", 5), ("m", 6)]
    # what has expired is no longer held: after minute 60 only m, then k and j again
    left = spark.read.format("statestore").option("stateVarName", "seen").load(f"{root}/out/checkpoint")
    assert sorted(r.key.cache_key for r in left.select("key").collect()) == ["j", "k"]


def test_a_hot_key_is_thinned_before_it_moves(spark):
    rows = spark.range(20_000).selectExpr("'k' AS cache_key", "id AS request_id", "timestamp_seconds(1000 + id % 7) AS ts",
                                          "0.5D AS confidence")
    kept = rows.mapInArrow(streams.first_of_each, streams.FIRST_ROW)
    assert kept.count() < 100
    assert kept.selectExpr("min(struct(ts, request_id)) AS f", "max(ts) AS t").first().f.request_id == 0


def test_a_job_goes_on_where_it_stopped(spark):
    out = scratch_path(spark, "resume-test")
    a = streams.first_per_key(spark, SF, out=out).count()
    assert streams.first_per_key(spark, SF, out=out).count() == a


def test_first_per_key_takes_rows_and_asks_its_state_once_a_key():
    """A data frame and several questions for each key cost 14 ms a key."""
    from pyspark.sql import Row
    from tessera.streaming.keyed import FirstPerKey
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    class Handle(State):
        def getValueState(self, *a):
            return State()

    p = FirstPerKey(dt.timedelta(minutes=30))
    p.init(Handle())
    rows = [Row(cache_key="k", request_id=i, ts=ts, confidence=0.5)
            for i, ts in ((3, None), (2, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)))]
    assert [r.request_id for r in p.handleInputRows(("k",), iter(rows), None)] == [1]
    assert calls == ["get", "update", "registerTimer"]
    assert [r.request_id for r in p.handleInputRows(("k",), iter(rows[:1]), None)] == [3]
    assert len(calls) == 3
