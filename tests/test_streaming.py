import pandas as pd

from millrace.streaming import operators as stream
from millrace.streaming.polling import PollingDataSource


def test_polling(spark, tmp_path):
    spark.dataSource.register(PollingDataSource)
    df = spark.readStream.format("polling").option("feed", "polled:feed").option("since", "10").option("polls", "3").load()
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    for _ in range(60):
        q.awaitTermination(1)
        done = [p for p in q.recentProgress if p.numInputRows]
        if len(done) >= 3:
            break
    q.stop()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [10, 11, 12, 13, 14, 15]


def test_drained_append(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00")], "k int, t string").selectExpr("k", "cast(t as timestamp) t").write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r["k"] for r in stream.drained(spark, stream.retain(df, "t", ["k"]), "append").collect()) == [1, 2]


def test_trips(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:0{k}", d) for k, d in enumerate([1.0, 2.0, 1.0, 3.0, 0.0])]
    spark.createDataFrame(rows, "v string, t string, d double").selectExpr("v", "cast(t as timestamp) t", "d").write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("v string, t timestamp, d double").parquet(str(tmp_path / "in"))
    found = stream.drained(spark, stream.trips(df, "v", "t", "d"), "append").collect()
    assert sorted((r["trip"], r["n"]) for r in found) == [(0, 2), (1, 2)]


def test_events_expire_and_late_ones_are_dropped(spark, tmp_path):
    import datetime as dt
    import os

    start = dt.datetime(2024, 1, 1)
    batches = [[(1, 1, 0), (2, 1, 2), (3, 2, 3)], [(4, 1, 7), (5, 2, 7)], [(6, 1, 0.5), (7, 2, 8.5)], [(8, 3, 20)]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(e, u, start + dt.timedelta(hours=h)) for e, u, h in rows], "event_id long, user_id long, ts timestamp")
        df.coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        for p in (tmp_path / f"in{n}").glob("*.parquet"):
            (tmp_path / "all").mkdir(exist_ok=True)
            os.utime(p, (1_700_000_000 + 10 * n,) * 2)
            p.rename(tmp_path / "all" / f"{n}.parquet")
    s = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    found = stream.drained(spark, stream.expiring(s, "user_id", "event_id", "ts", 6 * 3600 * 1000), "append", stream.ROCKS).collect()
    assert sorted(r["event"] for r in found) == [1, 2, 3, 4, 5, 7]  # 6 came too late, 8 is still held
    assert {r["event"]: r["batch"] for r in found}[1] < {r["event"]: r["batch"] for r in found}[7]
    assert all(r["expired"] - r["at"] == 6 * 3600 * 1000 for r in found) and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_a_key_of_many_events_has_one_timer():
    """State calls go with keys and batches, not with events."""
    from types import SimpleNamespace

    calls, timers = [], []

    class Value:
        now = None

        def get(self):
            calls.append("get")
            return self.now

        def update(self, value):
            calls.append("update")
            self.now = value

        def clear(self):
            self.now = None

    value = Value()
    held = stream._Retention(10)
    held.init(SimpleNamespace(getValueState=lambda *_: value, registerTimer=timers.append))
    list(held.handleInputRows(("a",), iter([pd.DataFrame({"at": range(100, 200), "event": range(100)})]), None))
    list(held.handleInputRows(("a",), iter([pd.DataFrame({"at": [300, 50], "event": [100, 101]})]), None))
    assert timers == [110, 60] and len(calls) == 4
    fired = lambda at, now: list(held.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    (out,) = fired(60, 159)
    assert sorted(out["event"]) == [*range(50), 101] and (out["expired"] == out["at"] + 10).all() and timers[2:] == [160]
    assert fired(110, 159) == [] and timers[3:] == []  # an older timer: nothing is due
    (out,) = fired(160, 400)
    assert len(out) == 51 and value.now is None
