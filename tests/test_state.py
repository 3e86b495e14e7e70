"""Aging state, idempotent merges and the limiter in event order, on streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_streams import events, plain
from worksight.streaming import state as S

DAY = dt.datetime(2020, 1, 1)


@pytest.fixture
def store(spark):
    before = spark.conf.get(S.STORE[0])
    spark.conf.set(*S.STORE)
    yield spark
    spark.conf.set(S.STORE[0], before)


def fed(spark, folder, batches, schema, query):
    """Runs a query over batches of rows, one micro-batch each, with a checkpoint that outlives each run."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = query(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream
        q = stream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(180) is not False
    return spark.read.parquet(f"{folder}/out")


def test_jobs_are_checked_rest_and_are_dropped(store, tmp_path):
    day = lambda n: DAY + dt.timedelta(days=n)
    schema = "job string, bill string, final boolean, registered timestamp, paid timestamp, seen timestamp"
    other = lambda n: ("z", f"z{n}", False, None, None, day(n))  # noqa: E731  moves the watermark
    batches = [
        [("a", "1", False, day(0), None, day(0)), ("a", "2", True, day(1), day(2), day(2)), ("b", "9", False, day(0), None, day(0)), (None, "x", False, None, None, day(0))],
        [other(50)], [("a", "1", False, day(0), day(55), day(60)), other(110)], [other(400)], [other(900)],
    ]
    got = fed(store, tmp_path, batches, schema, lambda s: S.watch_jobs(s, dt.timedelta(days=30), dt.timedelta(days=300)))
    rows = sorted(map(tuple, got.filter("job <> 'z'").select("job", "action", "bills", F.datediff("at", F.lit(DAY).cast("date"))).collect()), key=lambda r: (r[0], r[3]))
    a, b = [r for r in rows if r[0] == "a"], [r for r in rows if r[0] == "b"]
    assert a[0] == ("a", "check", ["1"], 32) and a[1][1:3] == ("check", []) and a[-1][1] == "drop" and sum(r[1] == "drop" for r in a) == 1
    assert a[-1][3] >= 60 + 300 and all(r[1:3] == ("check", ["9"]) for r in b) and len(b) >= 3  # without a final bill a job never rests


def test_the_limiter_admits_in_the_order_of_events(store, tmp_path):
    rows = sorted(events(240), key=lambda r: r[2])
    r = random.Random(2)
    shuffled = [x for k in range(0, 240, 60) for x in r.sample(rows[k : k + 60], 60)]
    late = [shuffled[k] for k in range(240)]
    for k in (20, 100, 170):  # some come a batch later than they should, within the watermark
        late[k], late[k + 60] = late[k + 60], late[k]
    batches = [late[k : k + 60] for k in range(0, 240, 60)] + [[(999, "a", rows[-1][2] + dt.timedelta(hours=9))], [(1000, "b", rows[-1][2] + dt.timedelta(hours=19))]]
    got = fed(store, tmp_path, batches, "id long, client string, ts timestamp", lambda s: S.admit_in_order(s, "client", "ts", 3, 60, "id", "2 hours"))
    want = plain([*rows, (999, "a", rows[-1][2] + dt.timedelta(hours=9))], 3, 60)
    assert {x.id: x.admitted for x in got.collect()} == want


def test_replayed_batches_change_nothing(spark, tmp_path):
    at, schema = str(tmp_path / "tenders"), "nit string, n int, finished boolean, note string"
    merge = S.merge_into(at, ["nit"], "n", "finished", buckets=4)
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    read = lambda: {r.nit: (r.n, r.note) for r in S.merged_table(spark, at).collect()}
    merge(make(("a", 1, False, "pending"), ("b", 1, True, "done"), ("a", 2, False, "still"), (None, 1, True, "no key")), 0)
    assert read() == {"a": (2, "still"), "b": (1, "done")}
    merge(make(("a", 1, True, "awarded"), ("b", 9, False, "again"), ("c", 1, None, "new")), 1)
    want = {"a": (1, "awarded"), "b": (1, "done"), "c": (1, "new")}
    assert read() == want
    manifest = (tmp_path / "tenders" / "MANIFEST").read_text()
    merge(make(("a", 99, True, "replayed"), ("d", 1, True, "replayed")), 1)
    merge(make(("a", 99, True, "replayed")), 0)
    assert read() == want and (tmp_path / "tenders" / "MANIFEST").read_text() == manifest
    merge(make(), 2)
    S.vacuum(spark, at)
    assert read() == want


def test_a_failed_merge_leaves_the_former_table(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    merge = S.merge_into(at, ["nit"], "n", "finished")
    make = lambda *rows: spark.createDataFrame(list(rows), "nit string, n int, finished boolean")
    merge(make(("a", 1, False)), 0)
    with monkeypatch.context() as m:
        m.setattr(S, "commit", lambda *x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            merge(make(("a", 2, False), ("b", 1, True)), 1)
    assert [(r.nit, r.n) for r in S.merged_table(spark, at).collect()] == [("a", 1)]
    merge(make(("a", 2, False), ("b", 1, True)), 1)
    assert sorted((r.nit, r.n) for r in S.merged_table(spark, at).collect()) == [("a", 2), ("b", 1)]


def test_tenders_stream_into_the_table(spark, tmp_path):
    at, schema = str(tmp_path / "table"), "nit string, n int, finished boolean"
    for rows in ([("a", 1, False)], [("a", 2, True), ("b", 1, False)], [("a", 3, False), ("b", 2, False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(S.merge_into(at, ["nit"], "n", "finished", buckets=2))
        stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.nit, r.n) for r in S.merged_table(spark, at).collect()) == [("a", 2), ("b", 2)]
