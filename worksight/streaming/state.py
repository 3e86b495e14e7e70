"""State of a payment feed that ages: jobs that are looked at again until they rest, tenders that finish, and a limiter in the order of events.

Processors hold their state in the session's state store, which must be the RocksDB one; everything is in event time, so a replay gives the same. State
of a key goes when nothing can change it any more. Rows later than the watermark are dropped by Spark before they come here; rows
without a key or a time have to be left out by the caller.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from worksight.storage import commit, committed, remove

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(t: dt.datetime | None) -> int | None:
    """Milliseconds of a session's local time, as rows bring it."""
    return None if t is None else int(t.timestamp() * 1000)


class _Watch(StatefulProcessor):
    def __init__(self, again: int, idle: int):
        self.again, self.idle = again, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Newest time that the job was touched, whether a final bill of it was paid, and its next timer.
        self.job = handle.getValueState("job", "touched long, closed boolean, timer long")
        self.unpaid = handle.getMapState("unpaid", "bill string", "seen long")

    def _due(self, at: int) -> None:
        if self.job.exists():
            touched, closed, timer = self.job.get()
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            self.job.update((touched, closed, at))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        touched, closed, timer = self.job.get() if self.job.exists() else (0, False, 0)
        newest = 0
        for r in rows:
            seen = _ms(r["seen"])
            newest = max(newest, seen)
            touched = max(touched, seen, _ms(r["registered"]) or 0, _ms(r["paid"]) or 0)
            closed = closed or bool(r["final"] and r["paid"] is not None)
            if r["paid"] is None:
                self.unpaid.updateValue((r["bill"],), (seen,))
            elif self.unpaid.containsKey((r["bill"],)):
                self.unpaid.removeKey((r["bill"],))
        self.job.update((touched, closed, timer))
        self._due(max(newest, timerValues.getCurrentWatermarkInMs()) + self.again)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.job.exists():
            return
        touched, closed, _ = self.job.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        rests = closed and at - touched >= self.idle
        bills = sorted(k[0] for k in self.unpaid.keys()) if self.unpaid.exists() else []
        yield Row(job=key[0], at=dt.datetime.fromtimestamp(at / 1000), action="drop" if rests else "check", bills=[] if rests else bills)
        if rests:
            self.job.clear()
            if self.unpaid.exists():
                self.unpaid.clear()
        else:
            self.job.update((touched, closed, 0))
            self._due(max(at, timerValues.getCurrentWatermarkInMs()) + self.again)


def watch_jobs(records: DataFrame, again: dt.timedelta = dt.timedelta(days=30), idle: dt.timedelta = dt.timedelta(days=730), late: str = "7 days") -> DataFrame:
    """(job, at, action, bills): jobs to look at again, each ``again`` after it was last heard of, with its unpaid bills; a job whose final bill was paid rests once it
    wasn't touched for ``idle``, and its state is dropped.

    records: job, bill, final, registered, paid, seen (the record's time).
    """
    ms = lambda d: int(d.total_seconds() * 1000)
    timed = records.filter("job IS NOT NULL AND seen IS NOT NULL").select("job", "bill", "final", *(F.col(c).cast("timestamp").alias(c) for c in ("registered", "paid", "seen"))).withWatermark("seen", late)
    return timed.groupBy("job").transformWithState(_Watch(ms(again), ms(idle)), "job string, at timestamp, action string, bills array<string>", "append", "eventtime")


class _Limiter(StatefulProcessor):
    def __init__(self, fields: list[str], time: str, tie: str, cap: int, seconds: float, waiting: str):
        self.fields, self.time, self.tie, self.cap, self.window, self.waiting_kind = fields, time, tie, cap, int(seconds * 1_000_000), waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_kind)
        self.recent = handle.getValueState("recent", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = []
        for r in rows:
            held.append(tuple(r[f] for f in self.fields))
            # one timer a millisecond at most; it fires when the watermark has passed it
            self.handle.registerTimer(_ms(r[self.time]) + 1)
        self.waiting.appendList(held)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.waiting.exists():
            return
        passed = timerValues.getCurrentWatermarkInMs()
        at, tie = self.fields.index(self.time), self.fields.index(self.tie)
        every = list(self.waiting.get())
        ready, rest = [r for r in every if _ms(r[at]) < passed], [tuple(r) for r in every if _ms(r[at]) >= passed]
        if not ready:
            return
        times = list(self.recent.get()[0]) if self.recent.exists() else []
        for r in sorted(ready, key=lambda r: (r[at], r[tie])):
            t = round(r[at].timestamp() * 1_000_000)
            times = [x for x in times if t - x <= self.window]
            admitted = len(times) < self.cap
            if admitted:
                times.append(t)
            yield Row(**dict(zip(self.fields, r)), admitted=admitted)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        # an event that may still come is no older than the watermark
        times = [x for x in times if passed * 1000 - x <= self.window]
        if times:
            self.recent.update((times,))
        else:
            self.recent.clear()


def admit_in_order(events: DataFrame, client: str, time: str, cap: int, seconds: float, tie: str, late: str = "10 minutes") -> DataFrame:
    """events with admitted, on a stream, as admit_all gives it in batch: rows are held until the watermark has passed them and are then admitted in order of time and tie.

    A client's state is what it sent within ``late``, and the times of what was admitted within the window.
    """
    timed = events.filter(F.col(client).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    kinds = [(f.name, f.dataType.simpleString()) for f in timed.schema.fields]
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds)
    return timed.groupBy(client).transformWithState(_Limiter([n for n, _ in kinds], time, tie, cap, seconds, schema), f"{schema}, admitted boolean", "append", "eventtime")


def merge_into(at: str, keys: list[str], order: str, finished: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges batches into the table at ``at``, one row a key. A finished row stays; a pending one is replaced by a later or a finished one.

    Rows lie in buckets by a hash of their key, and a batch rewrites the buckets that it has rows for; a manifest that names each bucket's folder and the
    last batch is committed in one step. A batch that is replayed finds its number there and changes nothing, whatever part of it had been written. Ties in
    ``order`` go to the greater row, and rows with a NULL key are left out. Use as many buckets as tasks should write a full batch.
    """

    def f(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifest = json.loads(committed(spark, f"{at}/MANIFEST") or '{"batch": -1, "buckets": {}, "schema": null}')
        if number <= manifest["batch"]:
            return
        rows = batch.dropna(subset=keys).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r["__bucket"] for r in rows.select("__bucket").distinct().collect())  # at most ``buckets``
        before = [manifest["buckets"][str(b)] for b in touched if str(b) in manifest["buckets"]]
        if touched:
            every = rows
            if before:
                every = rows.unionByName(spark.read.schema(rows.schema).parquet(*sorted(set(before))).filter(F.col("__bucket").isin(touched)))
            done = F.coalesce(F.col(finished), F.lit(False))
            # a finished row is never replaced: of finished ones the first stays, of pending ones the last
            columns = F.struct(*every.columns)
            best = every.groupBy(*keys).agg(F.min_by(F.when(done, columns), F.when(done, F.struct(F.col(order), F.xxhash64(*every.columns)))).alias("first"), F.max_by(columns, F.struct(F.col(order), F.xxhash64(*every.columns))).alias("last"))
            folder = f"{at}/batch-{number}-{uuid.uuid4().hex}"
            best.select(F.coalesce("first", "last").alias("x")).select("x.*").repartition("__bucket").write.parquet(folder)
            manifest["buckets"].update({str(b): folder for b in touched})
        rows.unpersist()
        manifest |= {"batch": number, "schema": batch.schema.json()}
        commit(spark, f"{at}/MANIFEST", json.dumps(manifest))

    return f


def merged_table(spark: SparkSession, at: str) -> DataFrame:
    """The table that merge_into has committed: of each bucket what its folder holds."""
    from pyspark.sql.types import StructType

    manifest = json.loads(committed(spark, f"{at}/MANIFEST"))
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    out = spark.createDataFrame([], schema)
    by_folder: dict[str, list[int]] = {}
    for bucket, folder in manifest["buckets"].items():
        by_folder.setdefault(folder, []).append(int(bucket))
    for folder, own in by_folder.items():
        out = out.unionByName(spark.read.parquet(folder).filter(F.col("__bucket").isin(own)).drop("__bucket"))
    return out


def vacuum(spark: SparkSession, at: str) -> None:
    """Removes folders that the manifest doesn't name any more; no reader of an older manifest may be left."""
    kept = set(json.loads(committed(spark, f"{at}/MANIFEST"))["buckets"].values())
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        name = status.getPath().getName()
        if name.startswith("batch-") and f"{at}/{name}" not in kept:
            remove(spark, f"{at}/{name}")
