"""Event-time operators of the payment feed with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def payment_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows; events later than `late` behind the newest are dropped with the state of their window."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def first_of_key(events: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


class _Window:
    """Times of a client's admitted events that are still within the window; at most cap of them."""

    def __init__(self, cap: int, seconds: float, times: list[float] | None = None):
        self.cap, self.seconds, self.times = cap, seconds, list(times or [])

    def admit(self, t: float) -> bool:
        self.times = [x for x in self.times if t - x <= self.seconds]
        if len(self.times) >= self.cap:
            return False
        self.times.append(t)
        return True


def _seconds(times: pd.Series) -> list[float]:
    return (pd.to_datetime(times).astype("datetime64[us]").astype("int64") / 1e6).tolist()


def admit_all(events: DataFrame, client: str, time: str, cap: int, seconds: float, tie: str) -> DataFrame:
    """events with admitted, exactly: an event is admitted if fewer than cap admitted ones lie within the window before it.

    Rejected events don't count, so admission depends on earlier admissions and no window function expresses it. Clients are dealt by hash,
    sorted by time and tie in Spark, and read as a stream: a task holds one client's window, not its events.
    """
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields]

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = None, None
        for b in batches:
            out = []
            for c, t in zip(b[client], _seconds(b[time])):
                if window is None or c != now:
                    now, window = c, _Window(cap, seconds)
                out.append(window.admit(t))
            yield b.assign(admitted=out)

    return events.repartition(client).sortWithinPartitions(client, time, tie).mapInPandas(f, ", ".join([*kinds, "admitted boolean"]))


def admit(events: DataFrame, client: str, time: str, cap: int, seconds: float, idle: str = "10 minutes") -> DataFrame:
    """The same on a stream, in the order of arrival by micro-batch and of time within one; the state of clients idle for so long goes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", admitted boolean"
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def f(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(batches)).sort_values(time, kind="stable")  # one client's events of one micro-batch
        window = _Window(cap, seconds, state.get[0] if state.exists else None)
        own["admitted"] = [window.admit(t) for t in _seconds(own[time])]
        state.update((window.times,))
        state.setTimeoutDuration(wait)
        yield own

    return events.groupBy(client).applyInPandasWithState(f, schema, "recent array<double>", "append", "ProcessingTimeTimeout")
