"""Structured Streaming: windowed counts with late data, incremental ingest, running state a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.session import importable


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType, files: int = 100) -> DataFrame:
    """Parquet files as they come, at most files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, window: str, late: str, slide: str | None = None) -> DataFrame:
    """start, event_type, n, total of each window; events later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str, late: str) -> DataFrame:
    """user_id, start, n of each run of events less than gap apart."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


#: Times in microseconds.
_RUNS = "user_id long, first long, last long, n long, total double, first_type string, last_type string"


class _Runs(StatefulProcessor):
    """Open runs of a user: spans that grow and join as rows come in any order, given out and forgotten once no row can reach them."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # All runs of a user are one value, as each element of a list state would be a message of its own.
        self.open = handle.getValueState("open", "first array<long>, last array<long>, n array<long>, total array<double>, first_type array<string>, last_type array<string>")

    def _spans(self) -> list[tuple]:
        held = self.open.get()
        return list(zip(*held)) if held else []

    def _due(self, last: int) -> int:
        return last // 1000 + self.gap_ms + 1

    def _keep(self, spans: list[tuple]) -> None:
        """One timer for all, at the earliest end; when it goes off it gives out all that are due and sets the next."""
        if spans:
            self.open.update(tuple(list(x) for x in zip(*spans)))
            self.handle.registerTimer(min(self._due(x[1]) for x in spans))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        spans = self._spans()
        spans += [(r["us"], r["us"], 1, r["value"], r["event_type"], r["event_type"]) for r in rows]
        spans.sort(key=lambda x: (x[0], x[4]))
        out: list[tuple] = []
        for x in spans:
            if out and x[0] < out[-1][1] + 1000 * self.gap_ms:
                y = out[-1]
                last, kind = max((y[1], y[5]), (x[1], x[5]))
                out[-1] = (y[0], last, y[2] + x[2], y[3] + x[3], y[4], kind)
            else:
                out.append(x)
        self._keep(out)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        spans = self._spans()
        done = [x for x in spans if self._due(x[1]) <= now]
        left = [x for x in spans if self._due(x[1]) > now]
        if done:
            self._keep(left)
        elif left:  # the timer had been set before its run grew
            self.handle.registerTimer(min(self._due(x[1]) for x in left))
        return (Row(user_id=key[0], first=x[0], last=x[1], n=x[2], total=x[3], first_type=x[4], last_type=x[5]) for x in done)

    def close(self) -> None:
        pass


def user_runs(events: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """user_id, first, last, n, total, first_type, last_type: each run of a user's events (user_id, ts, value, event_type) less than gap_seconds apart, once the watermark has passed its end by the gap.

    Rows may come in any order within the watermark: a late one can lengthen a run or join two. A user's open runs are all the
    state there is; a user's timer gives out and drops all that have ended. Of events at one time the smallest type counts as first, the largest
    as last. Rows with a null user, time or value are left out.
    """
    importable(events.sparkSession).conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"), F.coalesce("event_type", F.lit("")).alias("event_type"))
    rows = rows.withColumn("us", F.unix_micros("ts"))
    runs = rows.withWatermark("ts", late).groupBy("user_id").transformWithState(_Runs(1000 * gap_seconds), _RUNS, "Append", "eventTime")
    return runs.withColumns({c: F.timestamp_micros(c) for c in ("first", "last")})


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a finite stream gives, appended to files at path."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingest_unseen(stream: DataFrame, table, key: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None):
    """Starts a query that adds to table (a KeyedTable) only rows whose key it hasn't; then gets the new rows of each batch.

    A batch that is run again after a failure finds its rows stored and adds nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = table.missing(df.dropDuplicates([key]))
        if new.isEmpty():
            return
        table.upsert(new)
        if then:
            then(new)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that a finite stream gives, in a memory table; for tests."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)
