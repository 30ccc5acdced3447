"""Structured Streaming: daily rollups, deduplication, windows, runs of failures, indexes kept up to date."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import ZONE

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int = 1) -> DataFrame:
    """Events of Parquet files as they come; event time as a timestamp with the session's zone."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, key: str, zone: str = ZONE, late: str = "1 day") -> DataFrame:
    """Counts per key and day of the zone; a day closes once the watermark has passed it."""
    local = events.withWatermark("ts", late).withColumn("day_start", F.window("ts", "1 day", startTime="16 hours" if zone == ZONE else "0 hours"))
    return local.groupBy("day_start", key).agg(F.count("*").alias("n")).select(F.to_date(F.from_utc_timestamp("day_start.start", zone)).alias("day"), key, "n")


def once_per_key(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sliding_counts(events: DataFrame, key: str, size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


class FailureRuns(StatefulProcessor):
    """Length of a key's run of failures; alerts at the second and every seventh after it.

    Within a micro-batch a key's rows are ordered by event time; across batches by arrival.
    """

    ALERT_AT, REPEAT = 2, 7

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "failures int")

    def handleInputRows(self, key, rows, timerValues):
        n = self.run.get()[0] if self.run.exists() else 0
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(pdf["event_id"], pdf["event_type"]):
            n = n + 1 if kind == "error" else 0
            out.append((key[0], event_id, n, n >= self.ALERT_AT and (n - self.ALERT_AT) % self.REPEAT == 0))
        self.run.update((n,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "failures", "alert"])

    def close(self) -> None:
        pass


def failure_runs(events: DataFrame) -> DataFrame:
    """Needs the RocksDB state store (see ``vellum.session``)."""
    return events.groupBy("user_id").transformWithStateInPandas(FailureRuns(), "user_id long, event_id long, failures int, alert boolean", "Append", "None")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, run through the stream once into a Parquet folder and read back."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def drained_complete(stream: DataFrame, folder: str) -> DataFrame:
    """The last complete result of an aggregation, each micro-batch in place of the one before."""
    path = f"{folder}/out"
    query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def send_then_mark(send, sent_path: str):
    """A batch writer for ``foreachBatch``: what isn't marked is sent, and marked only after that."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], batch.schema).write.mode("append").parquet(sent_path)  # so that it can be read
        sent = spark.read.schema(batch.schema).parquet(sent_path)
        new = batch.dropDuplicates().join(sent, batch.columns, "left_anti").persist()
        send(new)
        new.write.mode("append").parquet(sent_path)
        new.unpersist()

    return run
