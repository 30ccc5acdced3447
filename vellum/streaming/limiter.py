"""A rate limiter as a stream: windows that a client's first hit opens, and timers that evict them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VERDICTS = "client {client}, seq long, at timestamp, passed boolean, retry_ms long"


class Limiter(StatefulProcessor):
    """A client's window: when it closes, and how many hits it has let through.

    The first hit after a window's end opens the next. A timer at its end clears the window once the
    watermark has passed it, so clients that stay away leave no state behind. Hits of a micro-batch are
    taken in order of time and number; a hit older than the window that it meets counts in it.
    """

    def __init__(self, window: int, most: int):
        self.width, self.most = window, most  # in microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "closes long, n long")

    def handleInputRows(self, key, rows, timerValues):
        hits = pd.concat(list(rows)).sort_values(["us", "seq"])
        before, n = self.window.get() if self.window.exists() else (None, 0)
        closes, out = before, []
        for us in hits["us"].tolist():
            if closes is None or us >= closes:
                closes, n = us + self.width, 0
            passed = n < self.most
            n += passed
            out.append((passed, 0 if passed else -(-(closes - us) // 1000)))
        if closes != before:
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000))
            self.handle.registerTimer(-(-closes // 1000))
        self.window.update((closes, n))
        verdicts = pd.DataFrame(out, columns=["passed", "retry_ms"], index=hits.index)
        yield pd.DataFrame({"client": key[0], "seq": hits["seq"], "at": hits["at"], "passed": verdicts["passed"], "retry_ms": verdicts["retry_ms"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(hits: DataFrame, key: str, seconds: float, most: int, late: str = "0 seconds") -> DataFrame:
    """(client, seq, at, passed, retry_ms) of a stream of hits (``key``, at, seq): a verdict each, and how long to wait.

    Hits that come ``late`` behind the newest get no verdict. Without a limit (``most`` of 0 or less)
    all pass and no state is kept. Needs the RocksDB state store (see ``vellum.session``).
    """
    rows = hits.select(F.col(key).alias("client"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"))
    if most <= 0:
        return rows.select("client", "seq", "at", F.lit(True).alias("passed"), F.lit(0).cast("long").alias("retry_ms"))
    schema = VERDICTS.format(client=rows.schema["client"].dataType.simpleString())
    rows = rows.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    return rows.groupBy("client").transformWithStateInPandas(Limiter(round(seconds * 1_000_000), most), schema, "Append", "EventTime")
