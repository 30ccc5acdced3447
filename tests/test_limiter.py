"""The limiter as a stream: the same verdicts as in batch, and windows that are evicted."""

import datetime
import random

from pyspark.sql import functions as F

from vellum.operators import windows
from vellum.streaming import limiter

SCHEMA = "client string, seq long, at timestamp"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def run(spark, tmp_path, spans, seconds, most, late="0 seconds"):
    """Verdicts, and the number of state rows after each micro-batch."""
    for k, rows in enumerate(spans):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limiter.limited(stream, "client", seconds, most, late).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    got = {(r.client, r.seq): (r.passed, r.retry_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    return got, sizes


def test_same_verdicts_as_in_batch_and_state_shrinks(spark, tmp_path):
    r = random.Random(8)
    rows = sorted(((f"c{r.randrange(12) if s < 400 else 99}", n, at(s)) for n, s in enumerate(r.randrange(0, 900) for _ in range(400))), key=lambda x: x[2])
    spans = [rows[k : k + 80] for k in range(0, len(rows), 80)]
    got, sizes = run(spark, tmp_path, spans, 50, 3)
    batch = windows.rate_limited(spark.createDataFrame(rows, SCHEMA), "client", 50, 3).collect()
    assert {k: v[0] for k, v in got.items()} == {(b.client, b.seq): b.passed for b in batch} and len(got) == 400
    assert all((wait > 0) != passed for passed, wait in got.values()) and max(w for _, w in got.values()) <= 50_000
    assert max(sizes) > sizes[-1], sizes  # clients that stayed away are gone


def test_no_limit(spark, tmp_path):
    rows = [("a", k, at(0)) for k in range(5)]
    batch = spark.createDataFrame(rows, SCHEMA)
    assert limiter.limited(batch, "client", 10, 0).where(F.col("passed")).count() == 5
    assert windows.rate_limited(batch, "client", 10, 0).where("passed").count() == 5
