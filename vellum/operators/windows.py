"""Ordered computations: chains of versions, runs of failures, budgets, rate limits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T


def longest_first(files: DataFrame, budget: int) -> DataFrame:
    """Files of a notice by length, with their rank and running total; those that begin within the budget."""
    w = Window.partitionBy("notice_id").orderBy(F.desc("chars"))
    ranked = files.withColumn("rank", F.row_number().over(w.orderBy(F.desc("chars"), "name"))).withColumn("running", F.sum("chars").over(w))
    return ranked.where(F.col("running") - F.col("chars") < budget)


def version_chain(notices: DataFrame) -> DataFrame:
    """Predecessor and number of each version of a title by an agency, in order of publication."""
    w = Window.partitionBy("title_key", "agency").orderBy(F.col("published").asc_nulls_last(), "id")
    return notices.select("id", "title_key", "agency", F.lag("id").over(w).alias("version_of"), F.row_number().over(w).alias("version_seq"))


def top_with_overflow(df: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first ``n`` of each group and how many more the group has.

    Groups are counted apart, so that the ranking may stop at ``n`` rows of a group before the shuffle.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)
    more = df.groupBy(F.col(key).alias("_key")).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return ranked.join(more, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def failure_runs(log: DataFrame, key: str = "source_id", alert_at: int = 2, repeat: int = 7) -> DataFrame:
    """Length of the run of failures up to each entry; unhealthy and alerting states.

    ``log`` has the key, at, seq and ok; an alert comes with the second failure and every seventh after it.
    """
    w = Window.partitionBy(key).orderBy("at", "seq")
    islands = log.withColumn("island", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = F.count_if(~F.col("ok")).over(Window.partitionBy(key, "island").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0))
    runs = islands.withColumn("failures", F.when(F.col("ok"), 0).otherwise(in_run))
    return runs.withColumn("unhealthy", F.col("failures") >= alert_at).withColumn("alert", (F.col("failures") >= alert_at) & ((F.col("failures") - alert_at) % repeat == 0)).drop("island")


def folded(rows: DataFrame, key: str, columns: list[str], step, finish, schema) -> DataFrame:
    """Rows of each key folded in order of ``at`` and ``seq``, null ones last.

    ``step`` takes the key's state (None at first), the time in microseconds and the values of
    ``columns``, and gives the new state and a result; ``finish`` makes a batch's rows of the batch and
    its results. Only the last key's state goes on from batch to batch, however many rows a key has.
    """

    def micros(at: pa.Array) -> list[int | None]:
        return at.cast(pa.timestamp("us", getattr(at.type, "tz", None))).cast(pa.int64()).to_pylist()

    def run(it):
        last, state, begun = None, None, False
        for batch in it:
            out = []
            for k, *values in zip(batch.column(key).to_pylist(), micros(batch.column("at")), *(batch.column(c).to_pylist() for c in columns)):
                if not begun or not (k == last or (k != k and last != last)):
                    last, state, begun = k, None, True
                state, result = step(state, *values)
                out.append(result)
            yield finish(batch, out)

    dealt = rows.repartition(F.col(key)).sortWithinPartitions(F.col(key), F.col("at").asc_nulls_last(), F.col("seq").asc_nulls_last())
    return dealt.mapInArrow(run, schema)


def rate_limited(hits: DataFrame, key: str, seconds: float, most: int) -> DataFrame:
    """Whether each hit passes a limiter whose window opens with a client's first hit after the last one closed.

    A client's hits are folded in order of time; its state is the window's start and a count. A limit of
    0 or less lets all pass. One task folds a client's hits, as each verdict hangs on the one before.
    """

    def step(state, at):
        start, n = state or (at, 0)
        if start is not None and at is not None and (at - start) / 1e6 >= seconds:
            start, n = at, 0
        return (start, n + 1), most <= 0 or n < most

    def finish(batch, passed):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(passed, pa.bool_())], names=[*batch.schema.names, "passed"])

    schema = T.StructType([*hits.schema.fields, T.StructField("passed", T.BooleanType())])
    return folded(hits, key, [], step, finish, schema)


def allocated(wanted, budget: int, reserve: int):
    """Shares of a budget for wants in order, as a column: each may take what is left, less a reserve for each to come."""
    from pyspark.sql import Column

    assert isinstance(wanted, Column)
    n = F.size(wanted)
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(0).alias("k"), F.array().cast("array<bigint>").alias("given"))

    def step(s, want):
        to_come = n - s["k"] - 1
        share = F.least(want.cast("long"), F.greatest(s["left"] - to_come * reserve, F.lit(0).cast("long")))
        return F.struct((s["left"] - share).alias("left"), (s["k"] + 1).alias("k"), F.array_append(s["given"], share).alias("given"))

    return F.aggregate(wanted, start, step, lambda s: s["given"])
