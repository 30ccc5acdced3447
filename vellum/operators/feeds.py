"""What of a notice's files is fed to a summary: tiers, budgets, plans; circuit breakers and host policies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .windows import allocated, folded

#: Budgets in characters by audience: the deeper tier is for sectors.
TIERS = {"sector": 40_000, "public": 20_000}
DEFAULT_BUDGET, RESERVE = 20_000, 800


def feed_plan(files: DataFrame, audiences: DataFrame) -> DataFrame:
    """(notice_id, name, given): characters of each file that go to the summary, in order of rank.

    All of it if it fits the notice's tier; else each file takes what is left, less a reserve for
    each file still to come. A notice without a readable file gives its body, if that is a draft.
    """
    ordered = files.groupBy("notice_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "chars"))).alias("f"))
    body = audiences.where("body_is_draft").join(ordered, "notice_id", "left_anti").select("notice_id", F.array(F.struct(F.lit(1).alias("rank"), F.lit("(body)").alias("name"), F.col("body_chars").alias("chars"))).alias("f"))
    tier = F.when(F.col("audience") == "sector", TIERS["sector"]).otherwise(DEFAULT_BUDGET)
    plan = ordered.unionByName(body).join(audiences.select("notice_id", "audience"), "notice_id", "left").withColumn("budget", tier)
    total = F.aggregate("f", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    shares = F.when(F.col("budget") == TIERS["sector"], allocated(F.col("f.chars"), TIERS["sector"], RESERVE)).otherwise(allocated(F.col("f.chars"), DEFAULT_BUDGET, RESERVE))
    given = F.when(total <= F.col("budget"), F.transform("f", lambda x: x["chars"].cast("long"))).otherwise(shares)
    return plan.select("notice_id", F.explode(F.arrays_zip(F.col("f.name").alias("name"), given.alias("given"))).alias("x")).select("notice_id", "x.*")


def circuit_broken(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Attempts of a batch with whether the circuit was open before them: after so many supply failures on end it stays open."""
    w = Window.partitionBy("batch").orderBy("seq")
    islands = attempts.withColumn("island", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.count_if(F.col("failed")).over(Window.partitionBy("batch", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    runs = islands.withColumn("run", F.when(F.col("failed"), run).otherwise(0))
    tripped = F.max((F.col("run") >= most).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("skipped", F.coalesce(tripped, F.lit(0)) == 1).drop("island", "run")


def host_policy(requests: DataFrame, gap_seconds: float = 2.0, most_refusals: int = 3) -> DataFrame:
    """(host, seq, allowed, reason): requests of a host in order; too early ones wait, and refusals on end trip the host."""

    def step(state, at, refused):
        last, refusals = state or (None, 0)
        if refusals >= most_refusals:
            return (last, refusals), (False, "tripped")
        if last is not None and at is not None and (at - last) / 1e6 < gap_seconds:
            return (last, refusals), (False, "too early")
        return (at, refusals + 1 if refused else 0), (True, None)

    def finish(batch, out):
        allowed, reasons = pa.array([a for a, _ in out], pa.bool_()), pa.array([r for _, r in out], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("seq"), allowed, reasons], names=["host", "seq", "allowed", "reason"])

    chosen = requests.select(F.col("host").cast("string"), F.col("seq").cast("long"), "at", "refused")
    return folded(chosen, "host", ["refused"], step, finish, "host string, seq long, allowed boolean, reason string")


def round_limited(work: DataFrame, most_files: int, most_notices: int) -> DataFrame:
    """What of the due files one round takes: the first notices, and of them the first files."""
    ranked = work.orderBy("fetched_at", "notice_id", "url").limit(most_files)
    w = Window.orderBy("fetched_at", "notice_id")  # over at most ``most_files`` rows
    first = ranked.groupBy("notice_id").agg(F.min("fetched_at").alias("fetched_at")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_notices)
    return ranked.join(first.select("notice_id"), "notice_id", "left_semi")
