"""Aggregations and reports over notices, attachments and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import PERIOD_BUCKETS, period_bucket


def flags(**conditions: Column) -> list[Column]:
    """A count per condition, in one pass."""
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Null rather than an error if there is nothing to divide by."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def agency_totals(notices: DataFrame) -> DataFrame:
    lead = F.coalesce(F.try_element_at("agencies", F.lit(1)), F.col("agency"))
    return notices.groupBy(lead.alias("agency")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agency")


def agency_months(notices: DataFrame) -> DataFrame:
    lead = F.coalesce(F.try_element_at("agencies", F.lit(1)), F.col("agency"))
    months = notices.where(F.col("published").isNotNull())
    return months.groupBy(lead.alias("agency"), F.date_format("published", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def month_matrix(notices: DataFrame, months: list[str]) -> DataFrame:
    """A row per agency with a column per month, its total, and a row of all agencies."""
    cells = [F.coalesce(F.count_if(F.date_format("published", "yyyy-MM") == m), F.lit(0)).alias("m_" + m.replace("-", "_")) for m in months]
    inside = notices.where(F.date_format("published", "yyyy-MM").isin(months))
    rows = inside.rollup("agency").agg(F.grouping("agency").alias("is_total"), *cells, F.count("*").alias("total"))
    return rows.withColumn("agency", F.when(F.col("is_total") == 1, "(all)").otherwise(F.col("agency"))).drop("is_total")


def overview(notices: DataFrame) -> DataFrame:
    return notices.agg(F.count("*").alias("n"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"))


def latest_days(clicks: DataFrame, n: int) -> DataFrame:
    return clicks.groupBy("day").agg(F.sum("clicks").alias("clicks")).orderBy(F.desc("day")).limit(n)


def period_histogram(notices: DataFrame) -> DataFrame:
    """Counts of all buckets, empty ones too."""
    bucket = period_bucket(F.col("published"), F.col("deadline"))
    counts = notices.groupBy(bucket.alias("bucket")).count().where("bucket is not null")
    names = notices.sparkSession.createDataFrame([(k, n) for k, (n, _, _) in enumerate(PERIOD_BUCKETS)], "pos int, bucket string")
    return F.broadcast(names).join(counts, "bucket", "left").select("pos", "bucket", F.coalesce("count", F.lit(0)).alias("n"))


def source_facets(notices: DataFrame, registry: DataFrame) -> DataFrame:
    """Every registered source and every source met, with counts; unregistered ones go by their id."""
    met = notices.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("n_open"), F.max("fetched_at").alias("last_fetch"))
    both = registry.withColumn("known", F.lit(True)).join(met, "source_id", "full_outer")
    return both.select("source_id", F.coalesce("name", "source_id").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_open", F.lit(0)).alias("n_open"), F.coalesce("known", F.lit(False)).alias("registered"), "last_fetch")


def attachment_report(files: DataFrame) -> DataFrame:
    """Per notice: files, the names that gave text, their characters, and counts of failures."""
    failed = F.col("status") != "ok"
    per_status = files.groupBy("notice_id", "status").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sort_array(F.collect_list("name")).alias("names"))
    return per_status.groupBy("notice_id").agg(
        F.sum("n").alias("files"),
        F.coalesce(F.first(F.when(~failed, F.col("names")), ignorenulls=True), F.array().cast("array<string>")).alias("fed"),
        F.coalesce(F.sum(F.when(~failed, F.col("chars"))), F.lit(0)).alias("chars"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(failed, F.struct("status", "n"))))).alias("failures"),
    )


def verdict(*checks: Column) -> Column:
    """The worst of several verdicts: any fail is a fail, anything but ok a warning."""
    every = F.array(*checks)
    return F.when(F.exists(every, lambda c: c == "fail"), "fail").when(F.exists(every, lambda c: c != "ok"), "warn").otherwise("ok")


def is_degraded(listed: Column, failed: Column) -> Column:
    return (listed >= 3) & (failed * 2 >= listed)


def impact_overview(items: Column, kinds: list[str], most: int = 4) -> list[Column]:
    """Counts per kind in a fixed order, the parties first met first, and how many more there are."""
    parties = F.filter(F.array_distinct(F.transform(items, lambda i: F.trim(i["party"]))), lambda p: ~p.rlike("[、,，]") & (p != ""))
    of_kind = lambda kind: F.size(F.filter(items, lambda i: i["kind"] == kind))
    counts = [of_kind(k).alias(f"n_{k}") for k in kinds]
    return [*counts, F.slice(parties, 1, most).alias("parties"), F.greatest(F.size(parties) - most, F.lit(0)).alias("more")]


def first_references(references: DataFrame) -> DataFrame:
    """(source, n_urls, n_references) of references (url, pos, source): an address goes to the source that names it first, with all its references.

    A reference without a place or a source is counted, but never the first.
    """
    named = F.when(F.col("pos").isNotNull() & F.col("source").isNotNull(), F.struct("pos", "source"))
    per = references.groupBy("url").agg(F.min_by("source", named).alias("source"), F.count("*").alias("n"))
    return per.groupBy("source").agg(F.count("*").alias("n_urls"), F.sum("n").alias("n_references"))


def model_diagnostics(calls: DataFrame) -> DataFrame:
    """Per model of calls (model, ms, listed, kept): calls, mean latency, what was dropped, and the percentage that was kept."""
    per = calls.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.sum("listed").alias("listed"), F.sum("kept").alias("kept"))
    return per.select("model", "calls", "mean_ms", (F.col("listed") - F.col("kept")).alias("dropped"), F.when(F.col("listed") > 0, F.round(100 * F.col("kept") / F.col("listed"), 2)).alias("kept_pct"))
