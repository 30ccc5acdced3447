"""Merging new rows into a stored snapshot; every merge gives a new snapshot and changes nothing in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rulebook import grounds_rank

def wins(new_basis: Column, old_basis: Column) -> Column:
    """Whether a new genre decision replaces an old one: its grounds are as strong, or there is no old one."""
    return old_basis.isNull() | (grounds_rank(new_basis) >= grounds_rank(old_basis))


def latest_per_key(incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the order given; a batch may bring a key more than once."""
    w = Window.partitionBy(key).orderBy(*order)
    return incoming.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upserted(stored: DataFrame, incoming: DataFrame, key: str, kept: tuple[str, ...], filled: tuple[str, ...] = (), latest: tuple[Column, ...] = ()) -> DataFrame:
    """The snapshot after ``incoming``, with an ``outcome`` per row.

    ``kept`` columns of stored rows never change; ``filled`` ones change only to something that is
    not null; all others take the incoming value. Stored keys are one row each; of incoming rows with one key the
    first in the order ``latest`` counts (without it, the first by a hash of the row).
    """
    incoming = latest_per_key(incoming, key, *(latest or (F.xxhash64(*incoming.columns),)))
    s, i = stored.alias("s"), incoming.alias("i")
    was, comes = F.col(f"s.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()
    columns = []
    for c in stored.columns:
        new, old = F.col(f"i.{c}"), F.col(f"s.{c}")
        if c == key:
            columns.append(F.coalesce(old, new).alias(c))
        elif c in kept:
            columns.append(F.when(was, old).otherwise(new).alias(c))
        elif c in filled:
            columns.append(F.coalesce(new, old).alias(c))
        else:
            columns.append(F.when(comes, new).otherwise(old).alias(c))
    outcome = F.when(was & comes, "updated").when(comes, "inserted").otherwise("unchanged")
    return s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer").select(*columns, outcome.alias("outcome"))


def overlaid(rows: DataFrame, detail: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows with the fields of their detail where it has them."""
    d = detail.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(d, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def counted(totals: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per key after the hits."""
    new = hits.groupBy(*keys).agg(F.count("*").alias("_new"))
    return totals.join(new, keys, "full_outer").select(*keys, (F.coalesce("n", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("n"))


def appended(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """State with the new rows whose key it lacks; of new rows with one key, one."""
    return state.unionByName(new.dropDuplicates(keys).join(state, keys, "left_anti").select(*state.columns))


def synced_manifest(state: DataFrame, manifest: DataFrame, now: str) -> DataFrame:
    """Attachment state after a manifest: new files are pending, seen ones refreshed, vanished ones gone.

    Only notices that the manifest speaks of are touched; blank and repeated addresses are dropped.
    """
    m = manifest.where(F.trim("url") != "").groupBy("notice_id", "url").agg(F.min("name").alias("new_name"))
    spoken = manifest.select("notice_id").distinct()
    touched = state.join(spoken, "notice_id", "left_semi")
    rest = state.join(spoken, "notice_id", "left_anti").withColumn("outcome", F.lit("untouched"))
    joined = m.join(touched, ["notice_id", "url"], "left")
    fresh = joined.select(
        "notice_id",
        "url",
        F.col("new_name").alias("name"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.lit(now).alias("last_seen"),
        F.when(F.col("status").isNull(), "inserted").otherwise("refreshed").alias("outcome"),
    )
    return fresh.unionByName(rest.select(*fresh.columns))


def patched(state: DataFrame, results: DataFrame) -> DataFrame:
    """Attachment state after results: time and attempts move only if a request was made; a good
    text is kept, with a note, when its refresh fails."""
    r = results.select("notice_id", "url", *[F.col(c).alias(f"r_{c}") for c in ("status", "text", "fetched_at")])
    j = state.join(r, ["notice_id", "url"], "left")
    has = F.col("r_status").isNotNull()
    stale = has & (F.col("r_status") != "ok") & (F.col("status") == "ok") & (F.coalesce(F.col("text"), F.lit("")) != "")
    return j.select(
        "notice_id",
        "url",
        F.when(has & ~stale, F.col("r_status")).otherwise(F.col("status")).alias("status"),
        F.when(has & ~stale, F.col("r_text")).otherwise(F.col("text")).alias("text"),
        F.coalesce("r_fetched_at", "fetched_at").alias("fetched_at"),
        (F.col("attempts") + F.when(F.col("r_fetched_at").isNotNull(), 1).otherwise(0)).alias("attempts"),
        F.when(stale, F.concat(F.lit("kept; refresh gave "), F.col("r_status"))).alias("note"),
    )


def reused_texts(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with the text parsed before for the same content, and whether they still need parsing."""
    hashed = files.withColumn("sha256", F.sha2(F.col("content"), 256))
    known = cache.dropDuplicates(["sha256"]).select("sha256", F.col("text").alias("cached"))
    return hashed.join(known, "sha256", "left").withColumn("parse", F.col("cached").isNull())


def subscription_outcome(exists: Column, confirmed: Column, unsubscribed: Column) -> Column:
    return F.when(~exists, "created").when(unsubscribed, "resubscribed").when(confirmed, "confirmed_pending").otherwise("pending_refreshed")


def backfill_report(notices: DataFrame, stored: Column, computed: Column) -> DataFrame:
    """What a recomputation would change, counted per pair of values."""
    return notices.select(stored.alias("old"), computed.alias("new")).groupBy("old", "new").agg(F.count("*").alias("n")).withColumn("changed", ~F.col("old").eqNullSafe(F.col("new")))


def backfill_totals(rows: DataFrame, stored: Column, computed: Column, skipped: Column) -> DataFrame:
    """One row: how many rows a recomputation sees, would change and leaves alone (``skipped``: decided by hand, say)."""
    changed = ~skipped & ~stored.eqNullSafe(computed)
    return rows.agg(F.count("*").alias("total"), F.count_if(changed).alias("changed"), F.count_if(skipped).alias("skipped"))


def backfill_samples(rows: DataFrame, key: str, stored: Column, computed: Column, skipped: Column, most: int = 400) -> DataFrame:
    """(key, old, new) of the first rows that a recomputation would change, for the eye."""
    return rows.where(~skipped & ~stored.eqNullSafe(computed)).orderBy(key).limit(most).select(key, stored.alias("old"), computed.alias("new"))


def guarded_delete(parents: DataFrame, doomed: Column, children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, a backup of what goes): doomed parents go only if no child names them."""
    goes = parents.where(doomed).join(children, key, "left_anti")
    return parents.join(goes.select(key), key, "left_anti"), goes


def registered(sources: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Sources with those of ``incoming`` that they lack, switched on."""
    return appended(sources, incoming.withColumn("enabled", F.lit(True)), [key])


def switched(rows: DataFrame, ids: DataFrame, flag: str, value: bool, key: str = "id") -> DataFrame:
    """``rows`` with ``flag`` set to ``value`` where ``ids`` names them; all else as it was."""
    named = ids.select(F.col(key).alias("_named")).distinct()
    return rows.join(named, F.col(key) == F.col("_named"), "left").withColumn(flag, F.when(F.col("_named").isNotNull(), F.lit(value)).otherwise(F.col(flag))).drop("_named")


def reclassified(notices: DataFrame, files: DataFrame) -> DataFrame:
    """(id, genre, grounds, outcome) after attachments came in.

    ``notices`` has id, title, genre and grounds, ``files`` notice_id, name and text; a genre changes
    only on grounds at least as strong as before.
    """
    from ..functions.rulebook import genre_decision, grounds_rank

    per = files.groupBy("notice_id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.concat_ws("\n", F.array_sort(F.collect_list("text"))).alias("texts"))
    found = notices.join(per, F.col("id") == F.col("notice_id"), "left").withColumn("d", genre_decision(F.col("title"), F.coalesce("names", F.array().cast("array<string>")), F.col("texts")))
    better = F.col("grounds").isNull() | (grounds_rank(F.col("d.grounds")) >= grounds_rank(F.col("grounds")))
    same = F.col("genre").eqNullSafe(F.col("d.genre"))
    return found.select("id", F.when(better, F.col("d.genre")).otherwise(F.col("genre")).alias("genre"), F.when(better, F.col("d.grounds")).otherwise(F.col("grounds")).alias("grounds"), F.when(~better, "kept").when(same, "same").otherwise("changed").alias("outcome"))


def backup_check(live: dict[str, DataFrame], restored: dict[str, DataFrame], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """(measure, live, restored, ok): aggregates of tables (measure -> table, column) on both sides."""
    out = None
    for name, (table, measure) in measures.items():
        sides = [side[table].agg(measure.cast("long").alias(x)) for side, x in ((live, "live"), (restored, "restored"))]
        row = sides[0].join(sides[1]).select(F.lit(name).alias("measure"), "live", "restored", F.col("live").eqNullSafe(F.col("restored")).alias("ok"))  # a row each
        out = row if out is None else out.unionByName(row)
    return out


def entries_by_hand(entries: DataFrame) -> DataFrame:
    """Entries (title, url, published, deadline) as notices with an id, normalized days and, where they can't stand, the problem."""
    from ..functions.dates import date_in
    from ..functions.text import collapsed
    from ..functions.urls import notice_id

    title, url = collapsed(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("url", F.lit("")))
    days = {c: date_in(F.col(c)) for c in ("published", "deadline")}
    unread = [(F.trim(F.coalesce(c, F.lit(""))) != "") & d.isNull() for c, d in days.items()]
    problem = F.when(title == "", "title").when(~url.rlike("(?i)^https?://[^/]"), "url").when(unread[0], "published").when(unread[1], "deadline").when(days["deadline"] < days["published"], "order")
    return entries.select(notice_id(url).alias("id"), title.alias("title"), url.alias("url"), *[d.alias(c) for c, d in days.items()], problem.alias("problem"))
