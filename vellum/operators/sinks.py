"""Documents that readers and programs take from the notices: feeds, site maps, linked data, e-mails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import top_with_overflow

#: The most items of a feed, and of an e-mail; the most characters of a snippet, and of a reported error.
FEED_ITEMS, MAIL_ITEMS, SNIPPET, ERROR_TEXT = 200, 20, 120, 600
CONTEXT = "https://schema.org"


def escaped_xml(text: Column) -> Column:
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), marks, text)


def feed_day(day: Column) -> Column:
    """A day as feeds write it, at midnight of the prime meridian."""
    return F.date_format(day, "EEE, dd MMM yyyy '00:00:00 GMT'")


def snippet(text: Column, most: int = SNIPPET) -> Column:
    text = F.nullif(F.trim(text), F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("……"))).otherwise(text)


def _element(name: str, value: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"      <{name}{attributes}>"), escaped_xml(value), F.lit(f"</{name}>"))


def feed_items(notices: DataFrame, site: str, most: int = FEED_ITEMS) -> DataFrame:
    """(place, id, item): the newest notices as feed items; those without a day come last and bear none."""
    newest = notices.orderBy(F.desc_nulls_last("published"), "id").limit(most)
    key, link = F.col("id").cast("string"), F.concat(F.lit(site.rstrip("/") + "/notices/"), F.col("id").cast("string"))
    told = F.concat_ws("; ", F.concat(F.lit("By "), F.nullif("agency", F.lit(""))), F.concat(F.lit("Until "), F.col("deadline").cast("string")), F.concat(F.lit("Summary: "), snippet(F.col("summary"))), F.concat(F.lit("Source: "), link))
    day = F.concat(F.lit("      <pubDate>"), feed_day(F.col("published")), F.lit("</pubDate>"))
    lines = [F.lit("    <item>"), _element("title", F.col("title")), _element("link", link), _element("guid", key, ' isPermaLink="false"'), day, _element("description", told), F.lit("    </item>")]
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("published"), "id"))  # of ``most`` rows
    return newest.select(place.alias("place"), "id", F.concat_ws("\n", *lines).alias("item"))


def feed(notices: DataFrame, site: str, title: str, about: str, built: str, most: int = FEED_ITEMS, language: str = "zh-cn", label: str = "", own: str = "") -> DataFrame:
    """One row: the whole feed. ``built`` is the time of building, as feeds write it.

    ``label`` tells what the notices are filtered by, ``own`` is the feed's own address.
    """
    base = site.rstrip("/")
    if label:
        title, about = f"{title}: {label}", f"{about} ({label})"
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom">', "  <channel>"]
    told = [F.concat(F.lit(f"    <{n}>"), escaped_xml(F.lit(v)), F.lit(f"</{n}>")) for n, v in (("title", title), ("link", base + "/"), ("description", about), ("language", language), ("lastBuildDate", built))]
    told.append(F.concat(F.lit('    <atom:link href="'), escaped_xml(F.lit(own or base + "/feed.xml")), F.lit('" rel="self" type="application/rss+xml" />')))
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"])
    return feed_items(notices, site, most).agg(F.concat_ws("\n", *map(F.lit, head), *told, F.concat_ws("\n", items), F.lit("  </channel>"), F.lit("</rss>"), F.lit("")).alias("xml"))


def sitemap(notices: DataFrame, site: str, pages: tuple[tuple[str, str, float], ...] = (("/", "daily", 1.0), ("/stats", "daily", 0.5))) -> DataFrame:
    """(url, last_modified, change, priority): fixed pages and a row per notice, changed when published, else when fetched."""
    base = site.rstrip("/")
    own = notices.select(
        F.concat(F.lit(base + "/notices/"), F.col("id").cast("string")).alias("url"),
        F.coalesce(F.col("published").cast("string"), F.col("fetched_at").cast("string")).alias("last_modified"),
        F.lit("weekly").alias("change"),
        F.lit(0.7).alias("priority"),
    )
    fixed = notices.sparkSession.createDataFrame([(base + p, None, c, x) for p, c, x in pages], own.schema)
    return fixed.unionByName(own)


def safe_json(document: Column) -> Column:
    """JSON that may stand in a page: no sign in it opens a tag."""
    return F.replace(F.to_json(document), F.lit("<"), F.lit("\\u003c"))


def linked_data(notices: DataFrame, site: str, publisher: str) -> DataFrame:
    """(id, document): a notice as linked data; what it lacks is left out."""
    of = lambda kind, name: F.struct(F.lit(kind).alias("@type"), name.alias("name"))
    day = F.col("deadline").cast("string")
    document = F.struct(
        F.lit(CONTEXT).alias("@context"),
        F.lit("Article").alias("@type"),
        F.col("title").alias("headline"),
        F.concat(F.lit(site.rstrip("/") + "/notices/"), F.col("id").cast("string")).alias("url"),
        F.col("status").alias("creativeWorkStatus"),
        of("Organization", F.lit(publisher)).alias("publisher"),
        F.col("published").cast("string").alias("datePublished"),
        F.when(F.col("agency") != "", of("Organization", F.col("agency"))).alias("author"),
        day.alias("expires"),
        F.nullif(F.array_join("tags", ","), F.lit("")).alias("keywords"),
        F.when(day.isNotNull(), F.array(F.struct(F.lit("PropertyValue").alias("@type"), F.lit("deadline").alias("name"), day.alias("value")))).alias("additionalProperty"),
    )
    return notices.select("id", safe_json(document).alias("document"))


def linked_list(page: DataFrame, site: str, total: Column, start: int = 1) -> DataFrame:
    """One row: a page of a list (place from 1, id, title) as linked data, its places counted from ``start``."""
    item = F.struct(F.lit("ListItem").alias("@type"), (F.col("place") + start - 1).alias("position"), F.concat(F.lit(site.rstrip("/") + "/notices/"), F.col("id").cast("string")).alias("url"), F.col("title").alias("name"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"])
    return page.agg(safe_json(F.struct(F.lit(CONTEXT).alias("@context"), F.lit("ItemList").alias("@type"), F.max(total).alias("numberOfItems"), items.alias("itemListElement"))).alias("document"))


def digests(due: DataFrame, what: str, most: int = MAIL_ITEMS, totals: DataFrame | None = None) -> DataFrame:
    """(subscription_id, n, overflow, subject, body): one e-mail per subscription.

    ``due`` has subscription_id, id, title, deadline and days; the nearest deadlines come first, and
    what is over ``most`` is counted and left for the next e-mail. With ``totals`` (subscription_id, total),
    ``due`` may hold the first ``most`` of each alone.
    """
    listed = top_with_overflow(due, "subscription_id", most, "days", "id")
    if totals is not None:
        listed = listed.drop("more").join(totals.select("subscription_id", F.greatest(F.col("total") - most, F.lit(0)).alias("more")), "subscription_id")
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.coalesce(F.col("deadline").cast("string"), F.lit("no deadline")), F.lit(")"))
    first = F.min(F.struct("rank", "title", "days"))
    mails = listed.groupBy("subscription_id").agg(F.count("*").alias("n"), F.max("more").alias("overflow"), first.alias("first"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    subject = F.when(F.col("n") == 1, F.concat(F.lit(f"{what}: "), F.col("first.title"))).otherwise(F.concat(F.lit(f"{what}: "), F.col("n").cast("string"), F.lit(" notices, the first in "), F.col("first.days").cast("string"), F.lit(" days")))
    note = F.when(F.col("overflow") > 0, F.concat(F.col("overflow").cast("string"), F.lit(" more in the next mail")))
    return mails.select("subscription_id", "n", "overflow", subject.alias("subject"), F.concat_ws("\n", F.transform("lines", lambda x: x["line"]), note).alias("body"))


def confirmations(subscriptions: DataFrame, site: str) -> DataFrame:
    """(id, subject, body): asks to confirm a subscription, with its rules in words."""
    part = lambda name, column: F.when(F.size(column) > 0, F.concat(F.lit(name + ": "), F.array_join(column, ", ")))
    rules = F.concat_ws("; ", part("tags", "categories"), part("agencies", "agencies"), part("words", "keywords"), part("audiences", "audiences"))
    told = F.when(F.col("scope") == "all", F.lit("all notices")).otherwise(F.coalesce(F.nullif(rules, F.lit("")), F.lit("nothing yet")))
    link = F.concat(F.lit(site.rstrip("/") + "/subscriptions/confirm/"), F.col("id").cast("string"))
    return subscriptions.where("confirmed_at is null").select("id", F.lit("Please confirm your subscription").alias("subject"), F.concat_ws("\n", F.concat(F.lit("You asked for "), told), link).alias("body"))


def failure_alerts(failures: DataFrame, most: int = ERROR_TEXT) -> DataFrame:
    """(source_id, subject, body) for failures (source_id, job, error), long errors cut."""
    error = F.coalesce("error", F.lit("no message"))
    cut = F.when(F.length(error) > most, F.concat(F.substring(error, 1, most), F.lit("…"))).otherwise(error)
    return failures.select("source_id", F.concat(F.lit("Job failed: "), F.col("job")).alias("subject"), F.concat_ws("\n", F.concat(F.lit("Source: "), F.coalesce(F.col("source_id").cast("string"), F.lit("-"))), F.concat(F.lit("Error: "), cut)).alias("body"))
