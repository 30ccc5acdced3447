"""Scans of files: rows of JSON answers, envelopes, capped binaries, texts out of containers, model output."""

from __future__ import annotations

import io
import re
import zipfile
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.files import kind_of

MOST_BYTES = 4 << 20


def json_rows(answers: DataFrame, column: str, path: str, schema: str) -> DataFrame:
    """A row per element of the array at ``path`` (dotted) of JSON texts; texts that don't parse give none."""
    names = path.split(".")
    nested = f"array<{schema}>"
    for name in reversed(names):
        nested = f"struct<{name}:{nested}>"
    parsed = answers.withColumn("_parsed", F.from_json(column, nested))
    return parsed.select("*", F.posexplode("_parsed." + path).alias("pos", "row")).drop("_parsed")


def fragment(envelope: Column, path: str = "$.data.html") -> Column:
    """The HTML inside a JSON envelope."""
    return F.get_json_object(envelope, path)


def binaries(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files with their kind and hash; those over the cap are not read (the length is pushed down)."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)
    return files.select("path", "length", kind_of(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"), "content")


def docx_text(content: bytes | None) -> str | None:
    """Paragraphs of a word-processor file's main part; null if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, OSError):
        return None
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
    texts = ("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S)) for p in paragraphs)
    return "\n".join(t for t in (unescape(x).strip() for x in texts) if t)


def extracted(files: DataFrame) -> DataFrame:
    """(path, kind, status, text): texts of word-processor files and pages; other containers are named as such."""
    text = F.pandas_udf(lambda s: pd.Series([docx_text(c) for c in s], dtype=object), "string")(F.when(F.col("kind") == "zip", F.col("content")))
    plain = F.when(F.col("kind") == "html", F.decode("content", "UTF-8"))
    out = files.select("path", "kind", F.coalesce(text, plain).alias("text"))
    status = F.when(F.col("text").isNotNull(), F.when(F.trim("text") == "", "empty").otherwise("ok")).when(F.col("kind").isin("pdf", "ole", "zip"), "unsupported_container").otherwise("unknown_kind")
    return out.select("path", "kind", status.alias("status"), "text")


def with_budgets(files: DataFrame, budgets: DataFrame, most_bytes: int = MOST_BYTES, timeout_ms: int = 15_000) -> DataFrame:
    """``files`` (source_id, ...) with the bytes and time that each may take: those of its source (source_id, max_bytes, timeout_ms), else the common ones.

    ``own_limit`` tells whose limit a file is over when it is. ``budgets`` has a row per source.
    """
    own = budgets.select("source_id", F.col("max_bytes").alias("_bytes"), F.col("timeout_ms").alias("_ms"))
    both = files.join(own, "source_id", "left")
    return both.select(*[F.col(c) for c in files.columns], F.coalesce("_bytes", F.lit(most_bytes)).cast("long").alias("max_bytes"), F.coalesce("_ms", F.lit(timeout_ms)).cast("long").alias("timeout_ms"), F.col("_bytes").isNotNull().alias("own_limit"))


def attachment_status(probe_ok: Column, is_html: Column, kind: Column, length: Column, downloaded: Column, text: Column, chars: Column, most_bytes: int | Column = MOST_BYTES) -> Column:
    """An attachment's terminal status: the first test that fails decides."""
    return (
        F.when(~probe_ok, "blocked")
        .when(is_html, "html_page")
        .when(kind == "other", "unsupported_kind")
        .when(length > most_bytes, "too_large")
        .when(~downloaded, "error")
        .when(text.isNull(), "unsupported_container")
        .when(chars == 0, "scanned")
        .otherwise("ok")
    )


def model_json(output: Column) -> Column:
    """The outermost object of a model's answer, its code fence taken off; null if there is none that parses."""
    bare = F.regexp_extract(output, r"(?s)(\{.*\})", 1)
    return F.when(F.call_function("try_parse_json", bare).isNotNull(), bare)


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed_id, guid, link, pub_date, problem) of the items of RSS texts (feed_id, xml)."""
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("item", f"(?s)<{name}[^>]*>(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?</{name}>", 1)), F.lit(""))
    items = feeds.select("feed_id", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("pos", "item"))
    out = items.select("feed_id", "pos", tag("guid").alias("guid"), tag("link").alias("link"), tag("pubDate").alias("pub_date"))
    return out.withColumn("problem", F.when(F.col("guid").isNull(), "no guid").when(F.col("link").isNull(), "no link").when(F.col("pub_date").isNull(), "no date"))


def followed_hops(starts: DataFrame, hops: DataFrame, most: int = 4) -> DataFrame:
    """(url, last, n_hops): where each address ends after at most ``most`` hops (url, next)."""
    out = starts.select("url", F.col("url").alias("last"), F.lit(0).alias("n_hops"))
    step = hops.select(F.col("url").alias("_from"), F.col("next").alias("_to")).dropDuplicates(["_from"])
    for _ in range(most):
        out = out.join(step, F.col("last") == F.col("_from"), "left").select("url", F.coalesce("_to", "last").alias("last"), (F.col("n_hops") + F.col("_to").isNotNull().cast("int")).alias("n_hops"))
    return out
