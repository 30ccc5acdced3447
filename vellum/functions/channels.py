"""Contacts in prose: addresses of the web and mail, telephones; and excerpts within a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# The kinds of contacts and their patterns.
PATTERNS = {
    "url": r"https?://[^\s<>\"'，。；、）)]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"(?<![\d-])(?:\+?\d{1,3}[ -])?(?:\(?0\d{2,3}\)?[ -]?)?\d{7,8}(?![\d-])",
}
MOST = 8


def channels(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(id, kind, value, rank): contacts of each text, per kind in order of place, each once, at most ``most``."""

    def matches(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
        return F.transform(values, lambda v, k: F.struct(F.lit(kind).alias("kind"), v.alias("value"), k.alias("pos")))

    found = [matches(kind, p) for kind, p in PATTERNS.items()]
    rows = docs.select("id", F.explode(reduce(lambda a, b: F.concat(a, b), found)).alias("c")).select("id", "c.kind", F.lower(F.regexp_replace("c.value", r"[.,;:]+$", "")).alias("value"), "c.pos")
    first = rows.groupBy("id", "kind", "value").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("id", "kind").orderBy("pos"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).drop("pos")


def merged_channels(programmatic: Column, model: Column, most: int = MOST) -> Column:
    """The first list, then those of the second that are neither equal to nor (8 characters on) part of what is there."""
    key = lambda v: F.lower(F.regexp_replace(v, r"\s+", ""))

    def step(have, value):
        known = F.exists(have, lambda h: (key(h) == key(value)) | ((F.length(key(value)) >= 8) & F.contains(key(h), key(value))) | ((F.length(key(h)) >= 8) & F.contains(key(value), key(h))))
        return F.when(known | (F.trim(value) == ""), have).otherwise(F.array_append(have, value))

    return F.slice(F.aggregate(model, programmatic, step), 1, most)


def inferred_kind(value: Column) -> Column:
    return F.when(value.rlike("^https?://"), "url").when(value.contains("@"), "email").when(value.rlike(r"^[\d +()-]{7,}$"), "phone").otherwise("address")
