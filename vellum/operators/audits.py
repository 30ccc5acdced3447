"""Audits of chains of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.classify import title_key

LEAST_NAME = 4


def act_name(title: Column) -> Column:
    """A title's act, more loosely than its key: the longest name in brackets, without notes, letters and digits only."""
    names = F.regexp_extract_all(title, F.lit("《([^《》]*)》"), F.lit(1))
    text = F.aggregate(names, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a), lambda longest: F.when(longest == "", title).otherwise(longest))
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[（(][^（）()]*[）)]", ""), r"[^\p{L}\p{N}]", ""))


def chain_audit(notices: DataFrame) -> DataFrame:
    """(finding, id, agency, name, version_of, members, n_keys) over notices (id, title, agency, version_of).

    ``dirty``: the predecessor isn't in the notice's own group (agency and title key). ``split``: the act's
    notices, by the looser name, fall into several groups, so their chain is broken.
    """
    key = title_key(F.col("title"))
    keyed = notices.select("id", "agency", "version_of", key.alias("key"), act_name(F.col("title")).alias("name"))
    act = Window.partitionBy("agency", "name")
    # null keys, of titles that are nothing but marks of rounds, are one kind more
    n_keys = (F.size(F.collect_set("key").over(act)) + F.max(F.col("key").isNull().cast("int")).over(act)).cast("long")
    acts = keyed.withColumns({"members": F.count("*").over(act), "n_keys": n_keys})
    # as one value, so that keys aren't made again to ask whether they are null
    own = notices.where("agency is not null").select(F.struct("agency", key.alias("key"), F.col("id").alias("version_of")).alias("before"), F.lit(True).alias("known")).distinct()
    rows = acts.withColumn("before", F.struct("agency", "key", "version_of")).join(own, "before", "left")
    dirty = F.col("key").isNotNull() & F.col("version_of").isNotNull() & F.col("known").isNull()
    split = F.col("agency").isNotNull() & (F.length("name") >= LEAST_NAME) & (F.col("n_keys") > 1)
    none = F.lit(None).cast("long")
    finding = lambda kind, name, members, n: F.struct(F.lit(kind).alias("finding"), name.alias("name"), members.alias("members"), n.alias("n_keys"))
    found = F.array_compact(F.array(F.when(dirty, finding("dirty", F.col("key"), none, none)), F.when(split, finding("split", F.col("name"), F.col("members"), F.col("n_keys")))))
    told = rows.select("id", "agency", "version_of", F.explode(found).alias("x"))
    return told.select("x.finding", "id", "agency", "x.name", "version_of", "x.members", "x.n_keys")
