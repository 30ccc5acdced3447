"""Divergence of sources within a language, by a baseline-corrected inverted index.

Every (lang, source) group has a smoothed distribution over the language's kept terms; two groups
diverge by the sum over these of ``f = floor((p-q)^2 / (p+q))``. Nearly all counts are zero, so each
pair of groups starts at V times the f of two zero counts, and a term's postings (the groups that
have it) emit corrections alone: one-sided ones once per group and distinct count, as a zero count is
the same for all terms, and two-sided ones per pair of a term's postings, summed by pair within the
task that reads them. Terms that set a group apart are ranked by a window, whose ranks Spark limits
before its shuffle. All sums are of integers; probabilities are taken by long division in steps of
three digits, so no product leaves 64 bits below 9e15 terms a group.

Defined results: null text, lang and source are empty strings; a document without terms still makes
its group occur; repeated rows count each; a language with a single source has no pairs; one without
kept terms has pairs of value 0; equal values rank by the item's bytes; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches, stored

LEAST_DOCS = 10
RANKS = 10
#: Entries that a task holds before it hands them on.
MOST_HELD = 400_000

#: On lower-cased UTF-8: letters, and all bytes of characters beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) by parts, as a task's documents add up; a null term marks a group that occurs."""

    def flush(held: dict):
        rows = [(*group, None, 0, 0) for group in held]
        rows += [(*group, term.decode(), n, docs[term]) for group, (times, docs) in held.items() for term, n in times.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "docs"])

    def run(it):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in it:
            texts = batch.column("text")
            for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                times, docs = held.setdefault(group, (Counter(), Counter()))
                own, before = Counter(_TERM.findall(texts[k].as_py().lower())), len(times)
                for term, n in own.items():
                    times[term] += n
                docs.update(own.keys())
                size += len(times) - before + 1
                if size > MOST_HELD:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    small_batches(docs.sparkSession)
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(read("lang").alias("lang"), read("source").alias("source"), read("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _scaled(count: str, total: str) -> str:
    """SQL of 1 + floor(10^9 * count / total) for 0 <= count <= total: long division by groups of three digits."""
    first, second = f"({count}) * 1000L", f"(({count}) * 1000L % ({total})) * 1000L"
    third = f"(({second}) % ({total})) * 1000L"
    return f"1L + (({first}) div ({total})) * 1000000L + (({second}) div ({total})) * 1000L + ({third}) div ({total})"


def _f(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div ({p} + {q})"


def _two_sided(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value), source < item: what the terms that both groups have correct, summed within tasks.

    Postings come sorted by term; a term's last ones wait for the next batch. A pair's value is linear
    in three f's: that of both counts, less those of one count and a zero, plus that of two zeros.
    """

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def corrections(code, term, p, zero, groups: int):
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(1, int(np.bincount(term).max(initial=1))):
            a, b = np.flatnonzero(term[s:] == term[:-s]) + s, np.flatnonzero(term[s:] == term[:-s])
            low, high = np.where(code[a] < code[b], a, b), np.where(code[a] < code[b], b, a)
            keys.append(code[low] * groups + code[high])
            values.append(f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b]))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(values, first) if len(first) else first

    def run(it):
        number: dict[tuple[str, str], int] = {}
        sums: Counter = Counter()
        held = None

        def flush():
            names = list(number)
            rows = [(names[a][0], *sorted((names[a][1], names[b][1])), v) for (a, b), v in sums.items() if v]
            sums.clear()
            columns = zip(*rows) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])

        def add(code, term, p, zero):
            n = len(number)
            keys, values = corrections(code, term, p, zero, n)
            for k, v in zip(keys.tolist(), values.tolist()):
                sums[divmod(k, n)] += v

        for batch in it:
            if not batch.num_rows:
                continue
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            code = np.fromiter((number.setdefault(g, len(number)) for g in zip(lang, source)), np.int64, len(lang))
            name = np.array([f"{la}\x00{t}" for la, t in zip(lang, batch.column("term").to_pylist())], object)
            now = [code, name, batch.column("p").to_numpy(), batch.column("zero").to_numpy()]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            name = now[1]
            term = np.cumsum(np.r_[0, name[1:] != name[:-1]].astype(np.int64))
            cut = int(np.searchsorted(term, term[-1]))  # the last term may go on
            held = [x[cut:] for x in now]
            if cut:
                add(now[0][:cut], term[:cut], now[2][:cut], now[3][:cut])
            if len(sums) > MOST_HELD:
                yield flush()
        if held is not None:
            add(held[0], np.zeros(len(held[0]), np.int64), held[2], held[3])
        yield flush()

    rows = postings.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distances to the others, and its own terms."""
    counts = stored(_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least_docs)
    kept = kept.drop("in_docs")
    index = stored(counts.join(kept, ["lang", "term"]).select("lang", "term", "source", "n", "lang_n"), "postings")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.expr("coalesce(v, 0L)").alias("v"), F.expr("coalesce(total, 0L) + 2L * v").alias("size"), F.expr("lang_total + 2L * v").alias("lang_size"))
    groups = stored(groups.withColumn("zero", F.expr(_scaled("2L", "size"))), "groups")  # null sizes where a language keeps no term

    postings = index.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", "zero", F.expr(_scaled("n + 2L", "size")).alias("p"), F.expr(_scaled("lang_n + 2L", "lang_size")).alias("q"))

    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    unlike = groups.join(others, "lang").where("source <> item")
    base = unlike.select("lang", "source", "item", F.expr(f"coalesce(v * ({_f('zero', 'other')}), 0L)").alias("value"))
    levels = postings.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
    one = levels.join(others, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"terms * ({_f('p', 'other')} - {_f('zero', 'other')})").alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    two = _two_sided(postings)
    mirrored = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = base.unionByName(mirrored(stored(one, "one-sided"))).unionByName(mirrored(stored(two, "two-sided")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    own = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    told = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return told(pairs.withColumn("rank", rank), "pair").unionByName(told(own.withColumn("rank", rank).where(F.col("rank") <= ranks), "term"))


ORACLE_SQL = """with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
 words as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
 kept as (select lang, term, count(*) as lang_n from words group by all having count(distinct r) >= 10),
 langs as (select lang, count(*) as v, sum(lang_n) as total from kept group by lang),
 counts as (select w.lang, w.source, w.term, count(*) as n from words w join kept using (lang, term) group by all),
 totals as (select lang, source, sum(n) as total from counts group by all),
 groups as (select g.lang, g.source, coalesce(v, 0) as v, coalesce(t.total, 0) as total, l.total as lang_total from (select distinct lang, source from d) g left join totals t using (lang, source) left join langs l using (lang)),
 p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) as p, 1 + (1000000000::hugeint * (k.lang_n + 2)) // (g.lang_total + 2 * g.v) as q
  from groups g join kept k using (lang) left join counts c using (lang, source, term)),
 pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
 every as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs c on c.lang = a.lang and c.source = a.source and c.item = b.source),
 told as (select lang, source, 'pair' as part, item, value from every union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from p where n > 0 and p > q)
 select lang, source, part, item, value::bigint as value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from told) where part = 'pair' or rank <= 10"""
