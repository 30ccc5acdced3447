"""Full-text search over an inverted index of documents, kept as segments of files.

Terms are runs of letters and digits; each character of the Chinese script is a term of its own, so
that a run of them is found as a phrase wherever it stands. A query is cut alike: a run of such
characters must be found as a phrase, any other run as the beginning of a term, and all of them.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

K1, B = 1.2, 0.75
#: Characters that are terms of their own, and other runs of letters and digits.
HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_OTHER = rf"[\p{{L}}\p{{N}}&&[^{HAN}]]+"
TERM = rf"[{HAN}]|{_OTHER}"
_PIECE = re.compile(rf"[{HAN}]+|[^\W_{HAN}]+")
#: Parts of a segment, by a term's first character, so that the beginning of a term names its part.
PARTS = 32
DOCS_PART = -1


def tokens(column) -> F.Column:
    return F.regexp_extract_all(F.lower(column), F.lit(f"({TERM})"), F.lit(1))


def _gathered(docs: DataFrame, with_docs: bool) -> DataFrame:
    """(id, doc_len, term, tf, places) of each document's terms, gathered on its row; with a row without a term each, if asked."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(it):
        for batch in it:
            lists, ids = batch.column("terms"), batch.column("id")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            of = np.repeat(np.arange(len(size)), size)
            codes, place = coded.indices.to_numpy(), np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            order = np.lexsort((codes, of))  # stable: places of a term stay in order
            d, c = of[order], codes[order]
            first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])]) if len(d) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(d)].astype(np.int32)), pa.array(place[order].astype(np.int32)))
            names = ["id", "doc_len", "term", "tf", "places"]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(d[first])), pa.array(size[d[first]].astype(np.int32)), coded.dictionary.take(pa.array(c[first])), pa.array(np.diff(np.r_[first, len(d)])), places], names=names)
            if with_docs:
                yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int32)), pa.nulls(len(size), pa.string()), pa.array(np.zeros(len(size), np.int64)), pa.nulls(len(size), pa.list_(pa.int32()))], names=names)

    return docs.select("id", tokens("text").alias("terms")).mapInArrow(run, f"id {id_type}, doc_len int, term string, tf long, places array<int>")


def postings(docs: DataFrame) -> DataFrame:
    """(id, doc_len, term, tf, places): the inverted index of documents (id, text), without a shuffle."""
    return _gathered(docs, False)


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(_PIECE.findall(query.lower())))


def _is_phrase(piece: str) -> bool:
    return re.match(f"[{HAN}]", piece) is not None


def _matches(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, doc_len, piece, tf) of documents and the pieces of the query that they hold."""
    terms = [(k, n, term, _is_phrase(piece)) for k, piece in enumerate(wanted) for n, term in enumerate(piece if _is_phrase(piece) else [piece])]
    fits = [(F.col("term") == term) if whole else F.startswith("term", F.lit(term)) for _, _, term, whole in terms]
    # a term may serve several pieces, and several places of one phrase
    served = F.array_compact(F.array(*[F.when(fit, F.struct(F.lit(k).alias("piece"), F.lit(n).alias("n"))) for fit, (k, n, _, _) in zip(fits, terms)]))
    hits = index.where(reduce(or_, fits)).select("id", "doc_len", "tf", "places", F.explode(served).alias("s")).select("id", "doc_len", "tf", "places", "s.piece", "s.n")
    longer = [k for k, piece in enumerate(wanted) if _is_phrase(piece) and len(piece) > 1]
    single = hits.where(~F.col("piece").isin(longer)) if longer else hits
    found = single.groupBy("id", "doc_len", "piece").agg(F.sum("tf").alias("tf"))
    if longer:
        size = reduce(lambda w, k: w.when(F.col("piece") == k, len(wanted[k])), longer[1:], F.when(F.col("piece") == longer[0], len(wanted[longer[0]])))
        begun = hits.where(F.col("piece").isin(longer)).select("id", "doc_len", "piece", F.explode(F.transform("places", lambda p: p - F.col("n"))).alias("start"))
        whole = begun.groupBy("id", "doc_len", "piece", "start").agg(F.count("*").alias("n")).where(F.col("n") == size)
        found = found.unionByName(whole.groupBy("id", "doc_len", "piece").agg(F.count("*").alias("tf")))
    return found


def matched(index: DataFrame, query: str) -> DataFrame:
    """(id) of the documents that hold every piece of the query."""
    wanted = query_terms(query)
    if not wanted:
        return index.select("id").limit(0)
    return _matches(index, wanted).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")


def search(index: DataFrame, n_docs: int | Column, mean_length: float | Column, query: str, page: int = 1, per_page: int = 20) -> DataFrame:
    """(id, score) of documents with all pieces of the query, best first."""
    wanted = query_terms(query)
    if not wanted:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    per = _matches(index, wanted)
    df = per.groupBy("piece").agg(F.count("*").alias("df"))  # a row per piece of the query
    scored = per.join(F.broadcast(df), "piece")
    return _ranked(scored, n_docs, mean_length, len(wanted)).offset((page - 1) * per_page).limit(per_page)


def _part(n_docs, mean_length) -> Column:
    """What a piece of a query adds to a document's score."""
    idf = F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / mean_length))


def _ranked(scored: DataFrame, n_docs, mean_length, n_pieces: int) -> DataFrame:
    part = _part(n_docs, mean_length)
    total = scored.groupBy("id").agg(F.count("*").alias("n_pieces"), F.round(F.sum(part), 6).alias("score")).where(F.col("n_pieces") == n_pieces)
    return total.select("id", "score").orderBy(F.desc("score"), "id")


class SearchIndex:
    """An index kept as segments on files of a shared folder.

    A write adds a segment: its postings, dealt to parts by their terms' first characters and sorted by
    term, so that a search reads the parts and row groups of its terms alone; a row for each document;
    and the earlier writes of its documents, which are dead from then on. The commit, written last, keeps
    the number of living documents and their length, so a search recomputes neither. A write that failed
    leaves no commit and is done again under the same number; ``merge`` makes one segment of what lives,
    ``vacuum`` removes what a merge has replaced. One writer at a time.

    Of rows of one id in a write the last one counts, by the column ``order`` if one is named; of rows
    that tie, a deletion, then the greatest text. Null ids are no documents.
    """

    SEGMENTS = "id {id}, seq int, doc_len int, term string, tf long, places array<int>, seg int, part int"
    DEAD = "id {id}, seq int, seg int"
    COMMITS = "base int, stream string, batch long, n long, total long, seg int"

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long"):
        self.spark, self.folder = spark, folder
        self._segments, self._dead = self.SEGMENTS.format(id=id_type), self.DEAD.format(id=id_type)
        for name, schema in (("segments", self._segments), ("dead", self._dead), ("commits", self.COMMITS)):
            keys = [c for c in ("seg", "part") if f"{c} int" in schema.split(", ")]
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*keys).parquet(f"{folder}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _commits(self) -> list:
        """The commits in order: as many as there were writes since the last vacuum."""
        return sorted(self._read("commits", self.COMMITS).collect(), key=lambda r: r.seg)

    def _living(self, commits: list, parts: list[int] | None = None) -> DataFrame:
        """Rows of the committed segments that no later write has replaced; of the named parts, if any."""
        base = commits[-1].base if commits else 0
        segs = [r.seg for r in commits if r.seg >= base]
        rows = self._read("segments", self._segments).where(F.col("seg").isin(segs))
        rows = rows.where(F.col("part").isin(parts)) if parts else rows
        dead = self._read("dead", self._dead).where(F.col("seg").isin(segs)).select("id", "seq")
        return rows.join(dead, ["id", "seq"], "left_anti").select("id", "seq", "doc_len", "term", "tf", "places", "part")

    def _write(self, changes: DataFrame, order: str | None = None, stream: str | None = None, batch: int | None = None, afresh: bool = False) -> None:
        """Writes changes (id, text, gone) as a segment; what a stream has written before isn't written again."""
        commits = self._commits()
        if stream is not None and any((r.stream, r.batch) == (stream, batch) for r in commits):
            return
        seg = commits[-1].seg + 1 if commits else 1
        last = F.max(F.struct(*([F.col(order).alias("order")] if order else []), F.coalesce("gone", F.lit(False)).alias("gone"), F.col("text").cast("string").alias("text"))).alias("last")
        last = changes.where("id is not null").groupBy("id").agg(last).select("id", "last.gone", "last.text").persist()
        new = _gathered(last.where("not gone"), True).withColumn("seq", F.lit(seg))
        new = new.withColumn("part", F.when(F.col("term").isNull(), DOCS_PART).otherwise(F.pmod(F.ascii("term"), F.lit(PARTS))))
        self._store(new, seg)
        known = self._living(commits, [DOCS_PART])
        replaced = known.limit(0) if afresh else known.join(last.select("id"), "id", "left_semi")
        replaced = replaced.select("id", "seq", "doc_len").persist()
        replaced.select("id", "seq").write.mode("overwrite").parquet(f"{self.folder}/dead/seg={seg}")
        size = lambda rows: rows.agg(F.count_if(F.col("doc_len") > 0).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total")).first()
        written = self._read("segments", self._segments).where((F.col("seg") == seg) & (F.col("part") == DOCS_PART))
        more, less = size(written), size(replaced)
        n, total = (commits[-1].n, commits[-1].total) if commits and not afresh else (0, 0)
        self._commit(seg, seg if afresh or not commits else commits[-1].base, stream, batch, n + more.n - less.n, total + more.total - less.total)
        last.unpersist()
        replaced.unpersist()

    def _store(self, rows: DataFrame, seg: int) -> None:
        rows = rows.repartitionByRange("part", "term", "id").sortWithinPartitions("part", "term", "id")
        rows.select("id", "seq", "doc_len", "term", "tf", "places", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/segments/seg={seg}")

    def _commit(self, seg: int, base: int, stream: str | None, batch: int | None, n: int, total: int) -> None:
        row = self.spark.createDataFrame([(base, stream, batch, n, total)], self.COMMITS.removesuffix(", seg int"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/seg={seg}")

    def index(self, docs: DataFrame, order: str | None = None) -> None:
        """Puts documents (id, text) in, instead of what their ids had before."""
        self._write(docs.withColumn("gone", F.lit(False)), order)

    def remove(self, ids: DataFrame) -> None:
        self._write(ids.select("id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("gone")))

    def rebuild(self, docs: DataFrame, order: str | None = None) -> None:
        """Puts documents in instead of all that was there."""
        self._write(docs.withColumn("gone", F.lit(False)), order, afresh=True)

    def merge(self) -> None:
        """One segment of all that lives; searches find the same before and after."""
        commits = self._commits()
        if commits:
            seg = commits[-1].seg + 1
            self._store(self._living(commits), seg)
            self._living([]).where("false").select("id", "seq").write.mode("overwrite").parquet(f"{self.folder}/dead/seg={seg}")
            self._commit(seg, seg, None, None, commits[-1].n, commits[-1].total)

    def vacuum(self) -> None:
        """Removes segments that a merge or rebuild has replaced; no search may still be reading them.

        Their commits stay, as they tell what a stream has written.
        """
        jvm = self.spark._jvm
        base = self._commits()[-1].base
        for name in ("segments", "dead"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in files.listStatus(path):
                key, _, seg = status.getPath().getName().partition("=")
                if key == "seg" and int(seg) < base:
                    files.delete(status.getPath(), True)

    def statistics(self) -> tuple[int, float]:
        """The number of documents with a term and their mean length, as the last commit has them."""
        commits = self._commits()
        n, total = (commits[-1].n, commits[-1].total) if commits else (0, 0)
        return n, total / n if n else 1.0

    def postings(self, query: str | None = None) -> DataFrame:
        """The living postings; those of the parts that a query's terms are in, if one is given."""
        parts = sorted({ord(c) % PARTS for piece in query_terms(query) for c in (piece if _is_phrase(piece) else piece[0])}) if query is not None else list(range(PARTS))
        return self._living(self._commits(), parts or [0]).select("id", "doc_len", "term", "tf", "places")

    def search(self, query: str, page: int = 1, per_page: int = 20) -> tuple[DataFrame, DataFrame]:
        """(total, hits): one row with the number of documents found, and a page of (id, score)."""
        index = self.postings(query)
        n, mean = self.statistics()
        return matched(index, query).agg(F.count("*").alias("total")), search(index, n, mean, query, page, per_page)

    def search_many(self, queries: DataFrame, within: int = 20) -> DataFrame:
        return search_many(self.postings(), queries, *self.statistics(), within)

    def sync(self, stream: DataFrame, checkpoint: str, order: str | None = None):
        """Keeps the index up to date with a stream of documents (id, text, and ``gone`` where one is deleted).

        A micro-batch that is replayed changes nothing: its commit bears the stream's checkpoint and number.
        """

        def write(batch: DataFrame, n: int) -> None:
            self._write(batch if "gone" in batch.columns else batch.withColumn("gone", F.lit(False)), order, checkpoint, n)

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def search_many(index: DataFrame, queries: DataFrame, n_docs: int, mean_length: float, within: int = 20) -> DataFrame:
    """(query_id, id, score, rank): the first documents of each query (query_id, query), found together.

    Queries of the same pieces are answered once, and pieces are looked up once, however many queries share them: beginnings by an equality join with the
    vocabulary's beginnings, phrases by their characters' places. A query's candidates are the documents
    of its rarest piece; its other pieces are asked of these alone. Queries without a piece find nothing.
    """
    cut = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(f"([{HAN}]+|{_OTHER})"), F.lit(1))))
    asking = queries.select("query_id", F.array_join(cut, " ").alias("pieces")).where("pieces <> ''")
    pieces = asking.select("pieces").distinct().select(F.col("pieces").alias("query_id"), F.explode(F.split("pieces", " ")).alias("piece")).persist()
    phrase = F.col("piece").rlike(f"^[{HAN}]")
    distinct = pieces.select("piece").distinct()
    longest = distinct.where(~phrase).agg(F.coalesce(F.max(F.length("piece")), F.lit(0))).first()[0]
    beginnings = index.select("term").distinct().select("term", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("term"), F.lit(longest)))), lambda n: F.substring("term", F.lit(1), n))).alias("piece"))
    served = distinct.where(~phrase).join(beginnings, "piece").select("piece", "term")
    single = index.join(served, "term").groupBy("piece", "id", "doc_len").agg(F.sum("tf").alias("tf"))
    characters = distinct.where(phrase).select("piece", F.posexplode(F.filter(F.split("piece", ""), lambda c: c != "")).alias("n", "term"))
    starts = index.join(characters, "term").select("piece", "id", "doc_len", F.explode(F.transform("places", lambda p: p - F.col("n"))).alias("start"))
    whole = starts.groupBy("piece", "id", "doc_len", "start").agg(F.count("*").alias("n")).where(F.col("n") == F.length("piece"))
    found = single.unionByName(whole.groupBy("piece", "id", "doc_len").agg(F.count("*").alias("tf"))).persist()
    df = found.groupBy("piece").agg(F.count("*").alias("df"))
    asked = pieces.join(df, "piece", "left").persist()
    rarest = asked.groupBy("query_id").agg(F.min_by("piece", F.struct("df", "piece")).alias("piece"), F.count("*").alias("n"), F.count("df").alias("n_found")).where("n = n_found")
    candidates = rarest.join(found.select("piece", "id"), "piece").select("query_id", "id", "n")
    parts = candidates.join(asked, "query_id").join(found, ["piece", "id"])
    part = _part(n_docs, mean_length)
    scored = parts.groupBy("query_id", "id", "n").agg(F.count("*").alias("held"), F.round(F.sum(part), 6).alias("score")).where("held = n")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    first = scored.withColumn("rank", rank).where(F.col("rank") <= within).select(F.col("query_id").alias("pieces"), "id", "score", "rank")
    return asking.join(first, "pieces").select("query_id", "id", "score", "rank")


def all_terms(docs: DataFrame, query: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows whose fields together hold every term, taken literally; a query without letters or digits finds nothing."""
    words = query.lower().split()[:10]
    if not re.search(r"[^\W_]", query):
        return docs.limit(0)
    lower = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    return docs.where(reduce(and_, [reduce(or_, [F.contains(f, F.lit(w)) for f in lower]) for w in words]))


def self_retrieval(index: DataFrame, probes: DataFrame, n_docs: int, mean_length: float, within: int = 20) -> DataFrame:
    """(id, found): whether each document's own probe (id, probe) finds it among the first ``within``."""
    hits = search_many(index, probes.select(F.col("id").alias("query_id"), F.col("probe").alias("query")), n_docs, mean_length, within)
    found = hits.where("query_id = id").select("id", F.lit(True).alias("found"))
    return probes.select("id").join(found, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))
