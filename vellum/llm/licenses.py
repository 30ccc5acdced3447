"""Licence scan: TF-IDF cosines of licence passages to templates, then inheritance by directory.

A passage is a line of a text that has one of the cue words (all templates have one, so that no
line near a template is passed over), or a run of terms as long as a template, wherever it begins and
whatever lines and comment marks it goes over. Passages become term counts; weights are counts times the
inverse frequency over the templates, and the cosine with each template is a join on terms and two
sums. A file's own licence is that of its best passage. A directory's licence is that of the best
licence file in it; a file without a licence of its own inherits from the nearest directory above
it that has one, which is found once per directory, by joining the paths of its ancestors.

All of it is DataFrame operations; template tables have a fixed size. Defined results: null and
empty texts have no licence of their own; a null path inherits nothing; rows that repeat a path are
one file, with the best passage of them all; of equal scores the licence first in order of names
wins; an empty table gives no rows; only path and text are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .license_templates import TEMPLATES

CUES = ("licen[cs]e", "licensed", "copyright", "reserved", "redistribut", "free software", "permission")
CUE = "(?i)(" + "|".join(CUES) + ")"
#: The terms that make a place a cue; each template has one.
CUE_TERM = "licen[cs]e|copyright|reserved|redistribut|permission"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.75
#: Names of files that speak for their directory.
LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice)[^/]*$"
#: Directories with a licence up to this many (of about 200 bytes) are broadcast.
BROADCAST_ROWS = 50_000


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def inverse_frequencies() -> tuple[dict[str, float], float]:
    """Each template term's weight, and that of a term no template has."""
    n = len(TEMPLATES)
    frequency: dict[str, int] = {}
    for _, text in TEMPLATES:
        for term in set(terms(text)):
            frequency[term] = frequency.get(term, 0) + 1
    return {t: math.log((1 + n) / (1 + f)) + 1 for t, f in sorted(frequency.items())}, math.log(1 + n) + 1


def template_vectors() -> list[tuple[int, str, str, float]]:
    """(template, licence, term, weight) with unit length per template."""
    weight, _ = inverse_frequencies()
    rows = []
    for k, (name, text) in enumerate(TEMPLATES):
        own: dict[str, float] = {}
        for term in terms(text):
            own[term] = own.get(term, 0.0) + weight[term]
        norm = math.sqrt(sum(x * x for x in own.values()))
        rows += [(k, name, term, x / norm) for term, x in sorted(own.items())]
    return rows


def own_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(path, license, score): each path's best passage, for paths that have one."""
    spark = files.sparkSession
    weight, unknown = inverse_frequencies()
    weights = F.broadcast(spark.createDataFrame(list(weight.items()), "term string, idf double"))  # fixed size
    vectors = F.broadcast(spark.createDataFrame(template_vectors(), "template int, license string, term string, w double"))  # fixed size
    lines = files.where(F.col("text").rlike(CUE)).select("path", F.explode(F.split("text", "\n")).alias("line"))
    # a line goes by its hash from here on: it may be as long as a text, and has a row for each of its terms
    found = F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0))
    lines = lines.where(F.col("line").rlike(CUE)).groupBy("path", F.xxhash64("line").alias("of")).agg(F.first(found).alias("terms"))
    counts = lines.select("path", "of", F.explode("terms").alias("term")).groupBy("path", "of", "term").count()
    weighted = counts.join(weights, "term", "left").select("path", "of", "term", (F.col("count") * F.coalesce("idf", F.lit(unknown))).alias("x"))
    weighted = stored(weighted, "licence-terms")  # of passages only; used twice
    norms = weighted.groupBy("path", "of").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighted.join(vectors, "term").groupBy("path", "of", "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scores = dots.join(norms, ["path", "of"]).select("path", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    scores = scores.unionByName(_run_scores(files.where(F.col("text").rlike(CUE)), weights, vectors, unknown, least))
    return scores.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("worse"), "license")).alias("best")).select("path", "best.license", (-F.col("best.worse")).alias("score"))


def _run_scores(files: DataFrame, weights: DataFrame, vectors: DataFrame, unknown: float, least: float) -> DataFrame:
    """(path, license, score): runs of as many terms as a template has, near a cue word, that come up to ``least``.

    A run's dot is a sum over its places, and its norm is at least the root of the sum of the squared
    weights of its places that the template has too; runs that reach ``least`` by that bound are scored
    exactly. A run begins at a term of its template.
    """
    lengths = [(k, len(terms(text))) for k, (_, text) in enumerate(TEMPLATES)]
    longest = max(n for _, n in lengths)
    length = F.broadcast(files.sparkSession.createDataFrame(lengths, "template int, length int"))  # fixed size
    found = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    texts = files.groupBy("path", "text").agg(F.lit(1).alias("one")).select("path", F.xxhash64("text").alias("of"), found.alias("terms"))
    texts = stored(texts, "licence-texts")  # with a cue only; else each place would cut its whole text into terms anew
    near = F.expr(f"transform(filter(sequence(1, size(terms)), k -> terms[k - 1] rlike '{CUE_TERM}'), k -> sequence(greatest(k - {longest - 1}, 1), least(k + {longest - 1}, size(terms))))")
    places = texts.where("size(terms) > 0").select("path", "of", F.explode(F.transform(F.array_distinct(F.flatten(near)), lambda k: F.struct(k.alias("pos"), F.get("terms", k - 1).alias("term")))).alias("p")).select("path", "of", "p.pos", "p.term")
    places = stored(places.join(weights, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(unknown))), "licence-places")  # around cue words only; used twice
    hits = places.join(vectors, "term").join(length, "template")
    run = Window.partitionBy("path", "of", "template").orderBy(F.expr("pos * 1000000L div length")).rangeBetween(0, 1_000_000 - 500_000 // longest)  # ``length`` places
    bound = hits.withColumn("dot", F.sum(F.col("idf") * F.col("w")).over(run)).withColumn("square", F.sum(F.col("idf") * F.col("idf")).over(run))
    starts = bound.where(F.col("dot") >= (least - 1e-6) * F.sqrt("square")).select("path", "of", "template", "license", F.col("pos").alias("start"), "length")
    # a run lies in two blocks of places at most, so it meets only so many places, however long its text is
    block = lambda pos: F.expr(f"{pos} div {longest}")
    spread = starts.withColumn("block", F.explode(F.array_distinct(F.array(block("start"), block("(start + length - 1)")))))
    inside = spread.join(places.withColumn("block", block("pos")), ["path", "of", "block"]).where("pos >= start and pos < start + length")
    counted = inside.groupBy("path", "of", "template", "license", "start", "term", "idf").agg(F.count("*").alias("n")).join(vectors.select("template", "term", "w"), ["template", "term"], "left")
    x = F.col("n") * F.col("idf")
    scored = counted.groupBy("path", "of", "template", "license", "start").agg((F.sum(x * F.coalesce("w", F.lit(0.0))) / F.sqrt(F.sum(x * x))).alias("cosine"))
    return scored.select("path", "license", F.round("cosine", 6).alias("score")).where(F.col("score") >= least)


def _directory(path: str) -> F.Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def directory_licenses(own: DataFrame) -> DataFrame:
    """(dir, dir_license): the best licence file's licence in each directory that has one."""
    files = own.where(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE))
    best = F.min(F.struct((-F.col("score")).alias("worse"), "license", "path")).alias("best")
    return files.groupBy(_directory("path").alias("dir")).agg(best).select("dir", F.col("best.license").alias("dir_license"))


def license_scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``files`` (path, text, and one more column ``id``) with own, inherited and effective licence."""
    files = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = stored(own_licenses(files, least), "own-licences")
    paths = stored(files.select("id", "path", _directory("path").alias("of")), "paths")
    licensed = stored(directory_licenses(own), "directory-licences")
    few = licensed.count() <= BROADCAST_ROWS
    dirs = paths.where("path is not null").groupBy("of").agg(F.lit(1).alias("one"))
    parts = F.split("of", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    ancestors = dirs.select("of", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("dir"))), above)).alias("a")).select("of", "a.depth", "a.dir")
    ancestors = ancestors.where("depth = 0 or dir <> ''")
    nearest = ancestors.join(F.broadcast(licensed) if few else licensed, "dir").groupBy("of").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("near"))
    nearest = stored(nearest, "nearest-licences")  # a row per directory; few are sent around, so that a large directory's files stay spread
    scanned = paths.join(own, "path", "left").join(F.broadcast(nearest) if nearest.count() <= BROADCAST_ROWS else nearest, "of", "left")
    inherited = F.col("near.dir_license")
    return scanned.select(
        "id",
        "path",
        F.col("license").alias("own_license"),
        "score",
        inherited.alias("inherited_license"),
        F.col("near.dir").alias("inherited_from"),
        F.coalesce("license", inherited).alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(inherited.isNotNull(), "inherited").otherwise("none").alias("basis"),
    )


#: The documents table has no paths. Its rows are laid out as a tree by source, language and id, and
#: a text with a licence cue, however long it is, stands as a licence file of its directory; whether it
#: speaks for the directory is decided by its score, as for any licence file.
PATH_RULE = "concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), concat('part-', coalesce(doc_id % 16, 0)), concat(case when regexp_like(text, '{cue}') then 'LICENSE-' else 'doc-' end, coalesce(cast(doc_id as {string}), '-')))"


def document_files(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.expr(PATH_RULE.format(cue=CUE, string="string")).alias("path"), "text")


def oracle_sql() -> str:
    weight, unknown = inverse_frequencies()
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)
    path = PATH_RULE.format(cue=CUE, string="varchar").replace("regexp_like(text, ", "regexp_matches(text, ")
    return f"""
    with weights(term, idf) as (values {values(weight.items())}),
    vectors(template, license, term, w) as (values {values(template_vectors())}),
    files as (select doc_id as id, {path} as path, text from documents),
    lines as (select distinct path, line from (select path, unnest(string_split(text, chr(10))) as line from files) where regexp_matches(line, '{CUE}')),
    counts as (select path, line, term, count(*) as n from (select path, line, unnest(regexp_extract_all(lower(line), '{TERM}')) as term from lines) group by all),
    weighted as (select path, line, c.term, n * coalesce(idf, {unknown!r}) as x from counts c left join weights w on c.term = w.term),
    norms as (select path, line, sqrt(sum(x * x)) as norm from weighted group by all),
    dots as (select path, line, template, license, sum(x * w) as dot from weighted join vectors using (term) group by all),
    own as (select path, min({{'worse': -score, 'license': license}}) as best
            from (select path, license, round(dot / norm, 6) as score from dots join norms using (path, line)) where score >= {LEAST} group by path),
    licensed as (select regexp_replace(path, '/?[^/]*$', '') as dir, min({{'worse': best.worse, 'license': best.license, 'path': path}}).license as dir_license
                 from own where regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENSE_FILE}') group by 1),
    dirs as (select distinct regexp_replace(path, '/?[^/]*$', '') as "of" from files),
    ancestors as (select "of", n as depth, case when n = 0 then '' else array_to_string(list_slice(string_split("of", '/'), 1, n), '/') end as dir
                  from dirs, unnest(range(0, len(string_split("of", '/')) + 1)) as r(n)),
    nearest as (select "of", max({{'depth': depth, 'dir': dir, 'dir_license': dir_license}}) as near from ancestors join licensed using (dir) group by 1)
    select f.id, f.path, o.best.license as own_license, -o.best.worse as score, near.dir_license as inherited_license, near.dir as inherited_from,
           coalesce(o.best.license, near.dir_license) as license,
           case when o.best.license is not null then 'own' when near.dir_license is not null then 'inherited' else 'none' end as basis
    from files f left join own o on f.path = o.path left join nearest n on n."of" = regexp_replace(f.path, '/?[^/]*$', '')
    """
