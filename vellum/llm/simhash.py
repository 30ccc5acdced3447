"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments. If two differ in at most 3 bits, then in one of
the segments they differ in at most one, so it is enough to look each segment up in a table of that
segment with the ball of radius one around it. Of two segments that differ in one bit, only the one
that has the bit set looks the other up: 1 + popcount keys per segment instead of 33. What shares a
key is compared over the full distance, and a key's links are thinned to a forest, so a large group
of near copies never yields all its pairs. Keys that very many fingerprints own are split by the
bytes of the other segment, one of which must agree. Links become components by star rounds.

Defined results: no words (null, empty, blank text) give fingerprint zero, linked like any other; a
null id gets its fingerprint, links nothing and has a null component; repeated rows give repeated
results; an id repeated with other texts gives each its own component, named by the least id of it; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batches, small_batches, stored
from .components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Fingerprints that may own a key before the key is split.
SPLIT_OVER = 4096
#: Rows from which on a fingerprint is joined by sending its component around, and the most such fingerprints sent.
HOT_ROWS, MOST_HOT = 1000, 1_000_000
LOW = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(g, seed) for g in grams), "<u8", max(1, len(words) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *also: str) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, and long columns that go along."""

    small_batches(docs.sparkSession)

    def run(it):
        for batch in batches(it):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), *(batch.column(c) for c in also)], names=["doc_id", "fp", *also])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *also).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp, rep): the segments' own keys, and those with one set bit cleared; bit 32 tells the segment."""
    probes = fps.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(65))))
    probes = probes.select("fp", "rep", F.expr("i div 33").alias("segment"), F.expr("cast(i % 33 as int)").alias("bit"))
    probes = probes.withColumn("half", F.when(F.col("segment") == 0, F.col("fp").bitwiseAND(F.lit(LOW))).otherwise(F.shiftrightunsigned("fp", 32)))
    probes = probes.where("bit = 32 or (shiftright(half, bit) & 1L) = 1L")
    cleared = F.when(F.col("bit") == 32, F.col("half")).otherwise(F.expr("half ^ shiftleft(1L, bit)"))
    return probes.select((cleared + F.col("segment") * F.lit(1 << 32)).alias("key"), "fp", "rep")


def _split_keys(fps: DataFrame, split_over: int) -> DataFrame:
    """Keys that more than ``split_over`` fingerprints own, and the keys that their owners look up."""
    halves = fps.select(F.explode(F.array(F.col("fp").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("fp", 32) + F.lit(1 << 32))).alias("key"))
    hot = halves.groupBy("key").count().where(F.col("count") > split_over)
    near = F.expr("transform(filter(sequence(0, 31), b -> (shiftright(key, b) & 1L) = 1L), b -> key ^ shiftleft(1L, b))")
    return hot.select(F.explode(F.array_append(near, F.col("key"))).alias("key")).distinct()


def _own(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    u = fp.view(np.uint64)
    return np.where(key >> 32 == 1, u >> np.uint64(32), u & np.uint64(LOW)).astype(np.int64) == (key & LOW)


def _tree(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected under ``max_bits``: positions (member, seed)."""
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = [seed]
        while front and len(left):
            near = np.bitwise_count(fp[left] ^ fp[front.pop()]) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                out += [(int(m), int(seed)) for m in found]
                front += found.tolist()
    return out


def _link(max_bits: int):
    """Links among the rows of a key; rows come sorted by key, a key's rows possibly over several batches."""

    def links(key, sub, fp, rep):
        new = np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        owned = np.zeros(len(size), bool)
        owned[group[_own(key, fp)]] = True
        keep = ((size > 1) & owned)[group]
        group, fp, rep = group[keep], fp[keep].view(np.uint64), rep[keep]
        u, v = [], []
        small = (size <= 4)[group]
        g, f, r = group[small], fp[small], rep[small]
        for s in (1, 2, 3):
            hit = (g[s:] == g[:-s]) & (np.bitwise_count(f[s:] ^ f[:-s]) <= max_bits)
            u.append(r[s:][hit])
            v.append(r[:-s][hit])
        g, f, r = group[~small], fp[~small], rep[~small]
        cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else np.array([0])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if pairs := _tree(f[a:b], max_bits):
                m, s = np.array(pairs).T + a
                u.append(r[m])
                v.append(r[s])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    def run(it):
        names, held = ("key", "sub", "fp", "rep"), None
        for batch in it:
            if not batch.num_rows:
                continue
            rows = [batch.column(n).to_numpy() for n in names]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last key may go on
            held = [x[cut:] for x in rows]
            if cut:
                yield links(*(x[:cut] for x in rows))
        if held is not None:
            yield links(*held)

    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, split_over: int = SPLIT_OVER) -> DataFrame:
    """(u, v): links that connect all fingerprints of ``fps`` (fp, rep; both unique) that are connected."""
    if max_bits > 3:
        raise ValueError("two segments with balls of radius one find up to 3 differing bits")
    keys = _keys(fps).withColumn("sub", F.lit(-1))
    hot = stored(_split_keys(fps, split_over), "split-keys")
    if not hot.isEmpty():
        other = F.when(F.col("key") >= (1 << 32), F.col("fp").bitwiseAND(F.lit(LOW))).otherwise(F.shiftrightunsigned("fp", 32))
        keys = keys.join(hot.withColumn("hot", F.lit(True)), "key", "left").withColumn("other", other)
        subs = F.expr("if(hot, transform(sequence(0, 3), j -> cast(j * 256 + (shiftright(other, 8 * j) & 255L) as int)), array(-1))")
        keys = keys.select("key", "fp", "rep", F.explode(subs).alias("sub"))
    dealt = keys.select("key", "sub", "fp", "rep").repartition("key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(_link(max_bits), "u long, v long")


def _components(every: DataFrame, max_bits: int, split_over: int) -> DataFrame:
    """(fp, root, component, n) of every fingerprint of ``every`` (doc_id, fp), with its number of rows.

    Fingerprints are the nodes, so an id that is repeated with other texts links nothing; a component
    is named by the least id that any of its fingerprints belongs to.
    """
    every_fp = stored(every.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fingerprints")
    fps = every_fp.where("rep is not null")  # those of null ids alone link nothing
    roots = connected_components(near_links(fps.select("fp", F.col("fp").alias("rep")), max_bits, split_over))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())  # a root's own rows count for the name
    linked = fps.join(members, F.col("fp") == F.col("node")).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("component"))
    linked = linked.join(least, "root").select("fp", "root", "component")
    found = every_fp.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "rep").alias("component"), "n")
    return stored(found, "fingerprint-components")


def _beside_rows(every: DataFrame, components: DataFrame) -> DataFrame:
    """``every`` with its components; rows of a fingerprint that very many share are never dealt to one task."""
    least = HOT_ROWS
    while (n_hot := (hot := components.where(F.col("n") > least)).count()) > MOST_HOT:
        least *= 10
    columns = [*every.columns, "component"]
    if not n_hot:
        return every.join(components, "fp", "left").select(*columns)
    hot = F.broadcast(hot)  # at most MOST_HOT rows
    rest = every.join(hot, "fp", "left_anti").join(components.where(F.col("n") <= least), "fp", "left")
    return every.join(hot, "fp").select(*columns).unionByName(rest.select(*columns))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, split_over: int = SPLIT_OVER) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    every = stored(fingerprints(docs, shingle), "fingerprints")
    return _beside_rows(every, _components(every, max_bits, split_over)).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, split_over: int = SPLIT_OVER, id_is_document: bool = True) -> DataFrame:
    """``docs`` with one row of each component, and all rows with a null id.

    The row that stays is the one with the least id, then the least hash of its columns; of wholly
    equal rows one stays. Components of one id, repeated with texts that nothing links, are one
    where an id is a document; with ``id_is_document`` false each keeps a row of its own. Rows are chosen by ids and hashes alone; texts are joined to the
    choice once, and stay where they are unless the choice is too large to send around.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*hashed).alias("h"))
    texts = rows.where("id is not null").select(F.col("id").alias("doc_id"), "h", F.col("row.text").cast("string").alias("text"))
    every = stored(fingerprints(texts, shingle, "h"), "fingerprints")
    first = every.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("row"))  # copies meet their like before any join
    of = first.join(_components(every, max_bits, split_over), "fp")
    chosen = of.groupBy("component" if id_is_document else "root").agg(F.min("row").alias("kept"))
    chosen = chosen.select(F.col("kept.doc_id").alias("id"), F.col("kept.h").alias("h"))
    times = every.groupBy(F.col("doc_id").alias("id"), "h").count()
    chosen = stored(chosen.join(times, ["id", "h"]), "kept-rows")
    single = rows.join(chosen.where("count = 1"), ["id", "h"], "left_semi")
    equal = rows.join(chosen.where("count > 1"), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    return single.unionByName(equal).unionByName(rows.where("id is null")).select("row.*")
