"""MinHash near-duplicates with compressed registers (HyperMinHash).

A document's set is its distinct word shingles as 64-bit hashes. The hashes are dealt into buckets by
their top bits; of each bucket's least hash a 16-bit register keeps the count of leading zeros and the
ten bits after the first one. Bands of four registers are keys: at a Jaccard similarity of 0.8 all of
32 bands miss with probability 5e-8, and sets that share a key are candidates. What candidates share
of their registers estimates their similarity, less what unequal minima share by chance; candidates
within five standard errors of the threshold, and all above it, are verified on full sets.

A key's members are verified against its first member first, so a large group of near copies is one
component after a number of pairs that grows with its rows. Only keys that still hold several
components are looked at again: there every pair of different components whose estimate passes is
verified within the task, on chunks of bounded weight; a large key is dealt as pairs of chunks.

Defined results: a null, empty or blank text has the empty set (``n_shingles`` 0), links nothing and
stays; a null id gets its set's size, links nothing and has a null component and verdict; repeated
rows give repeated results; an id repeated with other texts has a row, set and component for each;
sets are named by 64 bits of their hashes' XXH3; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches, small_batches, stored
from .components import connected_components

SHINGLE = 4
PERCENT = 80
BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
BAND = 4
#: Standard errors of the estimate below the threshold down to which candidates are verified.
ERRORS = 5.0
#: Weight (shingles, and 512 a document) of a chunk of a key that is looked at within one task.
CHUNK = 400_000
#: Rows from which on a set's component is sent around, and the most such sets, or wanted texts' ids, sent.
HOT_ROWS, MOST_SENT = 1000, 1_000_000

_SPREAD, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; with fewer words the whole sequence is one."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    codes = coded.indices.to_numpy()
    is_word = np.fromiter(map(len, words), np.int64, len(words)).astype(bool)[codes]
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[is_word]
    h = hashes[codes[is_word]]
    stops = np.cumsum(np.bincount(of, minlength=len(texts)))
    runs = np.zeros(0, np.uint64)
    if len(h) >= shingle:
        n = len(h) - shingle + 1
        runs = _mixed(h[:n] + _SPREAD)
        for k in range(1, shingle):
            runs = _mixed(runs * _SPREAD + h[k : k + n])
    out, a = [], 0
    for b in stops.tolist():
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        elif b > a:  # fewer words: one shingle, told from longer ones by its length
            out.append(np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """A register per bucket of sorted hashes: 0 if empty, else leading zeros and mantissa of the least, plus one."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rest = (hashes[first] << np.uint64(BUCKET_BITS)) | np.uint64((1 << BUCKET_BITS) - 1)  # ends in ones: never zero
        zeros = np.zeros(len(rest), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):  # binary search of the first one
            low = rest < (np.uint64(1) << np.uint64(64 - step))
            zeros[low] += np.uint64(step)
            rest[low] <<= np.uint64(step)
        mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
        out[bucket[first]] = (zeros << np.uint64(MANTISSA_BITS)) + mantissa + np.uint64(1)
    return out


def _chance_table() -> np.ndarray:
    """Entry g: chance that the minima of two unlike buckets of 2**g hashes each give one register."""
    cells = 1 << MANTISSA_BITS
    zeros = np.arange(64 - BUCKET_BITS)[:, None]
    low = 0.5 ** (zeros + 1) * (1 + np.arange(cells)[None, :] / cells)
    width = 0.5 ** (zeros + 1) / cells
    with np.errstate(divide="ignore"):
        return np.array([((np.exp(2.0**g * np.log1p(-low)) - np.exp(2.0**g * np.log1p(-np.minimum(low + width, 1)))) ** 2).sum() for g in range(40)])


_CHANCE = _chance_table()


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities of rows of registers, corrected for chance, and the buckets each rests on."""
    held = np.count_nonzero(a | b, axis=-1)
    same = np.count_nonzero((a == b) & (a > 0), axis=-1)
    load = np.log2(np.maximum((n_a + n_b) / (2 * BUCKETS), 1)).astype(np.int64)
    chance = _CHANCE[np.minimum(load, len(_CHANCE) - 1)]
    return (same / np.maximum(held, 1) - chance) / (1 - chance), held


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """False where sizes forbid a link, or the estimate lies too far below the threshold."""
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    found, held = estimate(a, b, n_a, n_b)
    least = percent / 100
    return fits & (found >= least - ERRORS * np.sqrt(least * (1 - least) / np.maximum(held, 1)))


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, node, registers) of each row; the node, a set's name, is null for empty sets."""
    small_batches(docs.sparkSession)

    def run(it):
        for batch in batches(it):
            sets = shingle_sets(batch.column("text"), shingle)
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n", "node", "registers"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, node long, registers binary")


def _bands(sets: DataFrame) -> DataFrame:
    """(key, node, n): a key for each band of registers that aren't all empty."""

    def run(it):
        for batch in it:
            found = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u8").reshape(batch.num_rows, -1)
            row, band = np.nonzero(found)
            keys = _mixed(_mixed(found[row, band]) * _SPREAD + band.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("node").take(pa.array(row)), batch.column("n").take(pa.array(row))], names=["key", "node", "n"])

    return sets.select("node", "n", "registers").mapInArrow(run, "key long, node long, n long")


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _promising(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, with sizes and registers of both) that may link, by sizes and estimates."""

    def run(it):
        for batch in it:
            n_a, n_b = batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy()
            keep = may_link(_rows(batch.column("registers_u")), _rows(batch.column("registers_v")), n_a, n_b, percent)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return pairs.select("u", "v", "n_u", "n_v", "registers_u", "registers_v").mapInArrow(run, "u long, v long")


def _full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the ``wanted`` nodes (node, doc_id: an id whose text has that set)."""
    spark = docs.sparkSession
    wanted = stored(wanted, "wanted-sets")
    if wanted.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)  # at most MOST_SENT pairs of longs
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id").select("node", "text")

    def run(it):
        for batch in batches(it):
            sets, nodes = shingle_sets(batch.column("text"), shingle), batch.column("node").to_pylist()
            own = [k for k, s in enumerate(sets) if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) == nodes[k]]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in own], pa.int64()), pa.array([sets[k].view(np.int64) for k in own], pa.list_(pa.int64()))], names=["node", "hashes"])

    small_batches(spark)
    return stored(texts.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"]), "full-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are as alike as the threshold asks."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    both = both.select("u", "v", (F.size("a") + F.size("b")).alias("sum"), F.size(F.array_intersect("a", "b")).alias("shared"))
    return both.where(F.expr(f"100L * shared >= {percent}L * (sum - shared)")).select("u", "v")


def _in_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` (key, label, node, n, ...) with the pair of chunks (sub) and the side that each row is looked at on.

    A key whose weight is at most ``chunk`` is one chunk met with itself (side 2). Of a heavier key,
    labels heavier than ``chunk`` have chunks of their own, which needn't meet each other, and the rest
    share chunks; rows go to each pair of chunks that must meet.
    """
    weight = F.col("n") + 512
    labels = rows.groupBy("key", "label").agg(F.sum(weight).alias("w"))
    heavy = stored(labels.groupBy("key").agg(F.sum("w").alias("all")).where(F.col("all") > chunk), "heavy-keys")
    one = [F.lit(0).cast("long").alias("sub"), F.lit(2).alias("side")]
    if heavy.isEmpty():
        return rows.select("*", *one)
    owners = labels.join(heavy, "key").select("key", F.when(F.col("w") > chunk, F.col("label")).alias("owner"), "w", "label")
    owned = owners.groupBy("key", "owner").agg(F.ceil(F.sum("w") / chunk).alias("parts"))
    chunks = owned.select("key", "owner", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    chunks = chunks.withColumn("chunk", F.xxhash64("owner", "part"))
    a, b = chunks.select("key", F.col("owner").alias("o1"), F.col("chunk").alias("c1")), chunks.select("key", F.col("owner").alias("o2"), F.col("chunk").alias("c2"))
    met = a.join(b, "key").where("c1 <= c2 and not coalesce(o1 = o2, false)").withColumn("sub", F.xxhash64("c1", "c2"))
    sides = met.select("key", "sub", F.explode(F.expr("if(c1 = c2, array(named_struct('chunk', c1, 'side', 2)), array(named_struct('chunk', c1, 'side', 0), named_struct('chunk', c2, 'side', 1)))")).alias("s")).select("key", "sub", "s.chunk", "s.side")
    parts = owned.select(F.col("key").alias("of_key"), F.col("owner").alias("of_owner"), "parts")
    of = owners.join(parts, (F.col("key") == F.col("of_key")) & F.col("owner").eqNullSafe(F.col("of_owner"))).select("key", "label", "owner", "parts")
    placed = rows.join(of, ["key", "label"]).withColumn("chunk", F.xxhash64("owner", F.pmod(F.xxhash64("node"), F.col("parts"))))
    placed = placed.join(sides, ["key", "chunk"]).select(*rows.columns, "sub", "side")
    return rows.join(heavy, "key", "left_anti").select("*", *one).unionByName(placed)


def _objects(column: pa.Array) -> np.ndarray:
    """Lists or binaries, each as one object."""
    out = np.empty(len(column), object)
    for k, value in enumerate(column):
        out[k] = value.values.to_numpy() if isinstance(value, pa.ListScalar) else value.as_py()
    return out


def _by_group(it, names: list[str]):
    """Columns of all rows of one (key, sub) after another; rows come sorted by them."""
    held: dict | None = None

    def cut(table, at):
        return {n: table[n][at] for n in names}

    for batch in it:
        if not batch.num_rows:
            continue
        now = {n: _objects(batch.column(n)) if n in ("hashes", "registers") else batch.column(n).to_numpy() for n in names}
        if held is not None:
            now = {n: np.concatenate([held[n], now[n]]) for n in names}
        edge = np.flatnonzero((now["key"][1:] != now["key"][:-1]) | (now["sub"][1:] != now["sub"][:-1])) + 1
        starts = [0, *edge.tolist()]
        for a, b in zip(starts, starts[1:]):
            yield cut(now, slice(a, b))
        held = cut(now, slice(starts[-1], None))
    if held is not None:
        yield held


def _candidates_of(k: int, group: dict, regs: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """Later rows of other labels that may link with row ``k``."""
    side = group["side"]
    at = k + 1 + np.flatnonzero((label[k + 1 :] != label[k]) & ((side[k + 1 :] != side[k]) | (side[k] == 2)))
    if len(at):
        at = at[100 * np.minimum(group["n"][at], group["n"][k]) >= percent * np.maximum(group["n"][at], group["n"][k])]
    return at[may_link(regs[at], regs[k], group["n"][at], group["n"][k], percent)] if len(at) else at


def _survivors(percent: int):
    """Rows that may link with a row of another label of their key."""

    def run(it):
        for group in _by_group(it, ["key", "sub", "side", "label", "node", "n", "registers"]):
            regs = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(-1, BUCKETS)
            keep = np.zeros(len(regs), bool)
            for k in range(len(regs)):
                at = _candidates_of(k, group, regs, group["label"], percent)
                keep[at] = True
                keep[k] |= len(at) > 0
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(group[c][keep]) for c in ("key", "sub", "side", "label", "node", "n")], names=["key", "sub", "side", "label", "node", "n"])

    return run


def _links_between(percent: int):
    """Verified links between labels; labels linked once needn't be linked again."""

    def run(it):
        for group in _by_group(it, ["key", "sub", "side", "label", "node", "n", "hashes"]):
            sets = [h.view(np.uint64) for h in group["hashes"]]
            regs, label, found = np.stack([registers(s) for s in sets]), group["label"].copy(), []
            for k in range(len(sets)):
                for j in _candidates_of(k, group, regs, label, percent).tolist():
                    if label[j] == label[k]:  # joined meanwhile
                        continue
                    shared = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                    if 100 * shared >= percent * (len(sets[k]) + len(sets[j]) - shared):
                        found.append((int(group["label"][k]), int(group["label"][j])))
                        label[label == label[j]] = label[k]
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _sides(df: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    return df.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"registers_{side}")), side)


def _roots(docs: DataFrame, sets: DataFrame, shingle: int, percent: int, chunk: int) -> DataFrame:
    """(node, root) of the sets (node, doc_id, n, registers; nodes unique) that have a link."""
    keys = _bands(sets)
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("first")).where("members > 1").select("key", "first")
    members = stored(keys.join(shared, "key"), "shared-bands")
    pairs = members.where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    pairs = stored(_promising(_sides(_sides(pairs, sets, "u"), sets, "v"), percent), "candidates")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(sets.select("node", "doc_id"), "node")
    roots = connected_components(_verified(pairs, _full_sets(docs, wanted, shingle), percent))

    labelled = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    rest = stored(labelled.join(open_keys, "key", "left_semi"), "open-keys")
    names = "key", "sub"
    looked = _in_chunks(rest, chunk).join(sets.select("node", "registers"), "node")
    left = stored(looked.repartition(*names).sortWithinPartitions(*names).mapInArrow(_survivors(percent), "key long, sub long, side int, label long, node long, n long"), "survivors")
    if left.isEmpty():
        return roots
    full = _full_sets(docs, left.select("node").distinct().join(sets.select("node", "doc_id"), "node"), shingle)
    links = left.join(full, "node").repartition(*names).sortWithinPartitions(*names).mapInArrow(_links_between(percent), "u long, v long")
    above = connected_components(links)  # of labels, each a root or a set without links so far
    labels = roots.unionByName(above.select("node", F.col("node").alias("root")))
    return labels.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _beside(every: DataFrame, of: DataFrame, value: Column) -> DataFrame:
    """``every`` with ``of``'s component of its node; nodes of very many rows are never dealt to one task."""
    least = HOT_ROWS
    while (n_hot := (hot := of.where(F.col("rows") > least)).count()) > MOST_SENT:
        least *= 10
    if not n_hot:
        return every.join(of.select("node", "component"), "node", "left").select("*", value)
    hot = F.broadcast(hot.select("node", "component"))  # at most MOST_SENT rows
    rest = every.join(hot, "node", "left_anti").join(of.where(F.col("rows") <= least).select("node", "component"), "node", "left")
    return every.join(hot, "node").select("*", value).unionByName(rest.select("*", value))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    if not 0 < percent <= 100:
        raise ValueError("the threshold is a percentage above 0")
    every = stored(_described(docs, shingle), "described")
    named = every.where("node is not null and doc_id is not null")
    sets = stored(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("registers").alias("registers")), "distinct-sets")
    roots = _roots(docs, sets, shingle, percent, chunk)
    rooted = sets.select("node", "doc_id", "rows").join(roots, "node", "left").select("node", "doc_id", "rows", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
    of = stored(rooted.join(least, "root").select("node", "rows", "component"), "set-components")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    found = _beside(every.select("doc_id", "n", "node"), of, component)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
