"""Near-duplicates by shingle similarity: SimHash classes and minhash bands propose, exact Jaccard decides.

A text is the set of its five-word shingles, lower case. Two texts are linked
where the Jaccard similarity of their sets is 0.8 or more. Texts whose SimHash
fingerprints (of the same shingles) are connected by links of two bits or
fewer (``simhash.py``) meet in the bucket of their class. Similar texts may
differ in more bits than that, so the index also holds a text once for each
of 16 bands of four minhashes; texts that share a band meet in its bucket (at
a similarity of 0.8, 0.9998 of all pairs do in one).
Members of a bucket are compared by their whole shingle sets, block against
block, each a task's matrix product of which only stars leave: first within
blocks that share two leaders, which connects groups of copies in linear
time, then all pairs that are not yet known to be connected. A bucket of more
than one block, such as an opening brings about that many texts share, is not
compared pair by pair: its texts are indexed by their rarest shingles, of which
two similar texts share one, and only texts that do are compared. No pair is
lost by that. Quadratic work is left only where many unlike texts share most
of their shingles, 0.8 of the larger and 0.89 of the smaller, with each other.

Only distinct texts are indexed. Of each component the row of the smallest id
is kept, of equal ids that of the smallest text hash.

Defined cases: null and blank texts are one class; a text of fewer words than
a shingle is one shingle; a null id comes after all others; rows of equal id
and different text are kept apart; repeated rows stay once; an empty table
gives none. A text of any length is one row of a task with all its shingles,
8 bytes each; blocks are cut by texts and by shingles. Other columns stay,
whatever their names. Texts are told apart by a hash of 64 bits, so of 10^10
texts two or three may be taken for equal to another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbase.llm import simhash
from signalbase.llm.common import by_size, one_of_each, spread_join, staged, text_hash
from signalbase.llm.simhash import SEED, components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: A block holds about as many texts, and as many shingles, at most.
BLOCK, WEIGHT = 128, 1 << 21

_ODD = np.fromiter((xxhash.xxh64_intdigest(b"odd %d" % k, SEED) | 1 for k in range(BANDS * ROWS)), np.uint64)[:, None]
_MASK = np.fromiter((xxhash.xxh64_intdigest(b"mask %d" % k, SEED) for k in range(BANDS * ROWS)), np.uint64)[:, None]


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the text's distinct shingles, sorted."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle_words)))) if len(w) > shingle_words else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """A signed key for each band of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):  # bounds the memory of a very long text
        np.minimum(least, ((found[at : at + 4096] ^ _MASK) * _ODD).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), SEED) - (1 << 63) for band in least.reshape(BANDS, ROWS)]


def fingerprint(found: np.ndarray) -> int:
    """The SimHash fingerprint of a shingle set, as a signed number."""
    fp = simhash.packed(simhash.bit_sums(found), len(found))
    return fp - (1 << 64) if fp >> 63 else fp


def keys_and_size(found: np.ndarray) -> list[int]:
    """The keys of a shingle set's bands, then its fingerprint and how many shingles it holds."""
    return [*band_keys(found), fingerprint(found), len(found)]


def _mapped(df: DataFrame, name: str, of) -> DataFrame:
    """``df`` (..., text) with the longs that ``of`` makes of the text in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            made = pa.array([of(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], name])

    kept = "".join(f"`{c}` {kind}, " for c, kind in df.dtypes[:-1])
    return df.mapInArrow(run, f"{kept}{name} array<bigint>")


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs of shingle sets reach the similarity, as a matrix."""
    size = np.array([len(s) for s in sets], np.float64)
    row = np.repeat(np.arange(len(sets)), size.astype(int))
    names, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.diag(size)
    off = ~np.eye(len(sets), dtype=bool)
    for at in range(0, n_shared := int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        m = np.zeros((len(sets), min(4096, n_shared - at)), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        both += (m @ m.T) * off
    # Integers on both sides where the similarity is a fraction of tenths: nothing hangs on rounding.
    return both * 10 >= round(similarity * 10) * (size[:, None] + size[None, :] - both)


def _forest(batch: pa.Table) -> pa.Table:
    """(a, b): a star for each component of the links among a block's texts, around its smallest leader, or else its smallest text."""
    rows = dict(sorted(zip(batch.column("v").to_pylist(), zip(batch.column("lead").to_pylist(), batch.column("s").to_pylist()))))
    v = list(rows)
    lead = [v[k] for k in range(len(v)) if rows[v[k]][0]]
    linked = similar([np.array(s, np.int64) for _, s in rows.values()])
    a, b, todo = [], [], set(range(len(v)))
    while todo:
        front = [todo.pop()]
        found = set(front)
        while front:
            new = todo.intersection(np.flatnonzero(linked[front.pop()]).tolist())
            todo -= new
            found |= new
            front += new
        names = {v[k] for k in found}
        centre = min(names.intersection(lead) or names)
        a += sorted(names - {centre})
        b += [centre] * (len(names) - 1)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _compared(cut: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The stars of blocks ``cut`` (v, lead, band, key, i, j)."""
    blocks = cut.join(sets, "v").groupBy("band", "key", "i", "j")
    return staged(blocks.applyInArrow(_forest, "a long, b long"), name)


def _blocks(n: Column, size: Column, block: int, weight: int) -> Column:
    """Into how many blocks ``n`` texts of ``size`` shingles together are cut."""
    return F.ceil(F.greatest(n / block, size / weight, F.lit(1.0)))


def prefixes(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(v, size, key, short): of each set its rarest shingles, as many as two similar sets cannot do without sharing one.

    Shingles are ordered by the number of sets of ``sets`` (v, s) that have
    them. A similar pair shares one that is among the first ones of both, and
    ``short`` in the smaller. Shingles of one set only come first and are left out.
    """
    tenths = round(similarity * 10)
    each = sets.select("v", F.size("s").alias("size"), F.explode("s").alias("key"))
    counted = staged(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "jaccard-shingles")
    shared = spread_join(each, counted, ["key"], sets.agg(F.sum(F.size("s"))).first()[0] or 0)
    ranked = shared.groupBy("v", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("order"))
    alone = F.col("size") - F.size("order")
    least = lambda x, y: F.expr(f"size - (size * {x} + {y - 1}) div {y} + 1")
    first = F.slice("order", 1, F.greatest(least(tenths, 10) - alone, F.lit(0)).cast("int"))
    rows = ranked.select("v", "size", alone.alias("alone"), F.posexplode(first).alias("at", "one"))
    return rows.select("v", "size", F.col("one.key").alias("key"), (F.col("alone") + F.col("at") < least(2 * tenths, 10 + tenths)).alias("short"))


def _open(named: DataFrame) -> DataFrame:
    """(band, key, n, size, m, most, label): groups of ``named`` (band, key, v, size, label) of more than one label, and the count and shingles of the label that is most frequent."""
    labels = named.groupBy("band", "key", "label").agg(F.count("*").alias("m"), F.sum("size").alias("most"))
    groups = labels.groupBy("band", "key").agg(F.sum("m").alias("n"), F.sum("most").alias("size"), F.max(F.struct("m", "most", "label")).alias("at"))
    return groups.filter("n > at.m").select("band", "key", "n", "size", "at.*")


def _pairs(rows: DataFrame, block: int, weight: int) -> DataFrame:
    """Blocks (v, lead, band, key, i, j) that bring all of a group together but two texts of its most frequent label; ``rows`` are its members (v, of) with ``_open``."""
    whole = _blocks(F.col("n"), F.col("size"), block, weight) == 1
    minor = F.when(whole, F.lit(1)).otherwise(_blocks(F.col("n") - F.col("m"), F.col("size") - F.col("most"), block, weight))
    major = F.when(whole, F.lit(0)).otherwise(_blocks(F.col("m"), F.col("most"), block, weight))
    rows = rows.withColumn("minor", minor).withColumn("major", major)
    in_minor = (F.col("of") != F.col("label")) | (F.col("major") == 0)
    place = F.xxhash64("v", "band")
    rows = rows.withColumn("own", F.when(in_minor, F.pmod(place, F.col("minor"))).otherwise(F.col("minor") + F.pmod(place, F.greatest("major", F.lit(1)))))
    # A text of the most frequent label meets all other blocks but those of its label; the others meet every block.
    others = F.sequence(F.lit(0).cast("long"), F.when(in_minor, F.col("minor") + F.col("major")).otherwise(F.col("minor")) - 1)
    cut = rows.select("v", "band", "key", "own", F.explode(others).alias("other"))
    return cut.select("v", F.lit(False).alias("lead"), "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _of_classes(distinct: DataFrame) -> DataFrame:
    """(v, copies, size, band, key): the entries of the index by SimHash classes; ``distinct`` holds each text with its ``keys_and_size``."""
    of = distinct.select("v", "copies", F.element_at("keys", -1).alias("size"), F.element_at("keys", -2).alias("fp"))
    fps = staged(of.groupBy("fp").agg(F.count("*").alias("n")), "jaccard-fingerprints")
    roots = components(simhash.links(fps.select("fp"))).withColumnRenamed("v", "fp")
    # The root of a class, and a fingerprint without a link, is its own key.
    named = fps.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("key"))
    met = spread_join(of, staged(named, "jaccard-classes"), ["fp"], of.count())
    return met.select("v", "copies", "size", F.lit(BANDS).alias("band"), "key")


def links(df: DataFrame, text: str = "text", block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """(a, b): text hashes that are connected by links, enough of them to connect each component.

    First each text is compared within a block of one bucket, its largest, and
    with two leaders that all blocks of the bucket share; a group of copies
    comes together so in linear time. Then, in every bucket of one block, all
    pairs that are not known to be connected are compared. Larger buckets are
    given up for the groups of ``prefixes`` of their texts.
    """
    texts = df.select(text_hash(text).alias("v"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = staged(_mapped(texts, "keys", lambda t: keys_and_size(shingles(t))), "jaccard-keys")
    n_rows = keyed.count()
    distinct = staged(keyed.groupBy("v").agg(F.min("keys").alias("keys"), F.count("*").alias("copies")), "jaccard-distinct")
    index = distinct.select("v", "copies", F.element_at("keys", -1).alias("size"), F.posexplode(F.slice("keys", 1, BANDS)).alias("band", "key"))
    index = staged(index.unionByName(_of_classes(distinct)), "jaccard-index")
    buckets = index.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("v").alias("l1"), F.max("v").alias("l2"), F.bit_xor(F.xxhash64("v")).alias("who"))
    # Bands whose buckets hold the same texts are compared once.
    buckets = buckets.filter("n > 1").groupBy("n", "who").agg(F.min(F.struct("band", "key", "all", "l1", "l2")).alias("at")).select("n", "at.*")
    buckets = staged(buckets, "jaccard-buckets")
    members = staged(spread_join(index, buckets.select("band", "key", "n", "all"), ["band", "key"], (BANDS + 1) * n_rows), "jaccard-members")
    wanted = members.groupBy("v").agg(F.max("copies").alias("n"))
    wanted = spread_join(texts, wanted, ["v"], n_rows).groupBy("v").agg(F.min("text").alias("text"))
    sets = staged(_mapped(wanted, "s", lambda t: shingles(t).view(np.int64)), "jaccard-sets")

    parts = _blocks(F.col("n"), F.col("all"), block, weight)
    home = members.groupBy("v").agg(F.max(F.struct("n", "all", "band", "key")).alias("at")).select("v", F.lit(False).alias("lead"), "at.*")
    home = home.select("v", "lead", "band", "key", F.pmod(F.xxhash64("v", "band"), parts).alias("i"))
    leaders = buckets.filter(parts > 1).select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("i"))
    leaders = leaders.select(F.explode(F.array("l1", "l2")).alias("v"), F.lit(True).alias("lead"), "band", "key", "i")
    near = _compared(home.union(leaders).withColumn("j", F.col("i")), sets, "jaccard-near")

    # Where a bucket holds texts that are not known to be connected: of its largest part that is, no two are compared again.
    known = near.groupBy("a").agg(F.min("b").alias("label"))
    named = members.join(known, members["v"] == known["a"], "left").select("v", "size", "band", "key", F.coalesce("label", "v").alias("label"))
    named = staged(named, "jaccard-named")
    open_ = staged(_open(named), "jaccard-open")
    rows = staged(spread_join(named.select("v", "band", "key", F.col("label").alias("of")), open_, ["band", "key"], (BANDS + 1) * n_rows), "jaccard-rows")
    narrow = _blocks(F.col("n"), F.col("size"), block, weight) == 1
    cut = _pairs(rows.filter(narrow), block, weight)

    wide = staged(rows.filter(~narrow).select("v", "of").distinct(), "jaccard-wide")
    if wide.isEmpty():
        return near.union(_compared(cut, sets, "jaccard-rest")).distinct()
    rare = prefixes(sets.join(wide.select("v"), "v")).join(wide, "v").select("v", "size", F.lit(BANDS + 1).alias("band"), "key", "short", F.col("of").alias("label"))
    rare = staged(rare, "jaccard-rare")
    groups = rare.groupBy("band", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("who"), F.max("short").alias("short"), F.min("label").alias("least"), F.max("label").alias("most"))
    groups = groups.filter("short AND least < most").groupBy("n", "who").agg(F.min(F.struct("band", "key")).alias("at")).select("n", "at.*")
    n_rare = rare.count()
    rare = staged(spread_join(rare, groups, ["band", "key"], n_rare).select("v", "size", "band", "key", "label"), "jaccard-groups")
    met = spread_join(rare.select("v", "band", "key", F.col("label").alias("of")), _open(rare), ["band", "key"], n_rare)
    return near.union(_compared(cut.union(_pairs(met, block, weight)), sets, "jaccard-rest")).distinct()


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """One row of each class of near-duplicates, with all columns of ``df``."""
    return one_of_each(df, components(links(df, text, block, weight)), id_col, text)
