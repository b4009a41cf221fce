"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most two of 64 bits are linked. A fingerprint
is cut into two segments, so that of two linked ones a segment differs by at
most one bit. The index holds each segment once for each of its bits with
that bit deleted (a one-wildcard variant); linked fingerprints meet in a
variant, where an equality join finds them and a bit count verifies them.

Only distinct fingerprints are indexed, so exact copies cost nothing. A
variant that more than ``pair_limit`` fingerprints share is not expanded into
pairs: its members are told apart by the few bits in which they differ at
all, and each choice of two of these bits, deleted, is joined by equality in
turn. Members of such a class (four at most) are all linked with each other,
so no link is lost and no group is multiplied by itself.

Defined cases: a null or blank text has fingerprint zero and is linked like
any other; a text of fewer words than a shingle is one shingle; repeated rows
share a class; rows with a null id take part, but an id of null is never the
smallest unless a class has no other (then the class id is null). Texts of
any length are hashed in parts of bounded size; of ties in ``keep_one`` the
smallest row stays. Columns beside id and text are not read by
``near_duplicates`` and kept by ``keep_one``, whatever their names, but for
those that begin with an underscore.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbase.llm.common import by_size, one_of_each, spread_join, staged, text_hash

SEGMENT_BITS = 32
MAX_DISTANCE = 2
PAIR_LIMIT = 64
#: Edges that a task contracts at a time.
EDGES = 1 << 19
SEED = 42


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; their bits are spread by parts, which bounds the memory of a very long text."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def packed(total: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes by their ``bit_sums``, unsigned."""
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprint_of(text: str | None, shingle_words: int = 3) -> int:
    """Fingerprint of one text, unsigned."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) > shingle_words:
        grams = list(map(b" ".join, zip(*(w[i:] for i in range(shingle_words)))))
    else:
        grams = [b" ".join(w)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(grams), 65536):  # bounds the memory of a very long text
        part = grams[at : at + 65536]
        total += bit_sums(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in part), np.uint64, len(part)))
    return packed(total, len(grams))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, v, fp): the text's hash, and its fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            fp = [fingerprint_of(t, shingle_words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "v", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_hash(text).alias("v"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, v bigint, fp bigint")


def variants(fps: DataFrame) -> DataFrame:
    """(seg, bit, key, fp): the one-wildcard variants of both segments; ``bit`` is the place of the wildcard in the whole fingerprint."""
    base = "IF(bit < 32, 0, 32)"
    half = F.expr(f"shiftrightunsigned(fp, {base}) & {(1 << SEGMENT_BITS) - 1}L")
    wild = F.expr(f"shiftleft(1L, bit - {base})")
    spread = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return spread.select("bit", half.bitwiseAND(F.bitwise_not(wild)).alias("key"), "fp")


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b): pairs of distinct fingerprints, a < b, at a distance of 1 or 2; each linked pair at least once.

    ``fps`` must hold each ``fp`` once.
    """
    first = F.col("bit").isin(0, SEGMENT_BITS)
    spread = F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))
    varies = F.expr("shiftrightunsigned(spread, bit) & 1L") == 1
    # Two that agree in all of a segment meet in each of its variants; only the first is kept for them.
    buckets = variants(fps).groupBy("bit", "key").agg(F.count("*").alias("n"), spread.alias("spread"), F.min("fp").alias("least"), F.max("fp").alias("most"))
    buckets = staged(buckets.filter((F.col("n") > 1) & (first | varies)), "simhash-buckets")
    # Two members are known from the bucket itself; the index is joined only for more.
    twos = buckets.filter("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b"))
    twos = twos.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
    rows = 64 * fps.count()
    more = buckets.filter("n > 2").select("bit", "key", "n", "spread")
    index = staged(spread_join(variants(fps), more, ["bit", "key"], rows), "simhash-index")

    small = index.filter(F.col("n") <= pair_limit).select("bit", "key", "fp")
    other = small.select("bit", "key", F.col("fp").alias("fp2"))
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    joined = small.join(other, ["bit", "key"]).filter((F.col("fp") < F.col("fp2")) & (F.bit_count(differ) <= MAX_DISTANCE))
    pairs = twos.unionByName(joined.select(F.col("fp").alias("a"), F.col("fp2").alias("b")))

    # Wildcards of a large bucket: its own bit with any bit that varies; in the first variant, any two of them.
    places = F.expr("filter(sequence(0, 63), p -> (shiftrightunsigned(spread, p) & 1L) = 1)")
    two = F.expr("""
        CASE WHEN bit IN (0, 32) THEN flatten(transform(places, (p, i) -> transform(slice(places, i + 1, size(places)), q -> shiftleft(1L, p) | shiftleft(1L, q))))
        ELSE transform(places, q -> shiftleft(1L, bit) | shiftleft(1L, q)) END""")
    large = index.filter(F.col("n") > pair_limit).withColumn("places", places).select("fp", F.explode(two).alias("wild"))
    large = large.select("fp", "wild", F.col("fp").bitwiseAND(F.bitwise_not("wild")).alias("rest"))
    # Two deleted bits leave a class of four fingerprints at most.
    classes = large.groupBy("wild", "rest").agg(F.sort_array(F.collect_set("fp")).alias("m")).filter(F.size("m") > 1)
    stars = classes.select(F.col("m")[0].alias("a"), F.explode(F.expr("slice(m, 2, 3)")).alias("b"))
    return pairs.union(stars).distinct()


def to_smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (u, v) connect: from each vertex to the smallest that it reaches by them."""
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while len(a):
        # A root moves below the smallest root beside it; each tree is then flat again, and edges within one are done.
        low = np.minimum(a, b)
        np.minimum.at(root, np.maximum(a, b), low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[other], names[root[other]]


def contracted(edges: DataFrame, block: int = EDGES) -> DataFrame:
    """``edges`` (u, v), of which each task has put the stars in place of those that it holds, ``block`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if n >= block or n and batch is None:
                found = to_smallest(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])
                held, n = [], 0

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, block: int = EDGES) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Rounds of the two star operations of Kiveris et al. (2014): each round's
    edges are written to the shared folder; only a count comes to the driver.
    Before a round's edges are written, each task contracts those it holds,
    so that a path within them takes no round for each halving of its length:
    the driver keeps the plans and stages of all rounds. The edges of a vertex
    of very many neighbours are not brought together.

    Rounds end when only stars are left: no vertex has two edges to smaller
    ones, or edges to smaller and to larger ones. Until then a round changes
    edges, and what changes an edge lowers the sum of both ends over all edges.
    """
    now = staged(contracted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), block), "star")
    while True:
        ends = now.select(F.col("u").alias("of"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("of").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        state = ends.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count_if(F.expr("up > 1 OR up > 0 AND down > 0")).alias("open")).first()
        if not state["open"]:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        # Large star: the larger neighbours of a vertex move to its smallest one.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        moved = spread_join(both.filter("v > u"), least, ["u"], 2 * state["n"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: the smaller neighbours of a vertex, and itself, move to the smallest of them.
        smallest = moved.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        back = spread_join(moved, smallest, ["u"], state["n"])
        nxt = back.select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        # No more tasks than it takes to hold the edges: what lies in one task is contracted together.
        now = staged(contracted(nxt.coalesce(-(-state["n"] // block)), block), "star")


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle_words: int = 3, pair_limit: int = PAIR_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Every row as (id, v, fp), and every fingerprint as (fp, n, least, root): its rows, their smallest id, its class."""
    hashed = staged(fingerprints(df, id_col, text, shingle_words), "simhash")
    fps = staged(hashed.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(links(fps.select("fp"), pair_limit))
    # Fingerprints without a link are their own class.
    labelled = fps.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return hashed, staged(labelled, "simhash-roots")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle_words: int = 3, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row."""
    hashed, labelled = classes(df, id_col, text, shingle_words, pair_limit)
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = spread_join(labelled.select("fp", "root"), ids, ["root"], labelled.count()).select("fp", "component_id")
    of = staged(of.join(labelled.select("fp", "n"), "fp"), "simhash-classes")
    out = spread_join(hashed.select("id", "fp"), of, ["fp"], hashed.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """One row of each class, of its smallest id; rows of equal id and different text are told apart."""
    hashed, labelled = classes(df, id_col, text, shingle_words)
    texts = hashed.groupBy("v").agg(F.min("fp").alias("fp")).join(labelled.select("fp", "root"), "fp")
    return one_of_each(df, texts.select("v", "root"), id_col, text)
