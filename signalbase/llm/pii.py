"""Personal data by patterns, and more of it by bootstrapped context.

The base kinds (email, ip, card, phone) are found by regular expressions and
checks. Their matches are the seeds of a bootstrap over the corpus: every
identifier-like token (with an at sign, or four digits) is an instance, the
words around it are its lexical patterns, and instance and pattern are the
two sides of a graph. In each round a pattern's confidence for a kind is the
share of its distinct instances that carry the kind, and an instance takes
the kind of the patterns that are sure of it, until a round names no more
instances than the one before; what the surest patterns name in the end is a
discovered identifier, and a span of that kind.

All of it is DataFrame operations. Texts are read once; the graph holds
candidates with their contexts only, aggregated to distinct pairs before it
is joined, so copies and frequent words weigh nothing.

Defined cases: a null, empty or blank text has no span; repeated rows (equal
id and text) have equal spans; rows of equal id and different text are kept
apart; of patterns that are equally sure the kind listed last counts; a null
id is kept; an empty table gives an empty result; texts of any length take
linear time. Other columns, of any name, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbase.llm.common import found, let, staged

_LOCAL = r"[A-Za-z0-9._%+-]"
_LABEL = r"[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    """A base kind. Quantifiers are possessive: the parts exclude each other, so nothing is lost and long runs take linear time."""

    name: str
    pattern: str

    def valid(self, match: Column) -> Column:
        digits = F.regexp_replace(match, "[^0-9]", "")
        if self.name == "ip":
            parts = F.split(F.regexp_replace(match, r"(^|\.)0+(?=[0-9])", "$1"), r"\.")
            return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
        if self.name == "card":
            return let(digits, lambda d: F.length(d).between(14, 19) & (luhn_sum(d) % 10 == 0))
        if self.name == "phone":
            return let(digits, lambda d: F.length(d).between(10, 15))
        return F.lit(True)


KINDS = (
    # A match begins at the start of a run, or where the one before it ended.
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)

_RUN = r"[A-Za-z0-9@._%+()/-]"
_NO_DIGIT = r"[A-Za-z._%+()/-]*+"
#: A run with an at sign or with four digits, and further digit groups after single spaces. It is tried at the start of
#: a run only, and its quantifiers are possessive: long runs take linear time. Marks at its ends are trimmed afterwards.
IDENTIFIER = (
    rf"(?<!{_RUN})(?=[A-Za-z0-9._%+()/-]*+@|{_NO_DIGIT}[0-9](?:{_NO_DIGIT}(?:\x20[(]?)?[0-9]){{3}})"
    rf"{_RUN}++(?:\x20[0-9(][0-9()./-]*+)*+"
)
#: Marks that an identifier neither begins nor ends with.
LEADING, TRAILING = "@.%/)-", "@._%+(/-"

#: Distinct instances of a kind that a pattern needs, its confidence, and the score an instance needs.
SUPPORT = 3
CONFIDENCE = 0.8

SPANS = "array<struct<start:int,rank:int,end:int>>"


def luhn_sum(digits: Column) -> Column:
    """The sum of a Luhn check: from the right, each second digit doubled, less 9 where it has two digits."""
    each = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d < 5, 2 * d).otherwise(2 * d - 9))

    return F.reduce(F.transform(each, value), F.lit(0), lambda a, b: a + b)


def base_spans(text: Column) -> Column:
    """All base matches as an array of (start, rank, end), by start, then kind."""

    def of(rank: int, kind: Kind) -> Column:
        valid = F.filter(found(text, kind.pattern), lambda m: kind.valid(m["match"]))
        return F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    return F.sort_array(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def _first_over(spans: Column, start: Column, end: Column) -> Column:
    """The first of ``spans`` that overlaps a range, by bisection; no two of them overlap, so their ends are in order as well. Null if none does."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        after = F.get(spans, middle)["end"] > start
        open_ = acc["low"] < acc["high"]
        low = F.when(open_ & ~after, middle + 1).otherwise(acc["low"])
        return F.struct(low.alias("low"), F.when(open_ & after, middle).otherwise(acc["high"]).alias("high"))

    first = F.reduce(halvings, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda acc: F.get(spans, acc["low"]))
    return let(first, lambda s: F.when(s["start"] < end, s))


def candidates(text: Column, spans: Column) -> Column:
    """Identifier-like tokens with the words around them and the rank of the base kind that covers them (null: none).

    The words are the last and first of the text between a token and its
    neighbours, whatever their length; where there is none, the neighbour is it.
    """
    inner = r"(?<=[\p{L}\p{N}:=#])[^\p{L}\p{N}:=#]++$"
    word = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]++|" + inner, ""))
    cut = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")

    def one(m: Column, left: Column, right: Column, by_kind: Column) -> Column:
        bare = F.ltrim(m["match"], F.lit(LEADING))
        start = m["start"] + F.length(m["match"]) - F.length(bare)
        value = F.rtrim(bare, F.lit(TRAILING))
        seed = F.array_min(F.array_compact(F.transform(by_kind, lambda own: _first_over(own, m["start"], m["end"]))))
        return F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            F.lower(value).alias("instance"),
            let(cut(left), lambda b: F.struct(word(F.get(b, F.size(b) - 1)).alias("left1"), word(F.get(b, F.size(b) - 2)).alias("left2"))).alias("left"),
            word(F.get(cut(right), F.lit(0))).alias("right1"),
            seed["rank"].alias("rank"),
        )

    def each(ms: Column, by_kind: Column) -> Column:
        near = lambda i: F.regexp_replace(F.coalesce(F.get(ms, i)["match"], F.lit("")), r"\s++", "")
        return F.transform(ms, lambda m, i: one(m, F.concat_ws(" ", near(i - 1), m["before"]), F.concat_ws(" ", m["after"], near(i + 1)), by_kind))

    # The spans of one kind do not overlap each other, which those of several may.
    of_kind = lambda rank: F.filter(spans, lambda s: s["rank"] == rank)
    of_kinds = F.array(*map(of_kind, range(len(KINDS))))
    every = let(of_kinds, lambda by_kind: let(found(text, IDENTIFIER), lambda ms: each(ms, by_kind)))
    return F.filter(every, lambda c: c["end"] > c["start"])


def _patterns(cands: DataFrame) -> DataFrame:
    """A row for each candidate and lexical pattern around it."""
    l1, l2, r1 = F.col("c")["left"]["left1"], F.col("c")["left"]["left2"], F.col("c")["right1"]
    ok = lambda *x: F.forall(F.array(*x), lambda w: F.coalesce(F.length(w) > 0, F.lit(False)))
    each = F.array(
        F.when(ok(l1), F.concat(F.lit("L "), l1)),
        F.when(ok(l1, l2), F.concat(F.lit("LL "), l2, F.lit(" "), l1)),
        F.when(ok(l1, r1), F.concat(F.lit("LR "), l1, F.lit(" _ "), r1)),
    )
    return cands.select("*", F.explode(F.filter(each, lambda p: p.isNotNull())).alias("pattern"))


def discover(cands: DataFrame) -> DataFrame:
    """The bootstrap over (key..., c): rows of ``cands`` that sure patterns name, with the kind's rank.

    Each round names more instances than the one before, or is the last.
    """
    rows = _patterns(cands)
    edges = staged(
        rows.groupBy("pattern", F.col("c")["instance"].alias("instance")).agg(F.max(F.col("c")["rank"]).alias("seed")),
        "pii-edges",
    )
    seeds = staged(edges.filter(F.col("seed").isNotNull()).groupBy("instance").agg(F.max("seed").alias("rank")).withColumn("score", F.lit(1.0)), "pii-seeds")
    totals = staged(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-totals")
    known, sure, named = seeds, None, -1
    while True:
        # Only patterns with enough known instances go on; each instance counts once for a pattern.
        support = edges.join(known, "instance").groupBy("pattern", "rank").agg(F.sum("score").alias("w"), F.count("*").alias("k"))
        now = support.filter(F.col("k") >= SUPPORT).join(totals, "pattern").withColumn("confidence", F.col("w") / (F.col("n") + 0.5))
        now = staged(now.filter(F.col("confidence") >= CONFIDENCE).select("pattern", F.col("rank").alias("named"), "confidence"), "pii-patterns")
        # Each instance takes its best kind from the patterns that name it; seeds keep theirs.
        best = edges.filter("seed IS NULL").join(now, "pattern").groupBy("instance").agg(F.max(F.struct("confidence", F.col("named").alias("rank"))).alias("b"))
        gained = best.join(seeds, "instance", "left_anti").select("instance", F.col("b.rank").alias("rank"), F.col("b.confidence").alias("score"))
        gained = staged(gained, "pii-gained")
        before, named = named, gained.count()
        if sure is None or named > before:
            sure = now
        if named <= max(before, 0):
            break
        known = seeds.unionByName(gained)
    hits = rows.filter(F.col("c")["rank"].isNull()).join(sure, "pattern")
    return hits.select(*[c for c in cands.columns if c != "c"], "c", "named", "confidence")


def find_pii(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, text_hash, base, added): base and discovered spans of every row, each by start, then kind."""
    first = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = first.withColumn("both", let(base_spans(F.col("text")), lambda s: F.struct(s.alias("base"), candidates(F.col("text"), s).alias("cands"))))
    per_row = staged(first.select("id", "text_hash", "both.base", "both.cands"), "pii-rows")
    with_cands = per_row.filter(F.size("cands") > 0)
    hits = discover(with_cands.select("id", "text_hash", F.explode("cands").alias("c")))
    # Where several patterns name a candidate, the surest gives its kind.
    added = hits.groupBy("id", "text_hash", F.col("c")["start"].alias("start"), F.col("c")["end"].alias("end")).agg(F.max(F.struct("confidence", "named")).alias("b"))
    new = F.struct("start", F.col("b.named").alias("rank"), "end")
    added = added.groupBy(F.col("id").alias("of"), F.col("text_hash").alias("hash")).agg(F.array_sort(F.collect_set(new)).alias("added"))
    none = F.array().cast(SPANS)
    # Only rows with a candidate can gain spans; the others are not shuffled.
    gained = with_cands.join(added, with_cands["id"].eqNullSafe(added["of"]) & (with_cands["text_hash"] == added["hash"]), "left")
    out = gained.select("id", "text_hash", "base", F.coalesce("added", none).alias("added"))
    rest = per_row.filter(F.size("cands") == 0).select("id", "text_hash", "base", none.alias("added"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)


def digest_columns(found_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns: counts and digest of the base spans, all spans, and how many were discovered."""
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long").alias(f"n_{KINDS[r].name}")
    every = F.array_sort(F.concat("base", "added"))
    return found_rows.select(
        id_col,
        *(count(r) for r in range(len(KINDS))),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size("added").cast("long").alias("n_discovered"),
    )
