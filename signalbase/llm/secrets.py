"""Secret scan: pattern candidates, and a random forest against false positives.

Candidates are values assigned to a name with a word like ``password`` or
``api_key`` in it, passwords in addresses, and long tokens with a digit. Each
is described by its length, its character transitions (changes of class, and
how much likelier its pairs of characters are in secrets than in other
values), how much of it dictionary words cover, its path, the name it is
assigned to, and the words on both sides; a random forest trained on labelled
findings tells secrets from digests, ids, counters, placeholders and prose.

All of it is DataFrame operations and Spark ML, in the JVM. Without findings
of one's own, ``labelled_findings`` makes some by rule; training takes at most
``most`` of its rows, chosen by hash, scanning takes all. The dictionary is a
table of words, by default those that the scanned texts hold as words of
their own ``DICTIONARY_TIMES`` times.

Defined cases: a null or empty text has no finding; repeated rows have equal
findings; rows of equal id and different text are kept apart; ties (several
findings at one place) cannot be, matches do not overlap; a null id or path is
kept or counts as empty; an empty table gives an empty result; texts of any
length take linear time; ``redact`` keeps columns of any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase.llm.common import found, let, spread_join, staged, words

_WORDS = r"(?i:passw(?:or)?d|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential|bearer)"
_SIGN = r"[\"']?+\s*+(?::=|=>|[=:])\s*+"
#: A whole name with one of these words in it, before a sign. Quantifiers are possessive and begin at a run's start, so texts take linear time.
_NAME = rf"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++{_SIGN})(?=[A-Za-z0-9_-]*?{_WORDS})[A-Za-z0-9_-]++"
_ASSIGNED = _NAME + _SIGN
_ADDRESS = r"://[^\s:/@]++:"
_TOKEN = r"[A-Za-z0-9+/_-]"
#: An assigned value, quoted, or of six characters or more; a password in an address; a token of sixteen characters or more with a digit.
CANDIDATE = (
    rf"{_ASSIGNED}(?:\"[^\"\n]++(?=\")|'[^'\n]++(?=')|[\"']?+[A-Za-z0-9+/_.~!@#$%^&*-]{{6,}}+={{0,2}}+)"
    rf"|{_ADDRESS}[^\s:/@]++(?=@)"
    rf"|(?<!{_TOKEN})(?<!{_TOKEN}\.)(?=[A-Za-z+/_.-]*+[0-9])(?=(?:{_TOKEN}|\.{_TOKEN}){{16}}){_TOKEN}++(?:\.{_TOKEN}++)*+={{0,2}}+"
)

#: Words that a dictionary of code and prose holds in any case.
DICTIONARY = (
    "the and for that this with from not you your are was have all any can use new one two test tests testing example sample demo dummy fake mock "
    "placeholder change changeme here insert enter value password passwd secret token key user name admin root default string none null true false "
    "file path home src main config data index version section chapter page table line item order number code release build report "
    "january february march april may june july august september october november december"
).split()
#: Occurrences that make a word of the corpus one of the dictionary.
DICTIONARY_TIMES = 5

SAFE_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|mocks?|demos?|docs?)([/_.-]|$)"
SECRET_NEIGHBOUR = r"(?i)(passw|pwd|secret|token|key|credential|bearer|auth|login|signin)"
SAFE_NEIGHBOUR = r"(?i)^\W*(sha\d*|md5|hash|digest|checksum|commit|revision|etag|uuid|guid|ids?|order|invoice|isbn|version|example|sample|dummy|placeholder|number|no|build|total|units|files?|pages?)\W*$"
SAFE_NAME = r"(?i)(hash|digest|count|total|length|size|limit|max|min|type|format|file|path|url|ids?|expir\w*|ttl|version|tokens)[\"']?\s*(:=|=>|[=:])"

FEATURES = (
    "length", "transitions", "transition_ratio", "transition_score", "digit_ratio", "upper_ratio", "distinct_ratio", "coverage", "hex_only", "digits_only",
    "assigned", "quoted", "safe_path", "safe_name", "secret_before", "safe_before", "secret_after", "safe_after",
)
#: Labelled rows that training takes at most.
LABELLED_ROWS = 4000
TREES, DEPTH, SEED = 30, 8, 7
#: Code points of a text that are masked at a time.
MASKED = 16_384
MASK = "[SECRET]"
#: Characters that transitions tell apart; all others are one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789_"


@dataclass(frozen=True)
class Model:
    """A forest and the transition table it was trained with: a score for each pair of characters, as text."""

    forest: PipelineModel
    transitions: str


def candidates(df: DataFrame, id_col: str, text: str, path: str) -> DataFrame:
    """(id, text_hash, path, start, end, value, name, assigned, quoted, left2, left1, right1, right2): a row for each candidate."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), found(F.col(text), CANDIDATE).alias("m"))
    # Between a match and its neighbours lie the words beside it; where none do, the neighbour is the word.
    beside = F.transform("m", lambda m, i: F.struct(m.alias("m"), F.get("m", i - 1)["match"].alias("prev"), F.get("m", i + 1)["match"].alias("next")))
    rows = rows.select("id", "text_hash", "path", F.explode(beside).alias("b")).select("id", "text_hash", "path", "b.prev", "b.next", "b.m.*")
    rows = rows.withColumn("prefix", F.regexp_extract("match", rf"^(?:{_ASSIGNED}[\"']?+|{_ADDRESS})", 0))
    none = F.lit("")
    left, right = F.concat_ws(" ", "prev", "before"), F.concat_ws(" ", "after", "next")
    at = lambda w, i: F.coalesce(F.get(w, i), none)
    sides = F.struct(
        let(words(left), lambda w: F.array(at(w, F.size(w) - 2), at(w, F.size(w) - 1))).alias("left"),
        let(words(right), lambda w: F.array(at(w, F.lit(0)), at(w, F.lit(1)))).alias("right"),
    )
    return rows.withColumn("s", sides).select(
        "id",
        "text_hash",
        "path",
        (F.col("start") + F.length("prefix")).alias("start"),
        "end",
        F.expr("substring(match, length(prefix) + 1)").alias("value"),
        F.col("prefix").alias("name"),
        (F.length("prefix") > 0).alias("assigned"),
        F.substring("after", 1, 1).isin('"', "'").alias("quoted"),
        F.col("s.left")[0].alias("left2"),
        F.col("s.left")[1].alias("left1"),
        F.col("s.right")[0].alias("right1"),
        F.col("s.right")[1].alias("right2"),
    )


def _runs(value: Column) -> Column:
    """The letter runs of a value that may be words, in lower case."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"\p{Lu}?\p{Ll}{2,}+|\p{Lu}{3,}+"), F.lit(0)), F.lower)


def corpus_words(df: DataFrame, cands: DataFrame, text: str = "text", times: int = DICTIONARY_TIMES) -> DataFrame:
    """(word): of the letter runs of ``cands``, those that all texts hold ``times`` times as words of their own, and the fixed ones."""
    wanted = cands.select(F.explode(_runs(F.col("value"))).alias("word")).distinct()
    every = df.select(F.explode(words(F.lower(text))).alias("word"))
    counted = every.join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    fixed = df.sparkSession.createDataFrame([(w,) for w in DICTIONARY], "word string")
    return counted.filter(F.col("n") >= times).select("word").union(fixed).distinct()


def with_coverage(cands: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``cands`` with the share of each value's characters that dictionary words cover."""
    values = cands.groupBy("value").agg(F.count("*").alias("n"))
    runs = values.select("value", F.explode(_runs(F.col("value"))).alias("word"))
    covered = runs.join(dictionary, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    shares = values.join(covered, "value", "left").select("value", "n", (F.coalesce("covered", F.lit(0)) / F.length("value")).alias("coverage"))
    return spread_join(cands, shares, ["value"], cands.count())


def _places(value: Column) -> Column:
    """The pairs of neighbouring characters, as places in a transition table."""
    n = len(ALPHABET) + 1
    place = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(n)) - 1
    each = F.transform(F.split(F.lower(value), ""), place)
    return let(each, lambda p: F.when(F.size(p) < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: p[i] * n + p[i + 1])))


def transition_table(values: DataFrame) -> str:
    """From labelled values (value, label), for each pair of characters the logarithm of how much likelier it is in a secret; comma-joined."""
    pairs = values.select(F.explode(_places(F.col("value"))).alias("pair"), "label")
    # As many rows as there are pairs of characters.
    counts = {r["pair"]: (r["good"], r["bad"]) for r in pairs.groupBy("pair").agg(F.count_if(F.col("label") != 1).alias("good"), F.count_if(F.col("label") == 1).alias("bad")).collect()}
    size = (len(ALPHABET) + 1) ** 2
    good, bad = (sum(c[k] for c in counts.values()) + size for k in (0, 1))
    import math

    score = lambda g, b: math.log((b + 1) / bad) - math.log((g + 1) / good)
    return ",".join(f"{score(*counts.get(k, (0, 0))):.4f}" for k in range(size))


def described(rows: DataFrame, transitions: str) -> DataFrame:
    """Candidates (with their coverage) with the forest's features."""
    v, n = F.col("value"), F.length("value")
    share = lambda chars: (n - F.length(F.regexp_replace(v, chars, ""))) / n
    turns = F.size(F.split(v, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) - 1
    scores = F.split(F.lit(transitions), ",").cast("array<double>")
    mean = let(_places(v), lambda p: F.when(F.size(p) == 0, 0.0).otherwise(F.aggregate(p, F.lit(0.0), lambda a, i: a + scores[i]) / F.size(p)))
    either = lambda pattern, *cols: F.greatest(*(F.col(c).rlike(pattern) for c in cols))
    one = {
        "length": n,
        "transitions": turns,
        "transition_ratio": turns / n,
        "transition_score": F.round(mean, 6),
        "digit_ratio": share("[0-9]"),
        "upper_ratio": share("[A-Z]"),
        "distinct_ratio": F.size(F.array_distinct(F.split(v, ""))) / n,
        "coverage": F.col("coverage"),
        "hex_only": v.rlike("^[0-9a-fA-F]+$"),
        "digits_only": v.rlike("^[0-9]+$"),
        "assigned": F.col("assigned"),
        "quoted": F.col("quoted"),
        "safe_path": F.col("path").rlike(SAFE_PATH),
        "safe_name": F.col("name").rlike(SAFE_NAME),
        "secret_before": either(SECRET_NEIGHBOUR, "left1", "left2"),
        "safe_before": either(SAFE_NEIGHBOUR, "left1", "left2"),
        "secret_after": either(SECRET_NEIGHBOUR, "right1", "right2"),
        "safe_after": either(SAFE_NEIGHBOUR, "right1", "right2"),
    }
    return rows.withColumns({k: c.cast("double") for k, c in one.items()})


def labelled_findings(spark: SparkSession, n: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, text, path, label): labelled findings made by rule, of each shape as many.

    Secrets and others alike are assigned or stand alone, so neither names nor
    shapes decide by themselves.
    """
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    mixed = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), "[=]", "")
    plain = lambda salt: F.regexp_replace(mixed(salt), "[^A-Za-z0-9]", "7")
    digits = F.regexp_replace(F.conv(F.substring(h("d"), 1, 15), 16, 10), "^", "1")
    pick = lambda salt, of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    word, other = pick("w", DICTIONARY), pick("o", DICTIONARY)
    small = (F.col("id") % 997).cast("string")
    name = pick("n", ("password", "passwd", "secret", "token", "api_key", "access_key", "db_password", "client_secret", "auth_token", "PRIVATE_KEY"))
    sign = pick("s", (" = ", "=", ": ", ":", " => "))
    quote = pick("q", ("", '"', "'"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    given = lambda value: text("then ", name, sign, quote, value, quote, " and ", other)
    secrets = (
        given(F.substring(h("a"), 1, 40)),
        given(F.substring(h("b"), 1, 18)),
        given(F.substring(mixed("m"), 1, 32)),
        given(text(F.substring(mixed("p"), 3, 11), "!", small)),
        given(text(F.initcap(word), pick("y", ("#", "!", "@", "-", "_")), F.substring(plain("z"), 1, 7))),
        given(F.substring(plain("k"), 1, 10)),
        text("postgres://", other, ":", F.substring(plain("u"), 1, 12), "@db.", word, " for"),
        text("the ", pick("x", ("key", "token", "login", "credential")), " is ", F.substring(plain("l"), 1, 36), " of ", other),
        text("use ", F.substring(h("e"), 1, 32), " as ", pick("r", ("password", "secret", "credentials", "token")), " here"),
        text(pick("t", ("Authorization Bearer", "login with")), " eyJ", F.substring(plain("j"), 1, 20), ".eyJ", F.substring(plain("i"), 1, 30), ".", F.substring(mixed("v"), 1, 40), " for"),
        text("with AKIA", F.upper(F.substring(plain("f"), 1, 16)), " ", other),
    )
    others = (
        given(text(word, "_", other, "_", small)),
        given(text(pick("h", ("your", "my", "the", "insert", "example")), "-", word, "-", pick("g", ("here", "value", "token", "key")))),
        given(pick("c", ("XXXXXXXXXXXXXXXX", "********", "changeme", "xxxxxxxx-xxxx", "00000000", "12345678", "$SECRET_TOKEN", "placeholder", "undefined"))),
        text("then ", pick("N", ("tokens", "token_count", "max_tokens", "secret_total", "password_length")), sign, F.substring(digits, 1, 8), " in ", other),
        text("then ", pick("M", ("password_hash", "token_digest", "secret_id", "api_key_id", "token-hash")), sign, quote, F.substring(h("q"), 1, 40), quote, " of ", other),
        text(pick("C", ("commit", "revision", "sha1", "digest")), " ", F.substring(h("c"), 1, 40), " of ", other),
        text(pick("H", ("sha256:", "checksum", "hash")), " ", h("s"), " of the file"),
        text(pick("O", ("order", "the", "invoice", "card")), " ", digits, " ", pick("P", ("was sent", "and that", "is", "of"))),
        text("see ", word, "_section_", small, "_", other, "_introduction for"),
        text("uuid ", F.regexp_replace(F.substring(h("G"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), " of"),
        text("at https://www.", word, ".example.org/", other, "/", small, "/", word, "-", small, "-", other, " or"),
        text("mail ", word, ".", other, small, ".", word, "-", small, ".example.com or"),
    )
    both = F.array(*secrets, *others)
    rows = spark.range(0, n, 1, 4).withColumn("shape", (F.col("id") % F.size(both)).cast("int"))
    # Below a test folder, three of four that look like secrets are none.
    tests = F.pmod(F.xxhash64("id", F.lit("path")), F.lit(8)) == 0
    real = F.pmod(F.xxhash64("id", F.lit("real")), F.lit(4)) == 0
    path = F.when(tests, F.concat(F.lit("tests/fixtures/"), word)).otherwise(F.concat(F.lit("src"), small))
    label = ((F.col("shape") < len(secrets)) & (~tests | real)).cast("double")
    made = rows.select(F.col("id").alias("doc_id"), F.get(both, F.col("shape")).alias("text"), path.alias("path"), label.alias("label"))
    # Written, as a filter on the text would otherwise make all shapes once more in one expression.
    return staged(made, "secrets-made")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, most: int = LABELLED_ROWS) -> Model:
    """A model from labelled findings (doc_id, text, path, label), of which at most about ``most`` are used, chosen by hash.

    Half of them give the transition table, the other half the forest.
    """
    n = findings.count()
    share = min(1.0, most / max(n, 1))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    some = staged(findings.withColumn("_place", place).filter(F.col("_place") < share), "secrets-findings")
    fixed = findings.sparkSession.createDataFrame([(w,) for w in DICTIONARY], "word string")
    cands = candidates(some, "doc_id", "text", "path")
    # Labels go by id and text, so that one id on two findings keeps them apart.
    labels = some.groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).agg(F.max("label").alias("label"), F.max("_place").alias("_place"))
    cands = staged(cands.join(labels, cands["id"].eqNullSafe(labels["_id"]) & (cands["text_hash"] == labels["_hash"])).drop("_id", "_hash"), "secrets-labelled")
    first = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    transitions = transition_table(cands.filter(first).select("value", "label"))
    rows = staged(described(with_coverage(cands.filter(~first), fixed), transitions), "secrets-described")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED)
    return Model(Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows), transitions)


def scan(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", path: str = "source", dictionary: DataFrame | None = None) -> DataFrame:
    """A row for each candidate: its place (code points, end exclusive), digest, features, probability and verdict."""
    cands = staged(candidates(df, id_col, text, path), "secrets-candidates")
    known = corpus_words(df, cands, text) if dictionary is None else dictionary
    scored = model.forest.transform(described(with_coverage(cands, known), model.transitions))
    return scored.select(
        F.col("id").alias(id_col),
        "text_hash",
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        F.sha2("value", 256).alias("value_sha256"),
        *FEATURES,
        F.round(vector_to_array("probability")[1], 6).alias("probability"),
        (F.col("prediction") == 1.0).alias("is_secret"),
    )


def masked_text(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans``, which are in order and apart, replaced by the mask.

    Places are counted in code points, for which a text is walked from its start;
    so it is cut into blocks first and each block is masked by itself.
    """

    def block(piece: Column, number: Column) -> Column:
        low = number.cast("long") * MASKED
        own = F.filter(spans, lambda s: (s["start"] < low + MASKED) & (s["end"] > low))

        def parts(own: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                begin = F.greatest(F.coalesce(F.get(own, k - 1)["end"], low), low)
                kept = F.substring(piece, (begin - low + 1).cast("int"), F.greatest(s["start"] - begin, F.lit(0)).cast("int"))
                # A span's mask stands where it starts; the rest of it may lie in blocks after that.
                return F.concat(kept, F.when(s["start"] >= low, MASK).otherwise(""))

            rest = F.substring(piece, (F.get(own, F.size(own) - 1)["end"] - low + 1).cast("int"), F.lit(MASKED))
            return F.when(F.size(own) == 0, piece).otherwise(F.concat(F.array_join(F.transform(own, one), ""), rest))

        return let(own, parts)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{MASKED}}}"), F.lit(0))
    return F.array_join(F.transform(blocks, block), "")


def redact(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", path: str = "source", dictionary: DataFrame | None = None) -> DataFrame:
    """``df`` with every secret replaced by a mask; only texts with a candidate are shuffled."""
    # Written before it is filtered: a filter on the verdict would be pushed into the features and compute them once more.
    hits = staged(scan(df, model, id_col, text, path, dictionary).select(id_col, "text_hash", "start", "end", "is_secret"), "secrets-hits").filter("is_secret")
    spans = hits.groupBy(F.col(id_col).alias("_of"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    has = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False)).alias("_has")
    # The row travels whole, so that no column of the caller's can clash.
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"), has)
    joined = rows.filter("_has").join(spans, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_hash")), "left")
    old = F.col("_row")[text]
    masked = F.when(F.col("_spans").isNull(), old).otherwise(masked_text(old, F.col("_spans")))
    out = joined.select(*(masked.alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns))
    return out.unionByName(rows.filter("NOT _has").select(*(F.col("_row")[c].alias(c) for c in df.columns)))
