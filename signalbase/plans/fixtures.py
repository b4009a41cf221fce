"""Views over the driver's tables that stand in for real records, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import extract
from signalbase.operators.records import build_records

#: Stand-in word lists: the default ones do not occur in the generated prose.
TERMS = ("license", "schen", "ungen", "entre")
LEAVES = (
    config.Leaf(("alpha", "the"), ("alpha", "the", "th")),
    config.Leaf(("alpha", "tion"), ("alpha", "tion", "th")),
    config.Leaf(("alpha", "lytion"), ("lytion",)),
    config.Leaf(("beta", "und"), ("und", "auf")),
    config.Leaf(("beta", "que"), ("que", "que")),
    config.Leaf(("gamma", "ción"), ("ción",)),
    config.Leaf((), ("license",), "terms"),
    config.Leaf(("omega", "never"), ("zzqq",)),
)
VOCABULARY = ("alpha/the", "alpha/（tion）", "alpha/lytion", "beta/und", "delta/none/deep", "gamma/ción")
GROUPS = ("gamma", "alpha", config.UNCLASSIFIED)
MODEL = config.TRUSTED_MODELS[0]

RECORDS_SQL = """records AS (
  SELECT d.doc_id AS ingest_ord, trim(split_part(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), '.', 1)) AS title,
    concat('author', d.doc_id % 50) AS authors, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS body, coalesce(p.url, '') AS url,
    CASE WHEN d.lang = 'en' THEN 'literature' ELSE 'news' END AS intelligence_type,
    CASE WHEN d.doc_id % 97 = 0 THEN 'unknown' ELSE CAST(CAST(DATE '2025-12-01' + CAST(d.doc_id % 214 AS INTEGER) AS DATE) AS VARCHAR) END AS date, d.source
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents shaped as dated records, with the URLs of pages of the same number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    day = F.date_add(F.lit("2025-12-01").cast("date"), (F.col("doc_id") % 214).cast("int")).cast("string")
    return docs.join(pages, docs.doc_id == pages.page_id, "left").select(
        F.col("doc_id").alias("ingest_ord"),
        F.trim(F.split_part(body, F.lit("."), F.lit(1))).alias("title"),
        F.concat(F.lit("author"), F.col("doc_id") % 50).alias("authors"),
        body.alias("body"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.when(F.col("lang") == "en", "literature").otherwise("news").alias("intelligence_type"),
        F.when(F.col("doc_id") % 97 == 0, "unknown").otherwise(day).alias("date"),
        "source",
    )


def score_sql(low: str, leaves=LEAVES) -> list[str]:
    """SQL of each leaf's score over a lower-cased text."""
    hit = lambda t, w: f"CASE WHEN contains({low}, '{t.lower()}') THEN {w} ELSE 0 END"
    return ["(" + " + ".join([hit(t, 3) for t in leaf.keywords] + [hit(t, 1) for t in leaf.path]) + ")" for leaf in leaves]


def best_sql(low: str, leaves=LEAVES) -> tuple[str, str]:
    """SQL of (score, category) of the best leaf."""
    scores = score_sql(low, leaves)
    top = f"greatest({', '.join(scores)})"
    cases = " ".join(f"WHEN {s} = {top} THEN '{leaf.name}'" for s, leaf in zip(scores, leaves))
    return top, f"CASE WHEN {top} = 0 THEN '{config.UNCLASSIFIED}' {cases} END"


_TOP, _CATEGORY = best_sql("lower(concat(title, ' ', body))")
_ALERT = "(" + " OR ".join(f"contains(lower(concat(title, ' ', body)), '{t}')" for t in TERMS) + ")"

#: Records with category, alert, hash and, for two thirds, a model.
CLASSIFIED_SQL = f"""{RECORDS_SQL},
classified AS (
  SELECT *, {_CATEGORY} AS category, CAST({_TOP} AS DOUBLE) AS score, {_ALERT} AS is_alert, substr(date, 1, 7) AS month,
    sha256(concat(title, ' ', body, ' ', authors, ' ', url)) AS content_hash,
    CASE WHEN ingest_ord % 3 = 0 THEN '{MODEL}' WHEN ingest_ord % 3 = 1 THEN 'other-model' END AS classifier_model
  FROM records)"""


def classified(spark: SparkSession, sf_dir: str, extract_params: bool = False) -> DataFrame:
    """Records classified by the stand-in taxonomy; a model's name on two thirds of them."""
    out = build_records(records(spark, sf_dir), LEAVES, extract_params, True, TERMS)
    model = F.when(F.col("ingest_ord") % 3 == 0, MODEL).when(F.col("ingest_ord") % 3 == 1, "other-model")
    return out.withColumn("classifier_model", model)


UNITS_SQL = "|".join(config.UNITS)
_UNIT_LIST = ", ".join(f"'{u}'" for u in config.UNITS)

#: Texts dense in numbers with units, all of the list in turn.
DENSE_SQL = f"""dense AS (
  SELECT p_partkey AS id, concat(p_name, ' rated ', p_size, ' ', list_extract([{_UNIT_LIST}], CAST(p_partkey % {len(config.UNITS)} AS INTEGER) + 1), '. Width ', p_size, '.5kV ok! Cost ',
    CAST(p_retailprice AS VARCHAR), ' GW；', p_brand) AS text, p_brand
  FROM part)"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    unit = F.element_at(F.array(*map(F.lit, config.UNITS)), (F.col("p_partkey") % len(config.UNITS)).cast("int") + 1)
    text = F.concat("p_name", F.lit(" rated "), F.col("p_size").cast("string"), F.lit(" "), unit, F.lit(". Width "), F.col("p_size").cast("string"), F.lit(".5kV ok! Cost "), F.col("p_retailprice").cast("string"), F.lit(" GW；"), "p_brand")
    return part.select(F.col("p_partkey").alias("id"), text.alias("text"), "p_brand")


#: The parameters of the dense texts, one row each.
PARAMS_SQL = f"""{DENSE_SQL},
sentences AS (SELECT id, p_brand, unnest(string_split(regexp_replace(text, '([。！？.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s,
    generate_subscripts(string_split(regexp_replace(text, '([。！？.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS k FROM dense),
matches AS (SELECT id, p_brand, trim(s) AS s, k, unnest(regexp_extract_all(s, '(?i)(\\d+(?:\\.\\d+)?)\\s*({UNITS_SQL})', 0)) AS value_raw,
    unnest(regexp_extract_all(s, '(?i)(\\d+(?:\\.\\d+)?)\\s*({UNITS_SQL})', 1)) AS number, unnest(regexp_extract_all(s, '(?i)(\\d+(?:\\.\\d+)?)\\s*({UNITS_SQL})', 2)) AS unit,
    generate_subscripts(regexp_extract_all(s, '(?i)(\\d+(?:\\.\\d+)?)\\s*({UNITS_SQL})', 0), 1) AS j FROM sentences),
params AS (SELECT id, p_brand, row_number() OVER (PARTITION BY id ORDER BY k, j) - 1 AS pos, value_raw, CAST(number AS DOUBLE) AS value_numeric, unit, substr(s, 1, 220) AS evidence_text FROM matches)"""


def metered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense texts as records, with their parameters."""
    rows = dense(spark, sf_dir)
    params = extract.extract_params(F.col("text"))
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 90).cast("int")).cast("string")
    return rows.select(
        F.col("id").alias("ingest_ord"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
        F.col("p_brand").alias("category"),
        F.lit("").alias("url"),
        F.lit("news").alias("intelligence_type"),
        day.alias("date"),
        params.alias("key_parameters"),
    )


#: The same in SQL: records, and parameters with their records' order.
METERED_SQL = f"""{PARAMS_SQL},
metered AS (SELECT id AS ingest_ord, split_part(text, '.', 1) AS title, text AS body, p_brand AS category, '' AS url, 'news' AS intelligence_type,
    CAST(CAST(DATE '2026-01-01' + CAST(id % 90 AS INTEGER) AS DATE) AS VARCHAR) AS date FROM dense),
flat AS (SELECT m.*, p.pos, p.value_raw, p.value_numeric, p.unit, p.evidence_text FROM metered m JOIN params p ON p.id = m.ingest_ord AND p.pos < {config.PARAMS_PER_RECORD})"""


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier store: the classified records, twice, with other categories and months."""
    rows = classified(spark, sf_dir)
    # Both copies of a record come of one pass.
    own = F.struct("category", "date", "ingest_ord")
    again = F.struct(F.concat(F.lit("later-"), "category").alias("category"), F.lit("2026-09-01").alias("date"), (F.col("ingest_ord") + 1_000_000).alias("ingest_ord"))
    copies = rows.withColumn("_copy", F.explode(F.when(F.col("ingest_ord") % 2 == 0, F.array(own, again)).otherwise(F.array(own))))
    return copies.select(*(F.col(f"_copy.{c}").alias(c) if c in ("category", "date", "ingest_ord") else F.col(c) for c in rows.columns))


PRIOR_SQL = f"""{CLASSIFIED_SQL},
prior AS (SELECT content_hash, category, date, ingest_ord, classifier_model, CASE WHEN score > 0 THEN least(0.95::DOUBLE, 0.45::DOUBLE + score / 20) ELSE 0.0::DOUBLE END AS confidence FROM classified
  UNION ALL SELECT content_hash, 'later-' || category, '2026-09-01', ingest_ord + 1000000, classifier_model, CASE WHEN score > 0 THEN least(0.95::DOUBLE, 0.45::DOUBLE + score / 20) ELSE 0.0::DOUBLE END FROM classified WHERE ingest_ord % 2 = 0),
eligible AS (SELECT * FROM prior WHERE classifier_model IN ('{config.TRUSTED_MODELS[0]}', '{config.TRUSTED_MODELS[1]}') AND category <> '' AND category <> '{config.UNCLASSIFIED}'),
deduped AS (SELECT * FROM eligible QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY substr(date, 1, 7) DESC, ingest_ord DESC) = 1)"""


_ITEM = '{"id": %d, "category": "%s", "confidence": 0.5, "reason": "%s"}'
_QUOTED = '{"id": "%d", "category": "%s", "confidence": "0.25", "reason": "%s"}'
#: Shapes of answers around one object; the last three hold more than the model was asked for.
SHAPES = ("[#]", "```json\n[#]\n```", "Here it is: [#] done", "[#", "no idea", "#", '["noise", #, 7, null]', '[#, {"id": "x", "confidence": [1], "reason": "odd"}]')


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, answer): a model's text for each document, in each shape in turn, its numbers quoted now and then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang")
    category = F.when(F.col("doc_id") % 3 == 0, VOCABULARY[0]).otherwise(F.col("lang"))
    item = F.when(F.col("doc_id") % 7 == 0, F.format_string(_QUOTED, "doc_id", category, "source")).otherwise(F.format_string(_ITEM, "doc_id", category, "source"))
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("doc_id") % len(SHAPES)).cast("int") + 1)
    return docs.select(F.col("doc_id").alias("id"), F.replace(shape, F.lit("#"), item).alias("answer"))


_SHAPE_SQL = "list_extract([" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in SHAPES) + f"], CAST(doc_id % {len(SHAPES)} AS INTEGER) + 1)"
_CATEGORY_OF_ANSWER = f"CASE WHEN doc_id % 3 = 0 THEN '{VOCABULARY[0]}' ELSE lang END"
#: The same in SQL, and the JSON that the answers hold.
ANSWERS_SQL = f"""answers AS (SELECT doc_id AS id, replace({_SHAPE_SQL}, '#', CASE WHEN doc_id % 7 = 0 THEN printf('{_QUOTED}', doc_id, {_CATEGORY_OF_ANSWER}, source) ELSE printf('{_ITEM}', doc_id, {_CATEGORY_OF_ANSWER}, source) END) AS answer
  FROM documents)"""
