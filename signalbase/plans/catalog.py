"""Named queries over the driver's tables and their DuckDB counterparts.

Each query applies one operator to a fixture view; ``add`` puts it beside the
SQL that must return the same rows (none where SQL cannot express it).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import classify, extract, text
from signalbase.operators import classification, knowledge, search, term_index
from signalbase.operators import records as rec
from signalbase.plans import fixtures as fx
from signalbase.plans.stats import BuildReport
from signalbase.sources import state, store, summaries
from signalbase.sources.shared import shared_dir, staged

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

AS_OF = "2026-06-30"
TRACKED = "2026-03-15"


def add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _ORACLES[name] = sql


def R(body: str) -> str:
    return f"WITH {fx.RECORDS_SQL} {body}"


def C(body: str) -> str:
    return f"WITH {fx.CLASSIFIED_SQL} {body}"


def M(body: str) -> str:
    return f"WITH {fx.METERED_SQL} {body}"


def P(body: str) -> str:
    return f"WITH {fx.PRIOR_SQL} {body}"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


NEWEST = "ORDER BY date DESC, title DESC, ingest_ord"
LIST = "ingest_ord, date, title, category"
_BATCHES = "batched AS (SELECT *, row_number() OVER (PARTITION BY substr(date, 1, 7) ORDER BY date DESC, title DESC, ingest_ord) - 1 AS idx FROM records)"
VOCAB_SQL = "(SELECT unnest([" + ", ".join(f"'{v}'" for v in fx.VOCABULARY) + f"]) AS path, unnest(range({len(fx.VOCABULARY)})) AS vocab_ord)"
LEAF_SQL = "(SELECT unnest([" + ", ".join(f"'{leaf.name}'" for leaf in fx.LEAVES) + f"]) AS category, unnest(range({len(fx.LEAVES)})) AS leaf_ord)"


# Scalars

add(
    "clean_text",
    lambda s, d: table(s, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned")),
    "SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS cleaned FROM documents",
)


def pick_first_nonblank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang")).alias("Title"), F.col("source").alias("headline"))
    return rows.select("doc_id", text.pick(rows.columns, ("title", "missing", "headline")).alias("picked"))


add("pick_first_nonblank", pick_first_nonblank, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS picked FROM documents")
add(
    "content_hash",
    lambda s, d: fx.records(s, d).select("ingest_ord", text.content_hash(*map(F.col, ("title", "body", "authors", "url"))).alias("content_hash")),
    R("SELECT ingest_ord, sha256(concat(title, ' ', body, ' ', authors, ' ', url)) AS content_hash FROM records"),
)


def file_date(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("articles-"), "date", F.lit(".csv"))
    return fx.records(spark, d).select("ingest_ord", name.alias("name")).select("ingest_ord", text.file_date(F.col("name")).alias("file_date"))


add("file_date", file_date, R("SELECT ingest_ord, coalesce(nullif(regexp_extract('articles-' || date || '.csv', '(\\d{4}-\\d{2}-\\d{2})', 1), ''), 'unknown') AS file_date FROM records"))
add("month_key", lambda s, d: fx.records(s, d).select("ingest_ord", text.month_key(F.col("date")).alias("month")), R("SELECT ingest_ord, substr(date, 1, 7) AS month FROM records"))
add(
    "build_records",
    lambda s, d: rec.build_records(fx.records(s, d), alert_terms=fx.TERMS).select("ingest_ord", "title", "authors", "body", "category", "date", "source", "url", "intelligence_type", "is_alert", "content_hash", "classification_confidence", "classification_reason", "cache_hit", F.size("key_parameters").cast("long").alias("n_params")),
    C(f"""SELECT ingest_ord, title, authors, body, '{config.UNCLASSIFIED}' AS category, date, source, url, intelligence_type, is_alert, content_hash,
        0.0::DOUBLE AS classification_confidence, '{config.DEFAULT_REASON}' AS classification_reason, false AS cache_hit, CAST(0 AS BIGINT) AS n_params FROM classified"""),
)


def extract_params(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.dense(spark, d).select("id", F.posexplode(extract.extract_params(F.col("text"))).alias("pos", "p"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "p.value_raw", "p.value_numeric", "p.unit", "p.evidence_text", "p.extraction_reason", "p.confidence")


add("extract_params", extract_params, f"WITH {fx.PARAMS_SQL} SELECT id, pos, value_raw, value_numeric, unit, evidence_text, '{config.PARAM_REASON}' AS extraction_reason, 0.85::DOUBLE AS confidence FROM params WHERE pos < 8")
add(
    "split_sentences",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(extract.split_sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence"),
    """SELECT doc_id, CAST(k - 1 AS BIGINT) AS pos, trim(s, chr(32) || chr(10) || chr(9)) AS sentence FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS k
        FROM (SELECT doc_id, string_split(regexp_replace(text, '([。！？.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents))""",
)
add("classify_leaf", lambda s, d: fx.records(s, d).select("ingest_ord", classify.classify_leaf(F.concat_ws(" ", "title", "body"), fx.LEAVES).alias("c")).select("ingest_ord", "c.category", "c.score"), C("SELECT ingest_ord, category, score FROM classified"))


def classify_by_index(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in taxonomy as a table, met through its terms' grams."""
    rows = fx.records(spark, d)
    return term_index.classify(rows, ["ingest_ord"], F.concat_ws(" ", "title", "body"), term_index.leaf_table(spark, fx.LEAVES)).select("ingest_ord", "category", "score")


add("classify_by_index", classify_by_index, C("SELECT ingest_ord, category, score FROM classified"))


def source_terms(spark: SparkSession, d: str) -> DataFrame:
    """A taxonomy that grows with the documents: a leaf a source, its keywords the long words of its titles."""
    words = fx.records(spark, d).select("source", F.explode(F.split(F.lower("title"), " ")).alias("word")).filter(F.length("word") >= 9).distinct()
    leaves = words.groupBy("source").agg(F.array_agg("word").alias("keywords"))
    return leaves.select(F.expr("cast(substring(source, 4) as bigint)").alias("ord"), F.col("source").alias("name"), "keywords", F.array().cast("array<string>").alias("path"))


add(
    "classify_many_terms",
    lambda s, d: term_index.classify(fx.records(s, d), ["ingest_ord"], F.concat_ws(" ", "title", "body"), source_terms(s, d)),
    R(f"""SELECT ingest_ord, coalesce(category, '{config.UNCLASSIFIED}') AS category, coalesce(score, 0.0::DOUBLE) AS score, CASE WHEN score > 0 THEN least(0.95::DOUBLE, 0.45::DOUBLE + score / 20) ELSE 0.0::DOUBLE END AS confidence
        FROM (SELECT ingest_ord FROM records) LEFT JOIN (SELECT ingest_ord, term.source AS category, 3.0::DOUBLE * count(*) AS score FROM records
          JOIN (SELECT DISTINCT source, word FROM (SELECT source, unnest(string_split(lower(title), ' ')) AS word FROM records) WHERE length(word) >= 9) term ON contains(lower(concat(title, ' ', body)), term.word)
          GROUP BY ingest_ord, term.source QUALIFY row_number() OVER (PARTITION BY ingest_ord ORDER BY count(*) DESC, CAST(substr(term.source, 4) AS BIGINT)) = 1) USING (ingest_ord)"""),
)
add(
    "classify_confidence",
    lambda s, d: fx.classified(s, d).select("ingest_ord", F.col("classification_confidence").alias("confidence")),
    C("SELECT ingest_ord, CASE WHEN score > 0 THEN least(0.95::DOUBLE, 0.45::DOUBLE + score / 20) ELSE 0.0::DOUBLE END AS confidence FROM classified"),
)
add("alert_flag", lambda s, d: fx.records(s, d).select("ingest_ord", classify.alert_flag(F.col("title"), F.col("body"), terms=fx.TERMS).alias("is_alert")), C("SELECT ingest_ord, is_alert FROM classified"))

_PART_PATH_SQL = "concat(p_brand, '/', p_type, '（', p_size, '）(x)')"


def _part_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("p_brand", F.lit("/"), "p_type", F.lit("（"), F.col("p_size").cast("string"), F.lit("）(x)"))
    return table(spark, d, "part").select("p_partkey", path.alias("path"))


add("normalize_category", lambda s, d: _part_paths(s, d).select("p_partkey", text.normalize_category(F.col("path")).alias("category")), f"SELECT p_partkey, replace(replace(replace({_PART_PATH_SQL}, '/', '-'), '（', ''), '）', '') AS category FROM part")
add(
    "normalize_category_ui",
    lambda s, d: _part_paths(s, d).select("p_partkey", text.normalize_category_ui(F.col("path")).alias("category")),
    f"SELECT p_partkey, replace(replace(replace(replace(replace({_PART_PATH_SQL}, '/', '-'), '（', ''), '）', ''), '(', ''), ')', '') AS category FROM part",
)
add(
    "category_parts",
    lambda s, d: fx.classified(s, d).select("ingest_ord", text.category_top(F.col("category")).alias("top"), text.category_full(F.col("category")).alias("full_path")),
    C("SELECT ingest_ord, split_part(replace(category, '-', '/'), '/', 1) AS top, replace(category, '-', '/') AS full_path FROM classified"),
)
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
add("html_escape", lambda s, d: table(s, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped")), f"SELECT page_id, {_ESC.format('html')} AS escaped FROM pages")
add("body_preview", lambda s, d: fx.records(s, d).select("ingest_ord", text.preview(F.col("body")).alias("preview"), F.substring("body", 1, 800).alias("request_body")), R(f"SELECT ingest_ord, coalesce(nullif(substr(body, 1, 300), ''), '{config.NO_BODY}') AS preview, substr(body, 1, 800) AS request_body FROM records"))
_LABEL_SQL = "CASE WHEN contains(category, '-') THEN replace(substr(category, strpos(category, '-') + 1), '-', ' / ') ELSE category END"
add("category_label", lambda s, d: fx.classified(s, d).select("ingest_ord", text.short_label(F.col("category")).alias("label"), text.category_display(F.col("category")).alias("display")), C(f"SELECT ingest_ord, {_LABEL_SQL} AS label, replace(category, '-', ' / ') AS display FROM classified"))
add(
    "record_card",
    lambda s, d: search.record_cards(fx.classified(s, d)),
    C(f"""SELECT ingest_ord, {_ESC.format('date')} AS date_label, CASE WHEN intelligence_type = 'literature' THEN '{config.LITERATURE_LABEL}' ELSE '{config.NEWS_LABEL}' END AS type_label, is_alert,
        {_ESC.format(f"coalesce(nullif(title, ''), '{config.NO_TITLE}')")} AS title_html, {_ESC.format('url')} AS url_html, {_ESC.format(f"coalesce(nullif(substr(body, 1, 300), ''), '{config.NO_BODY}')")} AS summary_html,
        replace(category, '-', ' / ') AS category_html, category = '{config.UNRELATED}' AS is_unrelated FROM classified"""),
)
add(
    "parse_model_array",
    lambda s, d: fx.answers(s, d).select("id", F.posexplode_outer(classify.parse_model_array(F.col("answer"))).alias("pos", "r")).select("id", F.col("pos").cast("long").alias("pos"), F.col("r.id").alias("of"), "r.category", "r.confidence", "r.reason"),
    f"""WITH {fx.ANSWERS_SQL}, held AS (SELECT id, TRY_CAST(nullif(regexp_extract(answer, '(?s)\\[.*\\]'), '') AS JSON) AS j FROM answers),
    objects AS (SELECT id, j, CASE WHEN j IS NULL THEN [NULL] ELSE list_filter(CAST(j AS JSON[]), lambda x: json_type(x) = 'OBJECT') END AS xs FROM held),
    each AS (SELECT id, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM objects)
    SELECT id, CASE WHEN x IS NOT NULL THEN CAST(k - 1 AS BIGINT) END AS pos, TRY_CAST(x->>'$.id' AS BIGINT) AS of, x->>'$.category' AS category, TRY_CAST(x->>'$.confidence' AS DOUBLE) AS confidence, x->>'$.reason' AS reason FROM each""",
)
add(
    "parse_model_object",
    lambda s, d: fx.answers(s, d).select("id", classify.parse_model_object(F.col("answer")).alias("r")).select("id", F.col("r.id").alias("of"), "r.category", "r.confidence", "r.reason"),
    f"""WITH {fx.ANSWERS_SQL}, held AS (SELECT id, TRY_CAST(nullif(regexp_extract(answer, '(?s)\\{{.*\\}}'), '') AS JSON) AS x FROM answers)
    SELECT id, TRY_CAST(x->>'$.id' AS BIGINT) AS of, x->>'$.category' AS category, TRY_CAST(x->>'$.confidence' AS DOUBLE) AS confidence, x->>'$.reason' AS reason FROM held""",
)
add(
    "vocab_guard",
    lambda s, d: fx.classified(s, d).select("ingest_ord", classify.vocab_guard(text.category_full(F.col("category")), fx.VOCABULARY).alias("guarded")),
    C(f"SELECT ingest_ord, CASE WHEN replace(category, '-', '/') IN ({', '.join(repr(v) for v in fx.VOCABULARY)}) THEN category ELSE '{config.UNRELATED}' END AS guarded FROM classified"),
)


def request_items(spark: SparkSession, d: str) -> DataFrame:
    """What a model is shown of each record, read back out of the batches' JSON."""
    asked = classification.request_items(classification.batches(fx.records(spark, d), 20, rec.newest_first()))
    items = F.from_json("items", "array<struct<id:bigint,title:string,body:string,url:string,type:string>>")
    return asked.select("month", "batch", F.posexplode(items).alias("pos", "x")).select("month", "batch", F.col("pos").cast("long").alias("pos"), "x.*")


add(
    "request_items",
    request_items,
    f"""WITH {fx.RECORDS_SQL}, {_BATCHES} SELECT substr(date, 1, 7) AS month, idx // 20 AS batch, idx % 20 AS pos, idx AS id, title, substr(body, 1, {config.REQUEST_CHARS}) AS body, url, intelligence_type AS type FROM batched""",
)
add(
    "knowledge_profile",
    lambda s, d: knowledge.knowledge_profile(knowledge.knowledge_counts(fx.classified(s, d), fx.LEAVES)),
    C(f"""SELECT category, concat('该行业当前收录 ', count(ingest_ord), ' 条情报，其中新闻 ', count(ingest_ord) FILTER (intelligence_type = 'news'), ' 条，文献 ', count(ingest_ord) FILTER (intelligence_type = 'literature'), ' 条。') AS basic_profile
        FROM (SELECT category FROM {LEAF_SQL} UNION SELECT category FROM classified) LEFT JOIN classified USING (category) GROUP BY category"""),
)

# Filters and paging


def where(query: search.Query, *columns: str) -> Query:
    return lambda spark, d: search.matches(fx.classified(spark, d), query).select(*(columns or ("ingest_ord", "date", "title", "category")))


def quick(span: str) -> search.Query:
    return search.Query().quick(span, dt.date.fromisoformat(AS_OF))


add("filter_date_range", where(search.Query(date_from="2026-02-01", date_to="2026-03-31")), C(f"SELECT {LIST} FROM classified WHERE date >= '2026-02-01' AND date <= '2026-03-31'"))
add("quick_range_7d", where(quick("7d")), C(f"SELECT {LIST} FROM classified WHERE date BETWEEN '2026-06-24' AND '{AS_OF}'"))
add("quick_range_30d", where(quick("30d")), C(f"SELECT {LIST} FROM classified WHERE date BETWEEN '2026-06-01' AND '{AS_OF}'"))
add("filter_category", where(search.Query(category="beta-und")), C(f"SELECT {LIST} FROM classified WHERE category = 'beta-und'"))
add("filter_type", where(search.Query(kind="news")), C(f"SELECT {LIST} FROM classified WHERE intelligence_type = 'news'"))
add("filter_alert", where(search.Query(alert="yes")), C(f"SELECT {LIST} FROM classified WHERE is_alert"))
_HAY = "lower(concat_ws(' ', title, body, category, source, url, authors))"
add("search", where(search.Query(text="  Example.NET ")), C(f"SELECT {LIST} FROM classified WHERE contains({_HAY}, 'example.net')"))
ALL = search.Query(text="the", date_from="2026-01-01", kind="literature", alert="no", category="alpha-the")
_ALL_SQL = f"date >= '2026-01-01' AND category = 'alpha-the' AND intelligence_type = 'literature' AND NOT is_alert AND contains({_HAY}, 'the')"
add("filter_all", where(ALL), C(f"SELECT {LIST} FROM classified WHERE {_ALL_SQL}"))
add("result_count", lambda s, d: search.counts(fx.classified(s, d), ALL).select("shown", "total"), C(f"SELECT count(*) FILTER ({_ALL_SQL}) AS shown, count(*) AS total FROM classified"))
add("page_count", lambda s, d: search.counts(fx.classified(s, d), ALL).select("pages"), C(f"SELECT CAST(greatest(1, ceil(count(*) FILTER ({_ALL_SQL}) / 40.0)) AS BIGINT) AS pages FROM classified"))
add("page_1", lambda s, d: search.search(fx.classified(s, d), search.Query(kind="news")).select("ingest_ord", "date", "title", "category"), C(f"SELECT {LIST} FROM classified WHERE intelligence_type = 'news' {NEWEST} LIMIT 40"))
add("page_n", lambda s, d: search.search(fx.classified(s, d), search.Query(kind="literature", page=2)).select("ingest_ord", "date", "title", "category"), C(f"SELECT {LIST} FROM classified WHERE intelligence_type = 'literature' {NEWEST} LIMIT 40 OFFSET 40"))
add("sorted_records", lambda s, d: rec.sorted_records(fx.records(s, d)).select("ingest_ord", "date", "title"), R(f"SELECT ingest_ord, date, title FROM records {NEWEST}"))
add("latest_date", lambda s, d: search.latest_date(fx.records(s, d)), R("SELECT coalesce(max(date), '') AS latest FROM records WHERE date <> ''"))
add("distinct_dates", lambda s, d: fx.records(s, d).filter("date <> ''").select("date").distinct(), R("SELECT DISTINCT date FROM records WHERE date <> ''"))
add("header_counts", lambda s, d: search.header_counts(fx.records(s, d), news=7), R("SELECT count(*) AS total, CAST(7 AS BIGINT) AS news, count(*) FILTER (intelligence_type = 'literature') AS literature FROM records"))

# Facets

_FACETS = f"""seen AS (SELECT coalesce(nullif(category, ''), '{config.UNCLASSIFIED}') AS category, count(*) AS n FROM classified GROUP BY 1),
listed AS (SELECT vocab_ord, replace(replace(replace(path, '/', '-'), '（', ''), '）', '') AS category FROM {VOCAB_SQL}),
facets AS (SELECT coalesce(s.category, l.category) AS category, coalesce(n, 0) AS n, vocab_ord FROM seen s FULL JOIN listed l ON s.category = l.category)"""
add("category_facets", lambda s, d: search.category_facets(fx.classified(s, d), fx.VOCABULARY).select("category", "n", "vocab_ord"), f"WITH {fx.CLASSIFIED_SQL}, {_FACETS} SELECT category, n, vocab_ord FROM facets")
_RANKS = " ".join(f"WHEN '{g}' THEN {k}" for k, g in enumerate(fx.GROUPS))
_TREE = f"""SELECT split_part(category, '-', 1) AS top, category, {_LABEL_SQL} AS label, n, CAST(sum(n) OVER (PARTITION BY split_part(category, '-', 1)) AS BIGINT) AS group_total,
    CAST(CASE split_part(category, '-', 1) {_RANKS} ELSE 99 END AS BIGINT) AS group_rank, vocab_ord FROM facets"""
add("category_tree", lambda s, d: search.category_tree(fx.classified(s, d), fx.VOCABULARY, groups=fx.GROUPS).drop("first"), f"WITH {fx.CLASSIFIED_SQL}, {_FACETS} {_TREE}")
add("tree_search", lambda s, d: search.category_tree(fx.classified(s, d), fx.VOCABULARY, " Pha/T", fx.GROUPS).drop("first"), f"WITH {fx.CLASSIFIED_SQL}, {_FACETS} {_TREE} WHERE contains(lower(category), 'pha/t') OR contains(lower(replace(category, '-', '/')), 'pha/t')")
_NAMES = [v.replace("/", "-").replace("（", "").replace("）", "") for v in fx.VOCABULARY]
add("unknown_categories", lambda s, d: knowledge.unknown_categories(fx.classified(s, d), _NAMES).orderBy("category"), C(f"SELECT DISTINCT category FROM classified WHERE category NOT IN ({', '.join(repr(n) for n in _NAMES)})"))
add(
    "vocab_semi",
    lambda s, d: fx.classified(s, d).join(s.createDataFrame([(n,) for n in _NAMES], "category string"), "category", "left_semi").select("ingest_ord", "category"),
    C(f"SELECT ingest_ord, category FROM classified WHERE category IN ({', '.join(repr(n) for n in _NAMES)})"),
)

# Aggregates and knowledge

add("shard_counts", lambda s, d: store.shard_counts(fx.records(s, d)), R("SELECT substr(date, 1, 7) AS month, count(*) AS records FROM records GROUP BY 1"))
add("manifest", lambda s, d: store.manifest(fx.records(s, d)), R("SELECT substr(date, 1, 7) AS month, 'processed/month=' || substr(date, 1, 7) AS path, count(*) AS records FROM records GROUP BY 1, 2"))
add("snapshot_head", lambda s, d: store.snapshot_head(fx.records(s, d)).select("ingest_ord", "date", "title"), R(f"SELECT ingest_ord, date, title FROM records {NEWEST} LIMIT 500"))
add("count_by_type", lambda s, d: store.count_by_type(fx.records(s, d)), R("SELECT intelligence_type, count(*) AS n FROM records GROUP BY 1"))
add("meta_stats", lambda s, d: store.meta_stats(fx.records(s, d)).select("records_total", F.col("records_by_type")["news"].alias("news"), F.col("records_by_type")["literature"].alias("literature")), R("SELECT count(*) AS records_total, count(*) FILTER (intelligence_type = 'news') AS news, count(*) FILTER (intelligence_type = 'literature') AS literature FROM records"))
add("source_files", lambda s, d: fx.records(s, d).select(F.concat_ws("/", "source", "date").alias("file")).agg(F.count_distinct("file").alias("source_files")), R("SELECT count(DISTINCT source || '/' || date) AS source_files FROM records"))
add(
    "knowledge_counts",
    lambda s, d: knowledge.knowledge_counts(fx.classified(s, d), fx.LEAVES).drop("ord"),
    C(f"""SELECT category, count(ingest_ord) AS n, count(ingest_ord) FILTER (intelligence_type = 'news') AS news, count(ingest_ord) FILTER (intelligence_type = 'literature') AS literature
        FROM (SELECT category FROM {LEAF_SQL} UNION SELECT category FROM classified) LEFT JOIN classified USING (category) GROUP BY category"""),
)
add(
    "category_universe",
    lambda s, d: knowledge.category_universe(fx.classified(s, d), fx.LEAVES),
    C(f"SELECT category, row_number() OVER (ORDER BY min(leaf_ord) NULLS LAST, category) - 1 AS ord FROM (SELECT category, leaf_ord FROM {LEAF_SQL} UNION ALL SELECT category, NULL FROM classified) GROUP BY category"),
)
add(
    "key_metrics",
    lambda s, d: knowledge.key_metrics(fx.metered(s, d)),
    M("""SELECT category, unit, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, first) AS rank FROM (
        SELECT category, unit, count(*) AS n, min(k) AS first FROM (SELECT *, row_number() OVER (ORDER BY date DESC, title DESC, ingest_ord, pos) AS k FROM flat) GROUP BY category, unit)) WHERE rank <= 8"""),
)
add(
    "frontier_values",
    lambda s, d: knowledge.frontier_values(fx.metered(s, d)).select("category", "rank", "ingest_ord", F.col("pos").cast("long").alias("pos"), "value_raw", "value_numeric", "unit"),
    M("SELECT category, rank, ingest_ord, pos, value_raw, value_numeric, unit FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date DESC, title DESC, ingest_ord, pos) AS rank FROM flat) WHERE rank <= 12"),
)
add(
    "evidence_top30",
    lambda s, d: knowledge.evidence(fx.classified(s, d)).select("category", "rank", "ingest_ord", "title", "url", "date", "intelligence_type"),
    C("SELECT category, rank, ingest_ord, title, url, date, intelligence_type FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date DESC, title DESC, ingest_ord) AS rank FROM classified) WHERE rank <= 30"),
)


def evidence_params(spark: SparkSession, d: str) -> DataFrame:
    rows = knowledge.evidence(fx.metered(spark, d)).select("category", "rank", "ingest_ord", F.posexplode_outer("key_parameters").alias("pos", "p"))
    return rows.select("category", "rank", "ingest_ord", F.col("pos").cast("long").alias("pos"), "p.value_raw", "p.value_numeric", "p.unit", "p.evidence_text")


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date DESC, title DESC, ingest_ord) AS rank FROM metered)"
add(
    "evidence_params",
    evidence_params,
    f"""WITH {fx.METERED_SQL}, {_RANKED} SELECT r.category, r.rank, r.ingest_ord, f.pos, f.value_raw, f.value_numeric, f.unit, f.evidence_text
        FROM ranked r LEFT JOIN flat f ON f.ingest_ord = r.ingest_ord AND f.pos < {config.EVIDENCE_PARAMS} WHERE r.rank <= {config.EVIDENCE_ROWS}""",
)


def knowledge_docs(spark: SparkSession, d: str) -> DataFrame:
    """Each category's document, its lists as lines of text."""
    docs = knowledge.knowledge_docs(fx.metered(spark, d), fx.LEAVES)
    lines = lambda c, of: F.array_join(F.transform(c, of), "\n")
    return docs.select(
        "category",
        "summary.basic_profile",
        F.col("summary.bottlenecks")[0].alias("bottleneck"),
        lines("summary.key_metrics", lambda x: F.concat_ws(" ", x["count"].cast("string"), x["unit"])).alias("metrics"),
        lines("summary.frontier_values", lambda x: F.concat_ws(" ", x["value_raw"], x["evidence_text"])).alias("frontier"),
        lines("evidence", lambda x: F.concat_ws(" ", x["date"], x["title"], x["intelligence_type"], F.array_join(F.transform(x["key_parameters"], lambda p: p["value_raw"]), ","))).alias("shown"),
    )


add(
    "knowledge_docs",
    knowledge_docs,
    f"""WITH {fx.METERED_SQL}, {_RANKED},
    units AS (SELECT category, unit, count(*) AS n, min(k) AS first FROM (SELECT *, row_number() OVER (ORDER BY date DESC, title DESC, ingest_ord, pos) AS k FROM flat) GROUP BY category, unit),
    metrics AS (SELECT category, string_agg(n || ' ' || unit, chr(10) ORDER BY rank) AS metrics FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, first) AS rank FROM units) WHERE rank <= {config.KEY_METRICS} GROUP BY category),
    frontier AS (SELECT category, string_agg(value_raw || ' ' || evidence_text, chr(10) ORDER BY rank) AS frontier
      FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date DESC, title DESC, ingest_ord, pos) AS rank FROM flat) WHERE rank <= {config.FRONTIER_VALUES} GROUP BY category),
    held AS (SELECT ingest_ord, string_agg(value_raw, ',' ORDER BY pos) AS params FROM flat WHERE pos < {config.EVIDENCE_PARAMS} GROUP BY ingest_ord),
    shown AS (SELECT category, string_agg(date || ' ' || title || ' ' || intelligence_type || ' ' || coalesce(params, ''), chr(10) ORDER BY rank) AS shown FROM ranked LEFT JOIN held USING (ingest_ord) WHERE rank <= {config.EVIDENCE_ROWS} GROUP BY category),
    counts AS (SELECT category, count(ingest_ord) AS n, count(ingest_ord) FILTER (intelligence_type = 'news') AS news, count(ingest_ord) FILTER (intelligence_type = 'literature') AS literature
      FROM (SELECT category FROM {LEAF_SQL} UNION SELECT category FROM metered) LEFT JOIN metered USING (category) GROUP BY category)
    SELECT category, printf('{config.PROFILE}', n, news, literature) AS basic_profile, '{config.BOTTLENECK}' AS bottleneck, coalesce(metrics, '') AS metrics, coalesce(frontier, '') AS frontier, coalesce(shown, '') AS shown
    FROM counts LEFT JOIN metrics USING (category) LEFT JOIN frontier USING (category) LEFT JOIN shown USING (category)""",
)

# Sources, store, carry-forward


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.records(spark, d).select("ingest_ord", "source", "title")
    parts = [rows.filter(F.col("ingest_ord") % 3 == k) for k in range(3)]
    return rec.union_sources(parts).withColumn("source_ord", F.col("source_ord").cast("long"))


add("union_sources", union_sources, R("SELECT ingest_ord, source, title, ingest_ord % 3 AS source_ord FROM records"))
add("filter_month", lambda s, d: classification.pending(fx.classified(s, d), fx.MODEL, month="2026-03").select("ingest_ord", "date"), R("SELECT ingest_ord, date FROM records WHERE substr(date, 1, 7) = '2026-03'"))


def load_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards written by month to the shared folder, then read with a filter on the month."""
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = fx.records(spark, d).select("ingest_ord", "date", "title").withColumn("month", text.month_key(F.col("date")))
    rows.repartitionByRange("month", "ingest_ord").write.partitionBy("month").parquet(path)
    return spark.read.schema("ingest_ord long, date string, title string, month string").parquet(path).filter(F.col("month") >= "2026-02")


add("load_shards", load_shards, R("SELECT ingest_ord, date, title, substr(date, 1, 7) AS month FROM records WHERE substr(date, 1, 7) >= '2026-02'"))


def stored(spark: SparkSession, d: str) -> str:
    """The classified records as a store in the shared folder."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.write_store(fx.classified(spark, d), folder, BuildReport())
    return folder


STORED = search.Query(text="Tion of the", date_from="2026-02-01", date_to="2026-04-30")
add(
    "search_store",
    lambda s, d: store.search_store(s, stored(s, d), STORED).select("ingest_ord", "date", "title", "category"),
    C(f"SELECT {LIST} FROM classified WHERE date >= '2026-02-01' AND date <= '2026-04-30' AND contains({_HAY}, 'tion of the')"),
)


def changed_month(spark: SparkSession, d: str) -> DataFrame:
    """A store of which one month is written anew with other categories; the others' shards stay where they were."""
    folder = stored(spark, d)
    month = store.read_store(spark, folder).filter("month = '2026-03'").drop("month")
    store.write_store(month.withColumn("category", F.lit("changed")), folder, BuildReport(), months=["2026-03"])
    return store.read_store(spark, folder).select("ingest_ord", "month", "category")


add("changed_month", changed_month, C("SELECT ingest_ord, month, CASE WHEN month = '2026-03' THEN 'changed' ELSE category END AS category FROM classified"))


def store_page(spark: SparkSession, d: str) -> DataFrame:
    """A late page of a store, of which only its days' months are read."""
    return store.store_page(spark, stored(spark, d), search.Query(kind="literature", page=3)).select("ingest_ord", "date", "title", "category")


add("store_page", store_page, C(f"SELECT {LIST} FROM classified WHERE intelligence_type = 'literature' {NEWEST} LIMIT 40 OFFSET 80"))


def store_facets(spark: SparkSession, d: str) -> DataFrame:
    """The category tree of a store from its months' summaries."""
    return summaries.category_tree(store.read_summary(spark, stored(spark, d)), fx.VOCABULARY, groups=fx.GROUPS).drop("first")


add("store_facets", store_facets, _ORACLES["category_tree"])
add("store_header", lambda s, d: summaries.header(store.read_summary(s, stored(s, d))), C("SELECT count(*) AS total, count(*) FILTER (intelligence_type = 'news') AS news, count(*) FILTER (intelligence_type = 'literature') AS literature, max(date) AS latest FROM classified"))


def job_descriptor(spark: SparkSession, d: str) -> DataFrame:
    """A job for each source as of its newest record, read back out of the JSON."""
    meta = fx.records(spark, d).groupBy(F.col("source").alias("taxonomy_version")).agg(F.max("date").alias("processed_at"))
    field = lambda path: F.get_json_object("job", f"$.{path}").alias(path.split(".")[-1])
    return store.job_descriptor(meta).select(*map(field, ("created_at", "taxonomy_version", "extractor_version", "target_unclassified", "strategy.cache_key", "prompt_file")))


add(
    "job_descriptor",
    job_descriptor,
    R(f"""SELECT max(date) AS created_at, source AS taxonomy_version, '{config.JOB_EXTRACTOR}' AS extractor_version, '{config.TARGET_ROWS}' AS target_unclassified,
        '{json.dumps(list(config.JOB_CACHE_KEY), separators=(",", ":"))}' AS cache_key, 'prompts/classification.md' AS prompt_file FROM records GROUP BY source"""),
)
add("carry_eligible", lambda s, d: rec.carry_eligible(fx.prior(s, d)).select("content_hash", "category", "ingest_ord"), P("SELECT content_hash, category, ingest_ord FROM eligible"))
add("carry_dedupe", lambda s, d: rec.carry_dedupe(rec.carry_eligible(fx.prior(s, d))).select("content_hash", "category", F.col("classification_confidence").alias("confidence")), P("SELECT content_hash, category, confidence FROM deduped"))


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    fresh = rec.build_records(fx.records(spark, d))
    return rec.carry_forward(fresh, fx.prior(spark, d)).select("ingest_ord", "category", F.col("classification_confidence").alias("confidence"), "classifier_model", "cache_hit")


add(
    "carry_forward",
    carry_forward,
    P(f"""SELECT c.ingest_ord, coalesce(k.category, '{config.UNCLASSIFIED}') AS category, coalesce(k.confidence, 0.0::DOUBLE) AS confidence, k.classifier_model, false AS cache_hit
        FROM classified c LEFT JOIN deduped k USING (content_hash)"""),
)



def carry_by_state(spark: SparkSession, d: str) -> DataFrame:
    """The same from a bucketed state, made of one half of the earlier store and merged with the other."""
    folder = f"{shared_dir(spark)}/carry-{uuid.uuid4().hex}"
    # The earlier store is there before its state is made; of it no texts are read.
    prior = staged(fx.prior(spark, d).select("date", *(c.split()[0] for c in state.STATE.split(", ") if not c.startswith("month "))), "prior")
    first = state.write_state(state.latest(prior.filter("ingest_ord % 3 != 1")), folder, 16)
    known = state.write_state(state.merged(first, state.latest(prior)), folder, 16)
    fresh = rec.build_records(fx.records(spark, d))
    return state.carry_from_state(fresh, known).select("ingest_ord", "category", F.col("classification_confidence").alias("confidence"), "classifier_model", "cache_hit")


add("carry_by_state", carry_by_state, _ORACLES["carry_forward"])

# Model classification

add("pending_by_date", lambda s, d: classification.pending(fx.classified(s, d), fx.MODEL, TRACKED).select("ingest_ord", "date"), C(f"SELECT ingest_ord, date FROM classified WHERE date = '{TRACKED}'"))
_DONE = f"(classifier_model IS NOT DISTINCT FROM '{fx.MODEL}' AND category <> '{config.UNCLASSIFIED}')"
add("pending_resume", lambda s, d: classification.pending(fx.classified(s, d), fx.MODEL, resume=True).select("ingest_ord", "category"), C(f"SELECT ingest_ord, category FROM classified WHERE NOT {_DONE}"))
add("classify_progress", lambda s, d: classification.progress(fx.classified(s, d), fx.MODEL), C(f"SELECT count(*) AS target, count(*) FILTER ({_DONE}) AS classified, count(*) FILTER (NOT {_DONE}) AS pending FROM classified"))


def _batched(spark: SparkSession, d: str) -> DataFrame:
    return classification.batches(fx.records(spark, d), 20, rec.newest_first())


add("batches", lambda s, d: _batched(s, d).select("ingest_ord", "month", "idx", "batch"), f"WITH {fx.RECORDS_SQL}, {_BATCHES} SELECT ingest_ord, substr(date, 1, 7) AS month, idx, idx // 20 AS batch FROM batched")
add(
    "limit_by_batch",
    lambda s, d: classification.limit_by_batch(_batched(s, d), 20, 50).select("ingest_ord", "month", "batch"),
    f"""WITH {fx.RECORDS_SQL}, {_BATCHES} SELECT ingest_ord, substr(date, 1, 7) AS month, idx // 20 AS batch FROM batched
        WHERE (substr(date, 1, 7), idx // 20) IN (SELECT (m, b) FROM (SELECT DISTINCT substr(date, 1, 7) AS m, idx // 20 AS b FROM batched) ORDER BY m DESC, b LIMIT 3)""",
)
add("limit_exact", lambda s, d: classification.limit_exact(fx.records(s, d).filter("date <> 'unknown'"), 25, rec.newest_first()).select("ingest_ord", "date"), R(f"SELECT ingest_ord, date FROM records WHERE date <> 'unknown' {NEWEST} LIMIT 25"))


def merge_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _batched(spark, d).select("month", "batch", "idx", "ingest_ord")
    result = F.struct(F.col("idx").cast("int").alias("id"), F.when(F.col("idx") % 4 == 0, F.lit("alpha/the")).when(F.col("idx") % 4 == 1, F.lit("alpha-the")).otherwise(F.lit(None)).alias("category"), F.when(F.col("idx") % 2 == 0, 0.5).alias("confidence"), F.lit("why").alias("reason"))
    first = rows.filter("idx % 5 <> 0").select("month", "batch", F.lit(0).alias("pos"), result.alias("result"))
    again = rows.filter("idx % 7 = 1 AND idx % 5 <> 0").select("month", "batch", F.lit(1).alias("pos"), F.struct(F.col("idx").cast("int").alias("id"), F.lit("beta/und").alias("category"), F.lit(0.25).alias("confidence"), F.lit("again").alias("reason")).alias("result"))
    return classification.merge_results(rows, first.unionByName(again), fx.VOCABULARY).select("ingest_ord", "category", "confidence", "reason")


add(
    "merge_results",
    merge_results,
    f"""WITH {fx.RECORDS_SQL}, {_BATCHES} SELECT ingest_ord,
        CASE WHEN idx % 5 = 0 THEN '{config.UNRELATED}' WHEN idx % 7 = 1 THEN 'beta-und' WHEN idx % 4 = 0 THEN 'alpha-the' ELSE '{config.UNRELATED}' END AS category,
        CASE WHEN idx % 5 = 0 THEN 0.0::DOUBLE WHEN idx % 7 = 1 THEN 0.25::DOUBLE WHEN idx % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
        CASE WHEN idx % 5 = 0 THEN '{config.MISSING_REASON}' WHEN idx % 7 = 1 THEN 'again' ELSE 'why' END AS reason FROM batched""",
)
add("fallback_rows", lambda s, d: table(s, d, "documents").select("doc_id", classification.fallback(F.col("text")).alias("f")).select("doc_id", "f.category", "f.confidence", "f.reason"), f"SELECT doc_id, '{config.UNRELATED}' AS category, 0.0::DOUBLE AS confidence, 'LLM batch parse failed: ' || substr(text, 1, 120) AS reason FROM documents")


def write_back(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.classified(spark, d)
    results = rows.filter("ingest_ord % 2 = 0").select("ingest_ord", F.lit("beta-und").alias("category"), F.lit(0.75).alias("confidence"), F.lit("told").alias("reason"))
    return classification.write_back(rows, results, "m", "p").select("ingest_ord", "category", F.col("classification_confidence").alias("confidence"), "classifier_model", "classifier_provider")


add(
    "write_back",
    write_back,
    C("""SELECT ingest_ord, CASE WHEN ingest_ord % 2 = 0 THEN 'beta-und' ELSE category END AS category,
        CASE WHEN ingest_ord % 2 = 0 THEN 0.75::DOUBLE WHEN score > 0 THEN least(0.95::DOUBLE, 0.45::DOUBLE + score / 20) ELSE 0.0::DOUBLE END AS confidence,
        CASE WHEN ingest_ord % 2 = 0 THEN 'm' ELSE classifier_model END AS classifier_model, CASE WHEN ingest_ord % 2 = 0 THEN 'p' END AS classifier_provider FROM classified"""),
)


def keyword_model(items: str) -> str:
    """A deterministic stand-in for a model: the first vocabulary path whose last part the title or body holds."""
    out = []
    for item in json.loads(items):
        low = f"{item['title']} {item['body']}".lower()
        hit = next((v for v in fx.VOCABULARY if v.rsplit("/", 1)[1].strip("（）") in low), config.UNRELATED)
        out.append({"id": item["id"], "category": hit, "confidence": 0.5, "reason": "keyword"})
    return json.dumps(out, ensure_ascii=False)


def classify_stub(spark: SparkSession, d: str) -> DataFrame:
    done = classification.classify_records(fx.classified(spark, d), keyword_model, fx.VOCABULARY, "stub", "offline", rec.newest_first(), flush=1 << 30)
    return done.select("ingest_ord", "date", "category", "classification_confidence", "classification_reason", "classifier_model")


add("classify_stub", classify_stub)


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest date's first page, as a search opens."""
    rows = rec.build_records(fx.records(spark, sf_dir))
    latest = search.latest_date(rows).first()["latest"]
    return search.search(rows, search.Query(date_from=latest, date_to=latest)).drop("key_parameters")


add("first_page", lambda s, d: first_page(s, d).select("ingest_ord", "date", "title"), R(f"SELECT ingest_ord, date, title FROM records WHERE date = (SELECT max(date) FROM records) {NEWEST} LIMIT 40"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
