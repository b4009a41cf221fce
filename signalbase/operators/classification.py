"""Model classification in batches: what is pending, batches, answers, write-back."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbase import config, schema
from signalbase.functions import classify, text
from signalbase.operators.numbering import numbered
from signalbase.sources.files import exists
from signalbase.sources.shared import shared_dir, staged


def pending(records: DataFrame, model: str, date: str = "", month: str = "", resume: bool = False) -> DataFrame:
    """Records to classify: of a date or month (empty: all), without those that ``model`` has classified if resuming."""
    out = records
    if month:
        out = out.filter(text.month_key(F.col("date")) == month)
    if date:
        out = out.filter(F.col("date") == date)
    if resume:
        out = out.filter(~(F.col("classifier_model").eqNullSafe(model) & (F.coalesce("category", F.lit("")) != config.UNCLASSIFIED)))
    return out


def batches(rows: DataFrame, size: int, order: Sequence[Column]) -> DataFrame:
    """``rows`` with (month, idx, batch): chunks of ``size`` within a month, in order; a batch never crosses months."""
    month = rows.withColumn("month", text.month_key(F.col("date")))
    return numbered(month, ["month"], order).withColumn("batch", F.floor(F.col("idx") / size))


def limit_by_batch(batched: DataFrame, size: int, limit: int) -> DataFrame:
    """Whole batches, newest month first, until the rows they may hold reach the limit (0: all)."""
    if not limit:
        return batched
    most = -(-limit // size)
    numbers = batched.select("month", "batch").distinct()
    # One row for each batch, of which the first few are wanted: a top-k.
    first = numbers.orderBy(F.desc("month"), F.asc("batch")).limit(most)
    return batched.join(first, ["month", "batch"], "left_semi")


def limit_exact(rows: DataFrame, limit: int, order: Sequence[Column]) -> DataFrame:
    """The first ``limit`` rows (0: all)."""
    return rows.orderBy(*order).limit(limit) if limit else rows


def request_items(rows: DataFrame, chars: int = config.REQUEST_CHARS) -> DataFrame:
    """(month, batch, items): each batch as a JSON array of what a model is shown. A batch is of bounded size."""
    item = F.struct(F.col("idx").alias("id"), "title", F.substring("body", 1, chars).alias("body"), "url", F.col("intelligence_type").alias("type"))
    return rows.groupBy("month", "batch").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"))


def merge_results(rows: DataFrame, answers: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(month, batch, idx, category, confidence, reason) for each row from answers (month, batch, pos, result).

    Of answers with one id the last counts; ids that were not asked for are
    ignored; a row without an answer is unrelated.
    """
    keyed = answers.withColumn("idx", F.col("result.id").cast("long"))
    last = keyed.groupBy("month", "batch", "idx").agg(F.max_by("result", "pos").alias("result"))
    joined = rows.drop("category", "confidence", "reason").join(last, ["month", "batch", "idx"], "left")
    missing = F.col("result").isNull()
    good = classify.coerced(F.col("result"), vocabulary)
    none = F.struct(F.lit(config.UNRELATED).alias("category"), F.lit(0.0).alias("confidence"), F.lit(config.MISSING_REASON).alias("reason"))
    return joined.withColumn("_r", F.when(missing, none).otherwise(good)).drop("result").select("*", "_r.*").drop("_r")


def fallback(answer: Column, prefix: str = config.FAILURES["batch"][0], chars: int = config.FAILURES["batch"][1]) -> Column:
    """The result of a row whose batch never came back in form."""
    return F.struct(F.lit(config.UNRELATED).alias("category"), F.lit(0.0).alias("confidence"), F.concat(F.lit(prefix), F.substring(F.coalesce(answer, F.lit("")), 1, chars)).alias("reason"))


def write_back(records: DataFrame, results: DataFrame, model: str, provider: str) -> DataFrame:
    """``records`` with the results (ingest_ord, category, confidence, reason); their parameters are reset."""
    hit = F.col("_r").isNotNull()
    new = results.select("ingest_ord", F.struct("category", "confidence", "reason").alias("_r"))
    none = F.array().cast(schema.RECORD["key_parameters"].dataType)
    put = {
        "category": F.col("_r.category"),
        "classification_confidence": F.col("_r.confidence"),
        "classification_reason": F.col("_r.reason"),
        "classifier_model": F.lit(model),
        "classifier_provider": F.lit(provider),
        "key_parameters": none,
        "cache_hit": F.lit(False),
    }
    joined = records.join(new, "ingest_ord", "left")
    return joined.select(*(F.when(hit, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in records.columns))


def progress(records: DataFrame, model: str, date: str = "") -> DataFrame:
    """(target, classified, pending)."""
    done = F.col("classifier_model").eqNullSafe(model) & (F.coalesce("category", F.lit("")) != config.UNCLASSIFIED)
    return pending(records, model, date).agg(F.count("*").alias("target"), F.count_if(done).alias("classified"), F.count_if(~done).alias("pending"))


Classifier = Callable[[str], str]
#: Bytes of requests that a worker is dealt in a wave, about; more make more waves.
TASK_BYTES = 1 << 27
ANSWERS = "month string, batch bigint, key bigint, answer string"


def parses(answer: str, single: bool = False) -> bool:
    """Whether an answer holds the JSON array that a batch asks for, or the object of a single record."""
    first, last = ("{", "}") if single else ("[", "]")
    inner = answer[answer.find(first) : answer.rfind(last) + 1]
    try:
        return isinstance(json.loads(inner), dict if single else list)
    except ValueError:
        return False


def ask(requests: DataFrame, classifier: Classifier, attempts: int = 3, pause: float = 1.0, workers: int = config.WORKERS, seconds: float | None = None, single: bool = False) -> DataFrame:
    """(month, batch, key, answer): the model's text for each batch (month, batch, items), after up to ``attempts`` tries.

    The model is the one thing that Spark cannot express; ``classifier`` takes a
    batch's JSON and returns text. It is asked again where it fails, takes more
    than ``seconds`` or gives what does not parse; where all tries fail the last
    answer or error stays. Batches are dealt to ``workers`` tasks. A call that is
    given up is not waited for; its thread ends with the call.
    """

    def once(items: str) -> str:
        if seconds is None:
            return classifier(items)
        box = []

        def call() -> None:
            try:
                box.append((True, classifier(items)))
            except Exception as error:
                box.append((False, error))

        thread = threading.Thread(target=call, daemon=True)
        thread.start()
        thread.join(seconds)
        if not box:
            raise TimeoutError(f"no answer after {seconds:g} s")
        good, value = box[0]
        if not good:
            raise value
        return value

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = []
            for items in part["items"]:
                last = ""
                for attempt in range(attempts):
                    try:
                        last = once(items) or ""
                        if parses(last, single):
                            break
                    except Exception as error:  # the model's, whatever it is
                        last = str(error)
                    if attempt + 1 < attempts:
                        time.sleep(pause * (1 + attempt))
                answers.append(last)
            yield part[["month", "batch", "key"]].assign(answer=answers)

    keyed = requests.select("month", "batch", F.xxhash64("items").alias("key"), "items")
    return keyed.repartition(workers).mapInPandas(run, "month string, batch bigint, key bigint, answer string")


def ask_and_keep(requests: DataFrame, classifier: Classifier, folder: str, flush: int = config.FLUSH_BATCHES, **how) -> DataFrame:
    """The answers to all requests, kept below ``folder`` after about every ``flush`` batches, and ``TASK_BYTES`` a worker at most.

    What an earlier run has kept there for the same batch and the same request
    is not asked again, so a run that broke off goes on where it was.
    """
    spark = requests.sparkSession
    requests = todo = staged(requests, "requests")
    if exists(spark, folder):
        kept = spark.read.schema(ANSWERS).parquet(folder)
        same = (kept["month"].eqNullSafe(todo["month"])) & (kept["batch"] == todo["batch"]) & (kept["key"] == F.xxhash64(todo["items"]))
        todo = todo.join(kept, same, "left_anti")
    # What is left to ask is settled once, and a wave reads its own folder only, so work grows with the batches.
    workers = how.get("workers", config.WORKERS)
    n, size = todo.agg(F.count("*"), F.sum(F.octet_length("items"))).first()
    waves = max(1, -(-n // flush), -(-(size or 0) // (workers * TASK_BYTES)))
    path = f"{shared_dir(spark)}/signalbase/waves-{uuid.uuid4().hex}"
    place = F.xxhash64("month", "batch")
    dealt = todo.select("month", "batch", "items").withColumn("wave", F.pmod(place, F.lit(waves)).cast("int"))
    # No task holds a whole wave.
    dealt.repartition(waves * workers, "wave", F.pmod(F.floor(place / waves), F.lit(workers))).write.partitionBy("wave").parquet(path)
    own = spark.read.schema("month string, batch long, items string, wave int").parquet(path)
    for wave in range(waves):
        ask(own.filter(F.col("wave") == wave), classifier, **how).write.mode("append").parquet(folder)
    kept = spark.read.schema(ANSWERS).parquet(folder)
    asked = requests.select("month", "batch", F.xxhash64("items").alias("key"))
    # A wave that was written twice (its folder was kept, its run was not) gives one answer.
    return asked.join(kept.groupBy("month", "batch", "key").agg(F.max("answer").alias("answer")), ["month", "batch", "key"]).drop("key")


def prompts(requests: DataFrame, template: str) -> DataFrame:
    """Requests with each batch's JSON put into a template at ``{items}``; the text around it is the caller's."""
    return requests.withColumn("items", F.replace(F.lit(template), F.lit("{items}"), F.col("items")))


def classify_records(
    records: DataFrame,
    classifier: Classifier,
    vocabulary: Sequence[str],
    model: str,
    provider: str,
    order: Sequence[Column],
    date: str = "",
    month: str = "",
    resume: bool = False,
    batch_size: int = 20,
    limit: int = 0,
    attempts: int = 3,
    pause: float = 1.0,
    template: str = "{items}",
    single: bool = False,
    workers: int = config.WORKERS,
    seconds: float | None = None,
    answers_folder: str | None = None,
    flush: int = config.FLUSH_BATCHES,
) -> DataFrame:
    """``records`` after a run of the model over what is pending.

    With ``single`` each record is asked for alone and answered by one JSON
    object; else a batch is answered by an array. A limit then counts records.
    ``workers`` tasks ask side by side; a call may take ``seconds`` (by default
    as long as that kind of run allows). Answers are kept in ``answers_folder``
    after every ``flush`` batches, and a run that is started again with the
    same folder asks only for the rest.
    """
    form = "single" if single else "date" if date else "batch"
    rows = pending(records, model, date, month, resume)
    if single:
        batch_size, rows = 1, limit_exact(rows, limit, order)
    rows = limit_by_batch(batches(rows, batch_size, order), batch_size, 0 if single else limit)
    asked = rows.select("month", "batch", "idx", "ingest_ord")
    requests = prompts(request_items(rows, config.SINGLE_REQUEST_CHARS if single else config.REQUEST_CHARS), template)
    folder = answers_folder or f"{shared_dir(records.sparkSession)}/signalbase/answers-{uuid.uuid4().hex}"
    how = {"attempts": attempts, "pause": pause, "workers": workers, "seconds": config.SECONDS[form] if seconds is None else seconds, "single": single}
    answers = ask_and_keep(requests, classifier, folder, flush, **how)
    if single:
        one = classify.parse_model_object(F.col("answer"))
        results = F.when(one.isNotNull(), F.array(F.struct(F.col("batch").alias("id"), one["category"].alias("category"), one["confidence"].alias("confidence"), one["reason"].alias("reason"))))
    else:
        results = classify.parse_model_array(F.col("answer"))
    failure = fallback(F.col("answer"), *config.FAILURES[form])
    # The model is asked once: its answers are kept before they are read twice.
    answers = staged(answers.withColumn("results", results).withColumn("_f", failure), "answers")
    parsed = answers.filter(F.col("results").isNotNull()).select("month", "batch", F.posexplode("results").alias("pos", "result"))
    merged = merge_results(asked, parsed, vocabulary)
    failed = answers.filter(F.col("results").isNull()).select("month", "batch", "_f")
    both = merged.join(failed, ["month", "batch"], "left")
    done = both.select("ingest_ord", *(F.when(F.col("_f").isNotNull(), F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c) for c in ("category", "confidence", "reason")))
    return write_back(records, done, model, provider)
