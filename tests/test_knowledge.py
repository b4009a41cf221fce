import random

from signalbase.operators import knowledge


def test_first_records_are_chosen_before_their_parameters_are_laid_out(spark):
    """A task sorts its records, not all their parameters; records without any take no place."""
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), f"2026-01-0{rnd.randrange(1, 4)}", rnd.choice("xyz"), k, [(f"{k}-{p}", "kV") for p in range(rnd.choice((0, 0, 1, 3)))] or rnd.choice(([], None))) for k in range(200)]
    frame = spark.createDataFrame(rows, "category string, date string, title string, ingest_ord long, key_parameters array<struct<value_raw:string,unit:string>>")
    got = knowledge.frontier_values(frame, 12)
    wanted = []
    for c in "ab":
        of = sorted((r for r in rows if r[0] == c), key=lambda r: r[3])
        of = sorted(of, key=lambda r: r[1:3], reverse=True)
        wanted += [(c, k + 1, v) for k, v in enumerate([v for r in of for v, _ in r[4] or []][:12])]
    assert sorted((r["category"], r["rank"], r["value_raw"]) for r in got.collect()) == wanted and len(wanted) == 24
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rfind("Window") > plan.find("Generate") > 0
