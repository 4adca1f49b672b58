"""Cases the earlier tests missed."""

import pandas as pd
from pyspark.sql import functions as F

from winnowry.operators import actions, labeling, ordering, pages as pg
from winnowry.sources import jsonl


def test_rows_without_an_order_are_kept(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", None, "y"), ("b", 2, "z"), ("c", 1, "p"), ("c", 1, "q")], "k string, n int, v string")
    first = {r["k"]: r["v"] for r in ordering.first_per_key(df, ["k"], "n").collect()}
    again = {r["k"]: r["v"] for r in ordering.first_per_key(df.repartition(5), ["k"], "n").collect()}
    assert first == again and first["a"] == "x" and first["b"] == "z"
    assert {r["k"]: r["v"] for r in ordering.last_per_key(df, ["k"], "n").collect()}["b"] == "z"


def test_bad_pages_do_not_end_the_job(spark):
    rows = [(1, "u", None), (2, "u", "<![foo[ x"), (3, "u", "<p>plain text without a body</p>")]
    found = pg.extract_detail_text(spark.createDataFrame(rows, "page_id int, url string, html string"), False)
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert texts[1] is None and "plain text" in texts[3] and len(texts) == 3


def test_a_bad_prompt_costs_few_calls(spark):
    calls = []

    def model(prompts: pd.Series):
        calls.append(len(prompts))
        if (prompts == "bad").any():
            raise ValueError("no")
        return ["ok"] * len(prompts)

    call = labeling.model_replies(F.col("p"), model)
    df = spark.createDataFrame([("bad" if i == 700 else f"p{i}",) for i in range(1000)], "p string").coalesce(1)
    rows = df.select("p", call.alias("r")).collect()
    assert [r["p"] for r in rows if r["r"]["error"]] == ["bad"] and sum(r["r"]["reply"] == "ok" for r in rows) == 999


def test_broken_example_file(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text('[{"text": "a", "category": ')
    assert jsonl.read_examples(spark, str(path)).count() == 0


def test_settings_do_not_shuffle_the_data(spark):
    found = spark.range(1000).select(
        F.col("id").cast("string").alias("post_id"), F.lit("is_low_quality").alias("detector_id"),
        F.lit(True).alias("should_filter"), F.lit(0.9).alias("confidence"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = actions.over_threshold(found, actions.default_settings(spark)["detectors"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(detector_id" not in plan
