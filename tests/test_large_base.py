"""Search by lists and codes, the task table, and data sets that are checked while they are written."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnowry import fixed_values as fv, schemas
from winnowry.functions import annotations as an
from winnowry.operators import ann, knn, tasks as ts
from winnowry.operators.scoring import classify
from winnowry.sources import checked

BASE = "id string, embedding array<float>"


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(30, 32))
    rows = [(f"b{i}", [float(v) for v in centers[i % 30] + 0.3 * rng.normal(size=32)]) for i in range(3000)]
    # A third of the rows are one vector, a few have none.
    rows = rows[:2000] + [(f"b{i}", rows[0][1]) for i in range(2000, 3000)] + [("none", None)]
    asked = [(i, [float(v) for v in centers[i % 30] + 0.3 * rng.normal(size=32)]) for i in range(120)] + [(999, None)]
    return spark.createDataFrame(asked, "query_id bigint, embedding array<float>"), spark.createDataFrame(rows, BASE)


def test_lists_meet_the_exact_neighbors(crowd):
    asked, base = crowd
    exact = knn.knn_join_cells(asked, base, 5)
    found = ann.knn_join_lists(asked, base, 5, block=256)
    recall = ann.recall_of(found, exact).first()
    assert recall["queries"] == 120 and recall["pairs"] == 600 and recall["recall"] >= 0.9
    rows = {(r["query_id"], r["id"]): (r["neighbor_rank"], r["distance"]) for r in exact.collect()}
    both = [(r, rows[r["query_id"], r["id"]]) for r in found.collect() if (r["query_id"], r["id"]) in rows]
    assert all(r["distance"] == want[1] and r["neighbor_rank"] <= want[0] for r, want in both)
    # Visiting every list and re-ranking everything is the exact search.
    books = ann.fit(base)
    whole = ann.search(asked, ann.build_index(base, books), books, 5, probes=10**6, rerank=10**6)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.select(whole.columns).collect()))


def test_empty_and_tiny_bases(spark, crowd):
    asked, base = crowd
    assert ann.knn_join_lists(asked, base.limit(0)).count() == 0
    assert ann.knn_join_lists(asked, base.filter("id = 'b1'")).count() == 120
    assert ann.knn_join_lists(asked.limit(0), base).count() == 0


def test_cascade_over_a_large_base(spark):
    """The same answers by the travelling base and by cells; nearly all by lists."""
    rows = [(f"text number {i} about {'spam spam' if i % 3 else 'weather'} {i % 17}", None, "low_quality" if i % 3 else "genuine", None, i) for i in range(1300)]
    examples = spark.createDataFrame(rows, schemas.EXAMPLES + ", ordinal bigint")
    posts = spark.createDataFrame([(i, f"post {i} spam about weather {i % 5}", None, None) for i in range(60)], "n int, " + schemas.SCORE_REQUESTS)
    shown = lambda df: {r["n"]: (r["label"], r["confidence"]) for r in df.collect()}
    by_cells = shown(classify(posts, examples, id_col="n"))
    assert by_cells == shown(classify(posts, examples, small=2000))
    by_lists = shown(classify(posts, examples, id_col="n", search=ann.knn_join_lists))
    assert set(by_lists) == set(by_cells) and sum(by_lists[n] == by_cells[n] for n in by_cells) >= 54


def test_task_table_rules(spark):
    tasks = spark.createDataFrame([("t1", 2, "", "d", "y", "n", ["r"]), ("t0", 1, "", "d", "y", "n", None)], schemas.TASKS)
    entry = lambda label, reason: an.annotation(F.lit(label).cast("boolean"), F.lit(reason), F.lit("m"), F.lit("auto"), F.lit(0.5))
    df = spark.range(1).select(F.lit("s").alias("sample_id"), F.create_map(
        F.lit("t1"), entry(True, "r"), F.lit("t0"), entry(True, "r"), F.lit("t2"), entry(False, ""),
    ).alias("task_annotations"))
    got = {r["task_id"]: r["violations"] for r in ts.validate(df, tasks).collect()}
    assert got == {"t0": ["unknown_reason"], "t2": ["unknown_task"]}
    assert list(ts.with_empty_annotations(spark.range(1), tasks).first()["task_annotations"]) == ["t0", "t1"]
    assert ts.missing_tasks(ts.with_empty_annotations(spark.range(1).withColumn("sample_id", F.lit("x")), tasks), tasks).count() == 0
    heads = ts.prompt_heads(ts.default_tasks(spark)).first()["head"]
    from winnowry.functions.prompts import label_prompt_head

    assert heads == label_prompt_head() and fv.TASK_IDS[0] in heads
    assert ts.with_label_prompt(spark.range(1).withColumn("text", F.lit(None).cast("string")), tasks, "text").count() == 1


def test_a_failed_check_leaves_the_old_data(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = lambda labels: spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "n int, task_label boolean")
    assert checked.write_task_dataset(rows([True, False, None]), path) == {"rows": 3, "positive": 1, "negative": 1}
    with pytest.raises(ValueError):
        checked.write_task_dataset(rows([True, True]), path)
    assert spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["set"]
    with pytest.raises(Exception, match="broken"):
        checked.write_task_dataset(rows([True, False]).withColumn("x", F.raise_error(F.lit("broken"))), path)
    assert spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["set"]


def test_split_files(spark, tmp_path):
    path = str(tmp_path / "splits")
    rows = [(i, "t a/b" if i % 2 else "u", ["train", "val"][i % 3 == 0], None) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, task_id string, split string, note string")
    names = checked.write_split_files(df, path)
    assert names == ["t-a-b_train.jsonl", "t-a-b_val.jsonl", "u_train.jsonl", "u_val.jsonl"]
    lines = [json.loads(x) for x in open(f"{path}/u_val.jsonl")]
    assert sorted(x["n"] for x in lines) == [r[0] for r in rows if r[1] == "u" and r[2] == "val"] and "note" in lines[0]
    assert checked.write_split_files(df.filter("task_id = 'u'").limit(0), path) == [] and sorted(os.listdir(path))[-4:] == names
    many = checked.write_split_files(df, str(tmp_path / "many"), files=3)
    assert len(many) > 4 and sum(len(open(f"{tmp_path}/many/{n}").readlines()) for n in many) == 40
    with pytest.raises(Exception, match="broken"):
        checked.write_split_files(df.withColumn("x", F.when(F.col("n") == 39, F.raise_error(F.lit("broken")))), str(tmp_path / "failed"))
    assert not [n for n in os.listdir(tmp_path / "failed") if not n.startswith(".")] if (tmp_path / "failed").exists() else True


def test_list_search_does_not_copy_queries_for_every_list(crowd):
    """Chunks of queries and blocks of codes are moved, and no vector is joined back to a pair."""
    asked, base = crowd
    books = ann.fit(base)
    found = ann.search(asked, ann.build_index(base, books), books, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join Inner" not in plan and "Join Cross" in plan
