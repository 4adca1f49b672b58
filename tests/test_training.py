import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from winnowry import fixed_values as fv
from winnowry.functions.annotations import annotation
from winnowry.operators import evaluation as ev, ordering as od, training as tr

ROWS = "id string, task_label boolean, text string"


def rows(spark, positive, negative, same=0):
    data = [(f"p{i}", True, "t") for i in range(positive)] + [(f"n{i}", False, "t") for i in range(negative)]
    # Copies of one row, more than any split holds.
    data += [("same", False, "t")] * same
    return spark.createDataFrame(data, ROWS).repartition(5)


def sizes(df):
    return Counter((r["task_label"], r["split"]) for r in df.collect())


@pytest.mark.parametrize("positive, negative, same", [(50, 150, 0), (33, 71, 0), (20, 40, 60), (7, 0, 200)])
def test_split_is_exact(spark, positive, negative, same):
    df = rows(spark, positive, negative, same)
    split = tr.stratified_split(df, "id")
    assert split.drop("split").exceptAll(df).count() == 0 and df.exceptAll(split.drop("split")).count() == 0
    got, total = sizes(split), positive + negative + same
    by_split = {s: got[True, s] + got[False, s] for s in ("train", "val", "test")}
    assert by_split["test"] == math.ceil(total * 0.1)
    assert by_split["val"] == math.ceil((total - by_split["test"]) * (0.1 / 0.9))
    for label, n in ((True, positive), (False, negative + same)):
        assert abs(got[label, "test"] - n * by_split["test"] / total) <= 1


def test_split_with_one_id_and_different_rows(spark):
    df = spark.createDataFrame([("x", i % 2 == 0, str(i)) for i in range(100)], ROWS)
    split = tr.stratified_split(df, "id")
    assert split.count() == 100 and sizes(split)[True, "test"] == 5
    again = tr.stratified_split(df.repartition(7), "id")
    assert split.exceptAll(again).count() == 0


def test_cuts_narrow_large_classes(spark, monkeypatch):
    monkeypatch.setattr(od, "COLLECT_ROWS", 4)
    df = rows(spark, 300, 900)
    split = tr.train_test_split(df, "id", 0.25)
    assert sizes(split) == {(True, "test"): 75, (False, "test"): 225, (True, "train"): 225, (False, "train"): 675}
    ordered = df.filter("task_label").withColumn("h", od.hash_key(42, F.col("id"))).orderBy("h").limit(75)
    tested = split.filter("task_label and split = 'test'").select("id")
    assert ordered.select("id").exceptAll(tested).count() == 0


def test_ratio_checks():
    for val, test, train in ((0.5, 0.5, None), (0, 0.1, None), (0.1, 0.1, 0.7)):
        with pytest.raises(ValueError):
            tr.split_ratio_check(val, test, train)
    tr.split_ratio_check(0.1, 0.1, 0.8)


def test_rebalance(spark):
    out, b = tr.rebalance(rows(spark, 10, 100), "id", 3.0)
    counts = Counter(r["task_label"] for r in out.collect())
    assert (counts[True], counts[False], b.added_positive, b.strategy) == (34, 100, 24, "oversample_positive")
    assert out.filter("copy_no > 0").select("copy_no").distinct().count() == 24
    again, _ = tr.rebalance(rows(spark, 10, 100).repartition(3), "id", 3.0)
    assert out.exceptAll(again).count() == 0
    same, b = tr.rebalance(rows(spark, 40, 100), "id", 3.0)
    assert same.count() == 140 and b.strategy == "unchanged"
    none, b = tr.rebalance(rows(spark, 0, 5), "id", 3.0)
    assert none.count() == 5 and b.added_positive == 0


def test_row_index_is_dense(spark):
    df = rows(spark, 30, 30, 40)
    got = sorted(r["row_index"] for r in od.with_row_index(df, [F.col("id")]).collect())
    assert got == list(range(100))


def annotated(spark, labels):
    df = spark.createDataFrame(labels, "id int, a boolean, b boolean")
    one = lambda c: F.create_map(F.lit(fv.LOW_QUALITY), annotation(F.col(c)))
    return df.select("id", F.lit("m").alias("model_input"), one("a").alias("task_annotations"), one("b").alias("predicted_task_annotations"))


def test_annotation_field(spark):
    low = fv.LOW_QUALITY
    tie = annotated(spark, [(1, True, None), (2, None, False)])
    assert tr.resolve_annotation_field(tie, low) == "task_annotations"
    more = annotated(spark, [(1, None, True), (2, None, False)])
    assert tr.resolve_annotation_field(more, low) == "predicted_task_annotations"
    with pytest.raises(ValueError):
        tr.resolve_annotation_field(annotated(spark, [(1, None, None)]), low)
    data = tr.task_dataset(more, low)
    assert data.count() == 2 and {"text", "task_label", "task_reason"} <= set(data.columns)
    with pytest.raises(ValueError):
        tr.task_dataset(tie, low)
    with pytest.raises(ValueError):
        tr.load_presplit(tie, None, low, "id")


def test_pack_tokens(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [7, 8, 9]), ([1], [2])], "p array<int>, a array<int>")
    got = [r["t"] for r in df.select(tr.pack_tokens(F.col("p"), F.col("a"), 8, 0).alias("t")).collect()]
    assert got[0]["input_ids"] == [1, 2, 3, 4, 5, 7, 8, 9]
    assert got[0]["labels"] == [-100] * 5 + [7, 8, 9] and got[0]["attention_mask"] == [1] * 8
    assert got[1]["input_ids"] == [1, 2] + [0] * 6 and got[1]["labels"] == [-100, 2] + [-100] * 6
    with pytest.raises(Exception, match="does not fit"):
        df.select(tr.pack_tokens(F.col("p"), F.col("a"), 3, 0)).collect()


def test_metrics_of_undecided(spark):
    df = spark.createDataFrame([(True, None), (False, None)], "gold boolean, pred boolean")
    row = ev.eval_metrics(ev.confusion(df)).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"], row["coverage"], row["unknown"]) == (0, 0, 0, 0, 0, 2)
