import random

from pyspark.sql import functions as F

from winnowry import fixed_values as fv
from winnowry.functions.annotations import annotation
from winnowry.operators import review as rv

LOG = "reviewer string, session string, seq bigint, choice string"


def stack(events):
    standing = []
    for seq, choice in events:
        if choice == "undo":
            standing and standing.pop()
        else:
            standing.append(seq)
    return standing


def test_undo_on_empty(spark):
    word = "uddudduud"
    log = spark.createDataFrame([("r", "s", i, "undo" if c == "u" else "y") for i, c in enumerate(word)], LOG)
    assert sorted(r["seq"] for r in rv.undo_last(log).collect()) == [1, 8]


def test_undo_matches_a_stack(spark):
    rng = random.Random(3)
    rows, wanted = [], []
    for s in range(6):
        events = [(i, "undo" if rng.random() < (0.3, 0.5, 0.7)[s % 3] else "y") for i in range(200)]
        rows += [("r" if s else None, str(s), seq, c) for seq, c in events]
        wanted += [(str(s), seq) for seq in stack(events)]
    log = spark.createDataFrame(rows, LOG)
    for chunk in (7, 50, 1000):
        assert sorted((r["session"], r["seq"]) for r in rv.undo_last(log, chunk).collect()) == sorted(wanted)


def test_decisions(spark):
    low = fv.LOW_QUALITY
    entry = lambda label: F.create_map(F.lit(low), annotation(label, F.lit("why"), confidence=F.lit(0.5)))
    predictions = spark.createDataFrame([("a", True), ("b", None)], "sample_id string, l boolean").select(
        "sample_id", F.lit(1).alias("n"), entry(F.col("l")).alias("predicted_task_annotations")
    )
    rows = [
        ("a", "a", 0), ("b", "a", 0), ("a", "y", 1), ("a", "y", 0), ("a", "y", 99), ("a", "n", 1), ("a", "s", 1), ("c", "a", 0),
    ]
    decisions = spark.createDataFrame(
        [("r", "s", i, s, low, c, n) for i, (s, c, n) in enumerate(rows)],
        "reviewer string, session string, seq bigint, sample_id string, task_id string, choice string, reason_no int",
    )
    got = [
        (r["valid"], r["annotation"]["label"], r["annotation"]["reason"], r["annotation"]["source"], r["annotation"]["confidence"])
        for r in rv.decide_annotations(decisions, predictions, "n").orderBy("seq").collect()
    ]
    assert got[0] == (True, True, "why", "human_reviewed_auto", 1.0)
    assert got[1][0] is False and got[7][0] is False
    assert got[2] == (True, True, fv.TASKS[0]["reason_options"][0], "human", 1.0)
    assert got[3][2] == "" and got[4][2] == ""
    assert got[5] == (True, False, "", "human", 1.0)
    assert got[6] == (True, None, "", "human", None)


def test_progress_of_nothing(spark):
    none = spark.createDataFrame([], "sample_id string")
    row = rv.review_progress(none, none).first()
    assert (row["total"], row["percent"]) == (0, 100.0)


def test_repeated_log_rows_and_sample_ids(spark):
    low, ai = fv.TASK_IDS
    predictions = spark.createDataFrame([], "sample_id string, n int, predicted_task_annotations map<string,struct<label:boolean,status:string,reason:string,annotator:string,source:string,confidence:double>>")
    log = [("r", "s", 1, "a", t, "y", 1) for t in (low, ai, low)]
    decisions = spark.createDataFrame(
        log, "reviewer string, session string, seq bigint, sample_id string, task_id string, choice string, reason_no int"
    )
    samples = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "sample_id string, n int, content string")
    rows = rv.apply_review_decisions(samples, predictions, decisions, "n", "n").collect()
    assert len(rows) == 1 and rows[0]["text"] == "new" and set(rows[0]["task_annotations"]) == {low, ai}
