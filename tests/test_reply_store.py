"""A model is asked once for each distinct prompt, and the input of a split is made once."""

from pyspark.sql import functions as F

from winnowry.operators import labeling as lb, reply_store as rs, training as tr


def noting(path, failing=()):
    """A model that notes every prompt it gets in a file, and fails on some. Nested, so that it travels to the workers."""
    path = str(path)

    def predict(prompts):
        for p in prompts:
            if p in failing:
                raise ValueError("no")
        with open(path, "a") as f:
            f.write("".join(f"{p}\n" for p in prompts))
        return [f"reply to {p}" for p in prompts]

    return predict


def asked(path):
    return sorted(x.strip() for x in open(path)) if path.exists() else []


def test_each_prompt_is_asked_once(spark, tmp_path):
    notes, store = tmp_path / "asked", str(tmp_path / "store")
    model = noting(notes)
    df = spark.createDataFrame([(i, f"p{i % 5}" if i % 7 else None, "r") for i in range(60)], "n int, text string, reply string")
    got = rs.with_stored_replies(df, F.col("text"), model, "m:1/x", store, "r")
    for _ in range(2):
        assert all((r["r"].reply if r["r"] else None) == (f"reply to {r['text']}" if r["text"] else None) for r in got.collect())
    assert got.columns == ["n", "text", "reply", "r"] and got.count() == 60
    rs.with_stored_replies(df, F.col("text"), model, "m:1/x", store, "r").count()
    assert asked(notes) == [f"p{i}" for i in range(5)]
    # More prompts: only the new ones. Another model: all.
    more = df.union(spark.createDataFrame([(100, "p9", "r")], df.schema))
    rs.with_stored_replies(more, F.col("text"), model, "m:1/x", store, "r").count()
    assert asked(notes) == [*(f"p{i}" for i in range(5)), "p9"]
    rs.with_stored_replies(df.filter("text = 'p1'"), F.col("text"), model, "m-1-x", store, "r").count()
    assert asked(notes).count("p1") == 2
    assert rs.with_stored_replies(df.limit(0), F.col("text"), model, "none", store, "r").count() == 0


def test_failed_prompts(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}",) for i in range(4)], "text string")
    store, bad, good = str(tmp_path / "store"), noting(tmp_path / "a", ("p2",)), noting(tmp_path / "b")
    errors = lambda **kw: {r["text"]: r["r"].error for r in rs.with_stored_replies(df, F.col("text"), kw.pop("model"), "m", store, "r", **kw).collect()}
    assert errors(model=bad) == {"p0": None, "p1": None, "p2": "no", "p3": None}
    assert errors(model=good)["p2"] == "no" and asked(tmp_path / "b") == []
    assert errors(model=good, retry_failed=True)["p2"] is None and asked(tmp_path / "b") == ["p2"]


def test_labels_from_a_store_equal_those_without(spark, tmp_path):
    reply = lambda prompts: ['{"task_results": {"is_low_quality": {"label": %s, "confidence": 0.5, "reason": "r"}}}' % ("true" if len(p) % 2 else "false") for p in prompts]
    df = spark.createDataFrame([(i, "x" * (i % 9)) for i in range(40)], "n int, text string")
    plain = lb.label_with_model(df, F.col("text"), reply, "m")
    stored = lb.label_with_model(df, F.col("text"), reply, "m", store=str(tmp_path / "s"))
    shown = lambda d: sorted(str(r) for r in d.select(*plain.columns).collect())
    assert shown(plain) == shown(stored)


def test_the_input_of_a_split_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def label(n):
        made.add(1)
        return n % 3 == 0

    rows = spark.range(300).withColumn("task_label", label.asNondeterministic()("id"))
    split = tr.stratified_split(rows, "id", 0.1, 0.2)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert made.value == 300 and counts["test"] == 60 and sum(counts.values()) == 300
