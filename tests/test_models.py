import pytest
from pyspark.sql import functions as F

from winnowry import fixed_values as fv
from winnowry.functions import annotations as an, detectors as dt, replies as rp
from winnowry.operators import actions as ac, labeling as lb, scoring as sc

LOW, AI = fv.LOW_QUALITY, fv.AI_GENERATED


def reply(**low):
    import json

    return json.dumps({"task_results": {LOW: low}})


@pytest.mark.parametrize(
    "text, label, confidence, error",
    [
        ('{"task_results":{}}', None, 0.0, None),
        (reply(label="true"), None, 0.0, None),
        (reply(label=True, confidence="0.9"), True, 0.9, None),
        (reply(label=False, confidence=None), False, 0.0, None),
        (reply(label=True, confidence=0.285), True, 0.28, None),
        (reply(label=1), None, 0.0, None),
        ("say " + reply(label=True) + " bye", True, 0.0, None),
        (reply(label=True) + " }", None, None, fv.NO_JSON_REASON),
        (reply(label=True) + ", " + reply(label=True), None, None, fv.NO_JSON_REASON),
        ("nothing", None, None, fv.NO_JSON_REASON),
        ('{"task_results": []}', None, None, fv.NO_JSON_REASON),
        ('{"task_results": {"is_low_quality": 3}}', None, None, fv.NO_JSON_REASON),
    ],
)
def test_parse_task_results(one, text, label, confidence, error):
    got = one(lambda c: rp.parse_task_results(c, F.lit("m")), text)
    assert got["error"] == error
    if error is None:
        entry = got["annotations"][LOW]
        assert (entry["label"], entry["confidence"], entry["annotator"], entry["source"]) == (label, confidence, "m", "auto")
        assert set(got["annotations"]) == {LOW, AI}


@pytest.mark.parametrize(
    "text, usable, label",
    [
        (reply(label=True, confidence=0.9), True, True),
        (reply(label=True, confidence="high"), False, None),
        (reply(label=True, confidence=None), False, None),
        (reply(label=True, reason=5), False, None),
        (reply(label=1), True, True),
        (reply(label="x"), True, None),
    ],
)
def test_parse_service_results(one, text, usable, label):
    got = one(rp.parse_service_results, text)
    assert (got is not None) is usable
    if usable:
        assert got[LOW]["label"] is label


def test_parse_single_label(one):
    make = lambda c: rp.parse_single_label(c, AI)
    assert one(make, "?").asDict() == {
        "task_id": AI, "label": None, "reason": "解析失败", "evidence": "", "confidence": 0.0
    }
    assert one(make, '{"label": false, "evidence": "e"}')["label"] is False


def test_primary_fields(spark):
    low = lambda label, conf, reason="": an.result(F.lit(label), F.lit(conf), F.lit(reason))
    both = F.create_map(F.lit(LOW), low(True, 0.4, "a"), F.lit(AI), low(True, 0.6, "b"))
    row = spark.range(1).select(
        an.primary_label(both).alias("l"), an.primary_reason(both).alias("r"), an.primary_confidence(both).alias("c"),
        an.primary_label(an.empty_results()).alias("l0"), an.primary_reason(an.empty_results()).alias("r0"),
    ).first()
    assert row["l"] == "ai_generated" and row["r"] == f"{LOW}: a | {AI}: b" and row["c"] == 0.6
    assert row["l0"] == "genuine" and row["r0"] == "Content appears normal"


def test_review_threshold(spark):
    make = lambda a, b: F.create_map(
        F.lit("x"), an.annotation(F.lit(True), confidence=F.lit(a)), F.lit("y"), an.annotation(F.lit(False), confidence=F.lit(b))
    )
    row = spark.range(1).select(
        an.should_review(make(0.8, 0.79)).alias("a"), an.should_review(make(0.8, 0.8)).alias("b"),
        an.should_review(an.empty_annotations()).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (True, False, True)


def test_hybrid_score(spark):
    votes, hits = F.lit(2.0) / F.lit(3.0), F.array(F.lit("家人们"))
    got = spark.range(1).select(dt.hybrid_result(LOW, votes, hits).alias("r")).first()["r"]
    assert got.asDict() == {"label": True, "confidence": 0.55, "reason": "命中低质量模式: 家人们"}


@pytest.mark.parametrize(
    "text, score, flagged",
    [
        ("", 0.3, False),
        ("家人们谁懂啊！！家人们", 0.3 + 0.4 + 0.05 + 0.2, True),
        ("YYDS yyds " + "好" * 30, 0.2, False),
        ("1. 好\n2、坏\n" + "文" * 40 + "。", 0.1, False),
        ("$" * 40, 0.2, False),
    ],
)
def test_rule_score(spark, text, score, flagged):
    df = dt.with_low_quality_score(spark.createDataFrame([(text,)], "t string"), "t", "s")
    s = df.first()["s"]
    assert s["confidence"] == pytest.approx(score) and s["should_filter"] is flagged


def test_rule_without_service(one):
    assert one(lambda c: dt.fallback_rule_score(c, AI), "随着经济的发展")["should_filter"] is False
    got = one(lambda c: dt.fallback_rule_score(c, LOW), "家人们，谁懂啊，绝绝子，yyds")
    assert got["confidence"] == 0.9 and got["should_filter"]


def test_platform_dictionary_replaces(spark):
    df = spark.createDataFrame([("家人们谢邀", "zhihu"), ("家人们谢邀", None)], "t string, p string")
    hits = df.select(dt.keyword_hits_by_platform(F.col("t"), F.col("p")).alias("h")).collect()
    assert [r["h"] for r in hits] == [["谢邀"], ["家人们"]]


REQUESTS = "id int, text string, platform string, task_ids array<string>"


def test_cascade_edge_and_skip(spark):
    df = spark.createDataFrame([(1, "x" * 10, None, None), (2, "y" * 11, None, [AI]), (3, "家人们谁懂啊绝绝子", None, [])], REQUESTS)

    def model(prompts):
        return [
            '{"task_results": {"%s": {"label": null, "confidence": %s}}}' % (LOW, "0.90" if "xxx" in p else "0.89")
            for p in prompts
        ]

    rows = {r["id"]: r for r in sc.classify(df, predict_fn=model).collect()}
    assert rows[1]["detect_method"] == "local_model" and rows[1]["rag_example"] is None
    assert rows[1]["task_results"][LOW]["label"] is None
    assert rows[2]["detect_method"] == rows[3]["detect_method"] == "rag"
    assert rows[3]["is_low_quality"] and rows[3]["label"] == "low_quality" and rows[3]["rag_example"].endswith("...")


def test_cascade_without_examples(spark):
    df = spark.createDataFrame([(1, "text", None, None)], REQUESTS)
    empty = spark.createDataFrame([], "text string, category string, label string, task_annotations map<string,struct<label:boolean,reason:string>>, ordinal int")
    row = sc.classify(df, empty).first()
    assert row["rag_example"] is None and row["task_results"][LOW]["confidence"] == 1.0


def test_cascade_with_a_large_base(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"家人们 text {i}", None, None) for i in range(5)], REQUESTS)
    small = {r["id"]: r.asDict() for r in sc.classify(df).collect()}
    monkeypatch.setattr(sc, "collect_base", lambda *a: None)
    large = {r["id"]: r.asDict() for r in sc.classify(df, id_col="id").collect()}
    assert small == large


def test_a_bad_row_fails_alone(spark):
    good = reply(label=True, confidence=0.9)

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("e" * 50)
        return [good] * len(prompts)

    df = spark.createDataFrame([("good",), ("bad",), ("fine",)], "t string").coalesce(1)
    rows = {r["t"]: r for r in lb.label_with_model(df, F.col("t"), model, "m").collect()}
    assert rows["good"]["predicted"][LOW]["label"] is True and not rows["fine"]["failed"]
    failed = rows["bad"]["predicted"][LOW]
    assert failed["annotator"] == "system" and failed["reason"] == "预标失败: " + "e" * 30
    assert rows["bad"]["prompt_tokens"] == 0


def test_output_formats(spark):
    df = spark.range(1).select(an.empty_annotations().alias("p"))
    columns = lambda f: set(lb.attach_auto_labels(df, "p", f, "local", "m", "now").columns) & {
        "task_annotations", "predicted_task_annotations"
    }
    assert columns("review") == {"predicted_task_annotations"}
    assert columns("train") == {"task_annotations"}
    assert len(columns("hybrid")) == 2
    with pytest.raises(ValueError):
        columns("other")


def test_actions(spark):
    posts = spark.createDataFrame([(1, "zhihu"), (2, "xiaohongshu"), (3, "none")], "post_id int, platform string")
    found = spark.createDataFrame(
        [(1, "low-quality", True, 0.6), (1, "ai-content", True, 0.9), (2, "ai-content", True, 0.69), (3, "low-quality", True, 1.0)],
        "post_id int, detector_id string, should_filter boolean, confidence double",
    )
    rows = ac.decide_actions(posts, found, ac.default_settings(spark)).collect()
    assert sorted((r["post_id"], r["effect_id"]) for r in rows) == [(1, "blur"), (1, "label")]
    blur = next(r for r in rows if r["effect_id"] == "blur")
    assert blur["strength"] == 8.0


def test_token_counts(one):
    assert one(rp.estimate_tokens, "你好 two words") == 4
    assert one(rp.token_counter(lambda t: t.split()), "a b c") == 3
