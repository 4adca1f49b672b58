import html

import pytest
from pyspark.sql import functions as F

from winnowry.functions import numeric, text as tx
from winnowry.operators import cleaning as cl, dedup as dd


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("&lt;b&gt;好&lt;/b&gt;", "好"),
        ("&amp;lt;", "&lt;"),
        ("a​b", "ab"),
        ("a　 b", "a b"),
        ("a\x1c\x85b ", "a b"),
        ("  x \n\n y\t", "x y"),
        ("a<br\n/>b", "a b"),
        ("&eacute;&#x4f60;&copy &nosuch;", html.unescape("&eacute;&#x4f60;&copy &nosuch;")),
        (None, ""),
    ],
)
def test_normalize(one, spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(tx.normalize_text(F.col("t")).alias("v")).first()["v"] == clean


def test_preview_edges(one):
    assert one(tx.build_preview, "x" * 200) == "x" * 200
    assert one(tx.build_preview, "x" * 201) == "x" * 200 + "..."
    cut = "x" * 199 + " y"
    assert one(tx.build_preview, cut) == "x" * 199 + "..."
    assert one(tx.truncate_legacy, cut) == "x" * 199 + " ..."
    assert one(tx.is_cut, "x" * 200) is False


def test_model_input(one):
    assert one(tx.build_model_input, "q", "") == "问题：q"
    assert one(tx.build_model_input, "", "p") == "p"
    assert one(tx.build_model_input, "q", "p") == "问题：q\n回答预览：p"


def test_sample_id_collides_by_design(spark):
    rows = [("zhihu", "u", "a", "q", "one"), ("zhihu", "u", "a", "q", "two"), ("zhihu", "", "", "", "one"), ("zhihu", "", "", "", "two")]
    df = spark.createDataFrame(rows, "p string, u string, a string, q string, t string")
    ids = [r["v"] for r in df.select(tx.build_sample_id(*[F.col(c) for c in "puaqt"]).alias("v")).collect()]
    assert ids[0] == ids[1] and ids[2] != ids[3] and len(ids[0]) == 16


@pytest.mark.parametrize(
    "text, hit", [("加我VX聊", True), ("关注我吧", True), ("nothing", False), ("更多干货在此", True)]
)
def test_contact(one, text, hit):
    assert one(tx.has_contact_hint, text) is hit


def test_counts(one):
    assert one(tx.parse_count, "赞同 1,234") == 1234
    assert one(tx.parse_count, "赞同") == 0
    assert one(tx.parse_comment_count, "56 条评论") == 56
    assert one(tx.parse_comment_count, "添加评论") == 0
    assert one(tx.platform_of, "https://www.zhihu.com/x") == "zhihu"
    assert one(tx.platform_of, "https://a.b") is None


def test_html_to_text(one):
    page = '<style>a{}</style><p>a<b>b</b></p><!-- c --><script>"</p>"</script>&lt;i&gt; <svg><text>z</text></svg>d'
    assert one(tx.html_to_text, page) == "a b <i> d"


def test_round2_is_exact(spark):
    values = [i / 1000 for i in range(0, 2000)] + [0.285, 2.675, 1.005, 1e-9, 0.125, 0.375]
    df = spark.createDataFrame([(v, round(v, 2)) for v in values], "x double, y double")
    assert df.filter(numeric.round2(F.col("x")) != F.col("y")).count() == 0


RAW = "question string, question_detail string, answer_full string, answer_truncated string, author string, url string"


def test_cleaning(spark):
    rows = [
        ("q", "", "x" * 19, "", "a", "u1"),
        ("q", "", "x" * 20, "", "a", "u2"),
        ("q", "", "<p>" + "y" * 250 + "</p> 公众号", "y" * 200 + "...", "a", "u3"),
        ("q", "", "z" * 201, "other", None, None),
    ]
    raw = spark.createDataFrame(rows, RAW)
    cleaned = cl.clean_answers(raw).orderBy("url").collect()
    assert [r["url"] for r in cleaned] == ["", "u2", "u3"]
    assert cleaned[2]["extra"]["had_html"] and cleaned[2]["extra"]["has_spam"]
    assert cleaned[2]["platform"] == "zhihu" and cleaned[2]["votes"] == 0
    assert cleaned[2]["task_annotations"]["is_low_quality"]["status"] == "unlabeled"
    stats = cl.cleaning_stats(raw).first()
    assert (stats["total"], stats["written"], stats["filtered_short"], stats["html_touched"]) == (4, 3, 1, 1)
    assert (stats["contact_hint_hits"], stats["preview_truncated"], stats["preview_changed_vs_legacy"]) == (1, 2, 1)


def test_cleaning_does_not_depend_on_partitions(spark):
    raw = spark.createDataFrame([("q", "", f"{i} " * 30, "", "a", f"u{i}") for i in range(50)], RAW)
    ids = lambda df: sorted(r["sample_id"] for r in cl.clean_answers(df).collect())
    assert ids(raw.repartition(1)) == ids(raw.repartition(7))


def test_cleaning_is_idempotent(spark):
    raw = spark.createDataFrame([(f"  a \n b{i} <i>c</i>",) for i in range(20)], "t string")
    once = raw.select(tx.normalize_text(F.col("t")).alias("t"))
    assert once.filter(tx.normalize_text(F.col("t")) != F.col("t")).count() == 0


def test_costly_columns_are_computed_once(spark):
    plan = cl.drop_short(spark.range(5).select(tx.normalize_text(F.col("id").cast("string")).alias("c")), "c")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1


def test_purge(spark):
    rows = [("q", "系统监测到异常" * 5), ("q", "short"), ("", "long enough text"), ("q", "long enough text")]
    df = spark.createDataFrame(rows, "question string, answer_full string")
    assert cl.purge_invalid(df).count() == 1


def test_dedup(spark):
    rows = [(1, "u", "a" * 100 + "x", None), (2, "u", "a" * 100 + "y", None), (3, "u", "", "a" * 100), (4, None, None, "b")]
    df = spark.createDataFrame(rows, "n int, url string, answer_full string, answer string")
    assert sorted(r["n"] for r in dd.dedup_new(df, "n").collect()) == [1, 4]
    assert [r["n"] for r in dd.anti_existing(df, df.filter("n = 3")).collect()] == [4]


def test_latest_and_pending(spark):
    rows = [("a", 1), ("a", 3), ("b", 2), ("", 9), (None, 9)]
    df = spark.createDataFrame(rows, "sample_id string, n int")
    assert sorted((r["sample_id"], r["n"]) for r in dd.latest_by_key(df, "sample_id", "n").collect()) == [("a", 3), ("b", 2)]
    done = spark.createDataFrame([("a",), ("",), (None,)], "sample_id string")
    assert sorted((str(r["sample_id"]), r["n"]) for r in dd.pending_samples(df, done).collect()) == [("", 9), ("None", 9), ("b", 2)]


def test_resolve_text(spark):
    df = spark.createDataFrame([(None, "c"), ("m", "c")], "model_input string, content string")
    assert [r[0] for r in df.select(cl.resolve_text(df)).collect()] == ["c", "m"]
    with pytest.raises(ValueError):
        cl.resolve_text(df, "other")
