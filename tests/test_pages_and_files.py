import json

import pytest
from pyspark.sql import functions as F

from winnowry import schemas
from winnowry.operators import pages as pg
from winnowry.sources import jsonl

QUESTION = """<html><head><title>T</title></head><body><h1 class="QuestionHeader-title"> 问题？ </h1>
<div class="QuestionRichText"><span class="RichText">细节</span></div>
<div class="List-item" tabindex="0"><div class="AuthorInfo-name"><a class="UserLink-link">甲</a></div>
<div class="RichContent-inner"><p>第一个回答，内容足够长了吧。</p></div>
<button aria-label="赞同 1,024"><span class="Button-label">赞同 1,024</span></button><button aria-label="评论">12 条评论</button></div>
<div class="AnswerItem"><meta itemprop="name" content="乙"><span class="RichText">第二个回答也足够长，可以保留。</span></div>
<div class="AnswerItem"><span class="RichText">第三个回答没有作者，也够长。</span></div>
<div class="AnswerItem"><span class="RichText">太短</span></div></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string")


def test_answers(spark):
    found = pg.extract_answers(pages(spark, ("u", QUESTION), ("v", "<p>no title</p>")), F.lit("now")).orderBy("position").collect()
    assert [r["author"] for r in found] == ["甲", "乙", "匿名用户"]
    assert found[0]["question"] == "问题？" and found[0]["question_detail"] == "细节"
    assert (found[0]["votes"], found[0]["comment_count"]) == (1024, 12)
    assert found[0]["answer_full"] == "第一个回答，内容足够长了吧。"


def test_cards(spark):
    card = '<article><h2><a>标题文字</a></h2><div class="RichContent-inner">短</div><div class="RichText">%s<script>x</script></div></article>'
    page = '<div class="QuestionHeader-title">页面标题</div>' + card % ("长" * 250) + '<div class="ContentItem"><p itemprop="text">' + "字" * 20 + "</p></div>"
    found = pg.extract_cards(pages(spark, ("u", page))).orderBy("position").collect()
    assert [r["question"] for r in found] == ["标题文字", "页面标题"]
    assert found[0]["answer_preview"] == "长" * 200 + "..." and found[1]["answer_preview"] == "字" * 20


def test_post_like(spark):
    page = (
        '<section class="note-item">一段足够长的文字内容<span class="like-count">3</span></section>'
        '<section>一段足够长但没有信号的文字内容</section>'
        '<section>短 like</section><section><img src="a">这一段文字超过二十个字符并且里面有一张图片所以保留</section>'
    )
    found = pg.filter_post_like(pg.card_elements(pages(spark, ("u", page)))).collect()
    assert len(found) == 2


def test_detail(spark):
    body = "<body><div class='note-content'>short</div><main><section>" + "x" * 60 + "</section></main></body>"
    rows = pages(spark, ("https://a/explore/1", body), ("https://a/b?noteId=3", "<body>whole<p>body</p></body>"), ("https://a/c", body))
    found = {r["page_id"]: r["text"] for r in pg.extract_detail_text(rows).collect()}
    assert found == {0: "x" * 60, 1: "whole body"}


def test_links_and_frontier(spark):
    a = '<a class="x" href="/question/7#a">first <b>title</b></a><a href="/question/7">again</a><a href="/other">o</a>'
    b = '<a href="https://s/question/7">later</a><a href="/question/9?x">&amp; nine</a>'
    links = pg.extract_links(pages(spark, ("u", a), ("v", b)))
    assert sorted((r["page_id"], r["link_id"], r["title"]) for r in links.collect()) == [
        (0, "7", "first title"), (1, "7", "later"), (1, "9", "& nine"),
    ]
    assert {r["link_id"]: r["title"] for r in pg.build_link_frontier(links).collect()} == {"7": "first title", "9": "& nine"}
    assert [r["link_id"] for r in pg.build_link_frontier(links, cap=1).collect()] == ["7"]


def test_link_quoting(spark):
    page = "<a href='/question/1'>one</a><A class=x HREF=/question/2>two</A><a data-x href = \"/question/3\">three</a>"
    links = pg.extract_links(pages(spark, ("u", page)))
    assert sorted((r["link_id"], r["title"]) for r in links.collect()) == [("1", "one"), ("2", "two"), ("3", "three")]


def test_blank_lines_are_skipped(spark, tmp_path):
    path = str(tmp_path / "blank.jsonl")
    with open(path, "w") as f:
        f.write('{"a": 1}\n\n   \n{"a": 2}\n')
    assert jsonl.read_jsonl(spark, path, "a int").count() == 2
    assert sorted(r["a"] for r in jsonl.read_jsonl(spark, path, "a int").collect()) == [1, 2]


def test_strict_and_tolerant_reading(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    with open(path, "w") as f:
        f.write('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert jsonl.read_jsonl(spark, path, "a int", "DROPMALFORMED").count() == 2
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, path, "a int").collect()
    good, bad = jsonl.read_jsonl_with_rejects(spark, path, "a int")
    assert good.count() == 2 and [r["line"] for r in bad.collect()] == ['{"a": ']


def test_nulls_and_text_survive_writing(spark, tmp_path):
    path = str(tmp_path / "out")
    jsonl.write_jsonl(spark.createDataFrame([("文", None)], "t string, l boolean").coalesce(1), path)
    text = spark.read.text(path).first()[0]
    assert text == '{"t":"文","l":null}'


def test_examples(spark, tmp_path):
    path = str(tmp_path / "examples.json")
    with open(path, "w") as f:
        json.dump([{"text": "a", "category": "c", "label": "low_quality"}, {"text": "b", "task_annotations": {"is_ai_generated": {"label": True, "reason": ""}}}], f)
    assert jsonl.read_examples(spark, path).count() == 2
    assert jsonl.read_examples(spark, str(tmp_path / "missing")).count() == 0


def test_schemas_parse(spark):
    for name in ("RAW_ANSWERS", "CLEANED_SAMPLES", "PRELABELED_SAMPLES", "REVIEW_DECISIONS", "REVIEWED_SAMPLES", "EXAMPLES", "SCORE_REQUESTS", "PLATFORMS", "DETECTORS", "EFFECTS", "TASKS"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0


def test_suffix(spark):
    rows = [("local", "qwen3:8b", "local-qwen3-8b"), (" doubao ", "::", "doubao-unknown"), ("a/b", "x  y--", "a-b-x-y")]
    df = spark.createDataFrame(rows, "p string, m string, want string")
    assert df.filter(jsonl.annotator_suffix(F.col("p"), F.col("m")) != F.col("want")).count() == 0
