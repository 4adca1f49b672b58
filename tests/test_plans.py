"""What plans must look like: filters at the scan, no sort of whole rows, costly columns once."""

import pytest
from pyspark.sql import Observation, functions as F

from winnowry.operators import cleaning as cl, dedup as dd, ordering as od, pages as pg
from winnowry.plans.pages import ANSWERS, CARDS
from winnowry.sources.tables import answers_from_documents

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SMALL}/pages.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_page_filters_reach_the_scan(pages):
    found = [
        pg.extract_answers(pages, F.lit(""), ANSWERS), pg.extract_cards(pages, CARDS), pg.card_elements(pages, ["article"]),
        pg.filter_post_like(pg.card_elements(pages, ["article"])), pg.extract_detail_text(pages, False), pg.broken_pages(pages),
    ]
    for df in found:
        text = plan_of(df.filter("page_id > 5"))
        assert "GreaterThan(page_id,5)" in text and text.count("ArrowEvalPython") == 1


def test_a_filter_on_parsed_fields_does_not_parse_again(pages):
    answers = pg.extract_answers(pages, F.lit(""), ANSWERS)
    some = answers.filter("length(answer_full) > 40 and question <> 'x' and votes >= 0 and page_id > 3")
    text = plan_of(some)
    assert text.count("ArrowEvalPython") == 1 and "GreaterThan(page_id,3)" in text
    want = [r for r in answers.collect() if len(r["answer_full"]) > 40 and r["page_id"] > 3]
    assert some.count() == len(want) > 0


def test_cleaning_filters_come_before_the_costly_columns(docs):
    raw = answers_from_documents(docs)
    lines = plan_of(cl.clean_answers(raw, entities=False).filter("author = 'src1' and length(answer_full_clean) > 50 and extra.had_html")).splitlines()
    costly = next(i for i, line in enumerate(lines) if "Generate inline" in line)
    assert any("Filter" in line and "src1" in line for line in lines[costly:])
    assert all("regexp_replace" not in line for line in lines[:costly] if "Filter" in line)
    view = plan_of(cl.cleaning_example_view(raw.filter("doc_id > 5"), "doc_id"))
    assert "GreaterThan(doc_id,5)" in view


def test_counters_come_with_the_write(spark, docs, tmp_path):
    raw = answers_from_documents(docs)
    seen = Observation("cleaning")
    cl.clean_answers(raw, observation=seen).write.parquet(str(tmp_path / "clean"))
    want = cl.cleaning_stats(raw).first().asDict()
    assert seen.get == want and spark.read.parquet(str(tmp_path / "clean")).count() == want["written"]


def test_first_and_last_rows_by_locators(spark, docs):
    for df in (dd.dedup_new(answers_from_documents(docs), "doc_id"), dd.latest_by_key(docs, "source", "n_chars")):
        text = plan_of(df)
        assert "SortAggregate" not in text and "min_by" not in text and "max_by" not in text
        # What the aggregate sends: a digest and a number for each key.
        sent = [line for line in text.splitlines() if "HashAggregate(keys=[_key_digest" in line]
        assert sent and all("text" not in line for line in sent)


KIND = "k string, n bigint, d date, t timestamp, s string, v double, m map<string,int>"


def test_first_and_last_rows_against_plain(spark):
    rows = spark.range(600).selectExpr(
        "CASE WHEN id % 11 = 0 THEN NULL ELSE concat('k', id % 37) END AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE (id * 7919) % 23 - 11 END AS n",
        "date_add(DATE '2026-01-01', CAST((id * 31) % 17 AS INT)) AS d", "timestamp_micros(-id * 1000) AS t", "concat('s', (id * 13) % 19) AS s",
        "CAST(id % 5 AS DOUBLE) AS v", "map('a', CAST(id % 3 AS INT)) AS m",
    )
    both = rows.union(rows)
    for order in ("n", "d", "t", "s", "v"):
        for pick, name in ((od.first_per_key, min), (od.last_per_key, max)):
            got = {r["k"]: r for r in pick(both, ["k"], order).collect()}
            groups = {}
            for r in both.collect():
                groups.setdefault(r["k"], []).append(r)
            assert set(got) == set(groups) and len(pick(both, ["k"], order).collect()) == len(groups)
            for k, rs in groups.items():
                known = [r[order] for r in rs if r[order] is not None]
                assert got[k][order] == (name(known) if known else None)
                assert got[k] in rs
    top = spark.createDataFrame([("a", 2**63 - 1, "x"), ("a", -(2**63), "y"), ("a", None, "z")], "k string, n bigint, x string")
    assert od.first_per_key(top, ["k"], "n").first()["x"] == "y" and od.last_per_key(top, ["k"], "n").first()["x"] == "x"
    assert od.first_per_key(top.filter("n is null"), ["k"], "n").first()["x"] == "z" and od.last_per_key(top.limit(0), ["k"], "n").count() == 0
