"""The page scan as a stream: equal to one batch, over several batches and restarts, with bounded state."""

import glob
import os

from pyspark.sql import functions as F

from winnowry import schemas
from winnowry.operators.actions import default_settings
from winnowry.operators.pages import broken_pages
from winnowry.streaming import page_scan

CARD = "<article><h2>{q}</h2><p>{p}</p></article>"
SELECTORS = {"cards": ["article"], "question": ["h2"], "page_question": ["title"], "preview": ["p"]}
SCHEMA = "page_id bigint, url string, html string, seen_at timestamp"


def page(n, url, *cards, day=1):
    html = "".join(CARD.format(q=f"question {c}", p=f"{c} preview of at least twenty characters") for c in cards)
    return (n, url, html, f"2026-01-{day:02d} 00:00:00")


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, t string").selectExpr("page_id", "url", "html", "cast(t as timestamp) AS seen_at")


def settings(spark, zhihu=("low-quality",), effects=("label",)):
    platforms = [("xiaohongshu", "", "https://x.com/*", ["ai-content"], list(effects), True), ("zhihu", "", "https://z.com/*", list(zhihu), list(effects), True), ("off", "", "https://o.com/*", ["low-quality"], ["label"], False)]
    return default_settings(spark) | {"platforms": spark.createDataFrame(platforms, schemas.PLATFORMS)}


def detect(posts):
    """Every post is flagged by every detector that is asked for, but those whose text says fine."""
    each = posts.select("post_id", "text", F.explode("detectors").alias("detector_id"))
    return each.select("post_id", "detector_id", (~F.contains("text", F.lit("fine"))).alias("should_filter"), F.lit(0.9).alias("confidence"))


def shown(df):
    return sorted(tuple(r) for r in df.select("platform", "detector_id", "effect_id", "post_id").collect())


class Scan:
    def __init__(self, spark, tmp_path, delay="10 days"):
        self.spark, self.inbox, self.store, self.state, self.delay = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), delay

    def run(self, rows, config=None):
        frame(self.spark, rows).coalesce(1).write.mode("append").parquet(self.inbox)
        pages = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.inbox)
        page_scan.scan_pages(pages, self.store, self.state, "seen_at", self.delay, config or settings(self.spark), SELECTORS, detect).awaitTermination()
        names = "post_id string, platform string, page_id bigint, position int, detector_id string, effect_id string"
        return shown(self.spark.read.schema(names).option("recursiveFileLookup", True).parquet(self.store))


def test_stream_equals_batch_over_batches_and_restarts(spark, tmp_path):
    first = [page(1, "https://z.com/1", "a", "b", "fine"), page(2, "https://x.com/2", "a", "c"), page(3, "https://o.com/3", "a"), page(4, "https://n.com/4", "a"), page(5, "https://z.com/5", "a", "a")]
    second = [page(6, "https://z.com/6", "a", "d", day=2), (7, "https://z.com/7", None, "2026-01-02 00:00:00"), (8, None, "<p>", "2026-01-02 00:00:00"), page(9, "https://x.com/2", "c", day=2)]
    scan = Scan(spark, tmp_path)
    one = scan.run(first)
    assert len(one) == 4 and [r[0] for r in one] == ["xiaohongshu"] * 2 + ["zhihu"] * 2
    two = scan.run(second)
    whole = page_scan.scan_table(frame(spark, first + second), settings(spark), SELECTORS, detect)
    assert two == shown(whole) and len(two) == 5 and len(set(two)) == 5
    # Nothing new: nothing acts, nothing is lost.
    assert scan.run([page(10, "https://z.com/1", "a", "b", day=3)]) == two


def test_another_detector_lets_posts_act_again(spark, tmp_path):
    scan = Scan(spark, tmp_path)
    scan.run([page(1, "https://z.com/1", "a")])
    got = scan.run([page(2, "https://z.com/1", "a", "b", day=2)], settings(spark, zhihu=("low-quality", "ai-content")))
    detectors = [r[1] for r in got]
    assert detectors.count("ai-content") == 2 and detectors.count("low-quality") == 3


def test_state_is_bounded_by_the_delay(spark, tmp_path):
    scan = Scan(spark, tmp_path, "2 days")
    for day in range(1, 20, 3):
        scan.run([page(day, "https://z.com/1", *[f"{day}-{k}" for k in range(20)], day=day)])
    rows = spark.read.format("statestore").load(scan.state)
    assert 0 < rows.filter("value is not null").count() <= 60
    # A post that comes again after it was forgotten acts again.
    before = len(scan.run([page(50, "https://z.com/1", "x", day=20)]))
    assert len(scan.run([page(51, "https://z.com/1", "1-0", day=28)])) == before + 1
    assert glob.glob(os.path.join(scan.store, "stream=*", "batch=*"))


def test_patterns_are_literal_but_for_stars(spark):
    cases = [("https://a.com/x_y", "https://a.com/x_*", True), ("https://a.com/xzy", "https://a.com/x_*", False), ("100%", "100%", True), ("100x", "100%", False), (None, "*", None), ("a\\b", "a\\*", True)]
    df = spark.createDataFrame(cases, "url string, pattern string, want boolean")
    got = df.select("want", page_scan.url_of_pattern(F.col("url"), F.col("pattern")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_broken_pages_are_listed(spark):
    df = spark.createDataFrame([(1, "u", "<p>fine</p>"), (2, "v", None), (3, "w", "<![x"), (4, "x", "")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["error"] for r in broken_pages(df).collect()}
    assert got[2] == "no page" and 1 not in got and 4 not in got and (3 not in got or got[3])
