"""Scan of stored pages as a stream: cards, detection by the cascade, actions as configured.

Every card of a page of an enabled platform is a post, named by its platform and its text. A post that already has a
result of every detector its platform asks for is passed over; any other is scored once more and gives the
actions that the settings ask for. So a post that comes again, on the same page or another, in the same batch or
after a restart, acts once; when a platform is given another detector, its posts act again when they come again.

What a post has been scored by is kept under its name for ``delay`` after the latest page that showed it, as event time
tells, and is then forgotten; so the state is bounded by the posts of that time. Pages later than that are dropped.
Detection and actions run on the fresh posts of a batch as on any table; a batch writes its own folder, and
replaces it when it runs again.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import fixed_values as fv
from ..functions import detectors as dt
from ..operators.actions import decide_actions, default_settings
from ..operators.pages import extract_cards
from ..operators.scoring import classify
from ..session import materialize, send_if_small
from .jobs import query_name

POSTS = "post_id string, platform string, text string, page_id bigint, url string, position int"
_FRESH = POSTS + ", detectors array<string>"


def url_of_pattern(url: Column, pattern: Column) -> Column:
    """Whether an address fits a platform's pattern, in which * stands for anything."""
    literal = F.regexp_replace(F.regexp_replace(pattern, r"([\\%_])", r"\\$1"), r"\*", "%")
    return F.like(url, literal)


def page_posts(pages: DataFrame, settings: dict[str, DataFrame], selectors=None, runnable=None) -> DataFrame:
    """Posts of the pages of enabled platforms, with the detectors that their platform asks for and that can run.

    A page that fits several patterns belongs to the first platform by id. Other columns of the pages are kept.
    """
    runnable = fv.RUNNABLE_DETECTORS if runnable is None else runnable
    enabled = settings["detectors"].filter("enabled").agg(F.collect_set("id").alias("on"))
    # One row for each platform: a handful, sent to every task behind a check.
    platforms = settings["platforms"].filter("enabled").crossJoin(F.broadcast(enabled)).select(
        F.col("id").alias("platform"), "url_pattern",
        F.array_intersect("detectors", F.array_intersect("on", F.array(*[F.lit(d) for d in runnable]))).alias("detectors"),
    )
    listed = platforms.agg(F.array_sort(F.collect_list(F.struct("platform", "url_pattern", "detectors"))).alias("listed"))
    fits = lambda p: url_of_pattern(F.col("url"), p["url_pattern"])
    own = pages.crossJoin(send_if_small(listed)).withColumn("_p", F.try_element_at(F.filter("listed", fits), F.lit(1))).filter("_p is not null")
    extra = [c for c in pages.columns if c not in ("page_id", "url", "html")]
    cards = extract_cards(own, selectors, keep=["_p", *extra])
    name = F.sha1(F.concat_ws("|", F.col("_p.platform"), F.col("model_input")))
    return cards.select(
        name.alias("post_id"), F.col("_p.platform").alias("platform"), F.col("model_input").alias("text"), "page_id", "url", "position",
        F.col("_p.detectors").alias("detectors"), *extra,
    )


def first_sight(posts: DataFrame, time: str, delay: str) -> DataFrame:
    """Posts that lack the result of some detector, each once; ``time`` says when their page was seen."""
    columns = [c.split(" ")[0] for c in POSTS.split(", ")]

    def see(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        done = set(state.get[0]) if state.exists else set()
        first, asked, last = None, set(), None
        for frame in frames:
            for row in frame.itertuples(index=False):
                asked.update(row.detectors)
                place = (row.page_id, row.position)
                first = min(first, (place, row), key=lambda x: x[0]) if first else (place, row)
                last = max(last, row.seen_ms) if last is not None else row.seen_ms
        if asked - done:
            yield pd.DataFrame({c: [getattr(first[1], c)] for c in columns} | {"detectors": [sorted(asked)]})
        state.update((sorted(done | asked),))
        until = int(last) + span
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    # The delay as Spark reads it, in milliseconds.
    spark = posts.sparkSession
    span = spark.sql(f"SELECT CAST(unix_millis(timestamp_micros(0) + INTERVAL {delay}) AS BIGINT) AS ms").first()["ms"]
    timed = posts.withColumn("seen", F.col(time).cast("timestamp")).withWatermark("seen", delay)
    named = timed.select(*columns, "detectors", "seen", F.unix_millis("seen").alias("seen_ms"))
    return named.groupBy("post_id").applyInPandasWithState(see, _FRESH, "detectors array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def detect_by_cascade(posts: DataFrame, **options) -> DataFrame:
    """(post_id, detector_id, should_filter, confidence) of posts, by the scoring cascade."""
    asked = posts.withColumn("task_ids", F.lit(None).cast("array<string>"))
    scored = classify(asked, **options)
    tasks = fv.DETECTOR_TASKS
    answer = F.struct(*[F.col(c) for c in scored.columns if c not in asked.columns])
    found = F.array(*[F.struct(F.lit(d).alias("detector_id"), dt.to_detection(answer, t).alias("d")) for d, t in tasks.items()])
    each = scored.select("post_id", "detectors", F.explode(found).alias("f"))
    return each.filter(F.array_contains("detectors", F.col("f.detector_id"))).select("post_id", "f.detector_id", "f.d.should_filter", "f.d.confidence")


def act(fresh: DataFrame, settings: dict[str, DataFrame], detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The actions on posts that are scored for the first time."""
    posts = materialize(fresh, "scan-posts")
    actions = decide_actions(posts, detect(posts), settings)
    return actions.join(posts.select("post_id", "page_id", "position"), "post_id")


def scan_pages(
    pages: DataFrame, store: str, checkpoint: str, time: str, delay: str, settings: dict[str, DataFrame] | None = None,
    selectors=None, detect: Callable[[DataFrame], DataFrame] = detect_by_cascade,
):
    """Start the scan of a stream of pages (page_id, url, html and the time they were seen); actions go to ``store``."""
    settings = default_settings(pages.sparkSession) if settings is None else settings

    def add(batch: DataFrame, batch_id: int) -> None:
        act(batch, settings, detect).write.mode("overwrite").parquet(f"{store}/stream=s{query_name(batch.sparkSession)}/batch={batch_id}")

    fresh = first_sight(page_posts(pages, settings, selectors), time, delay)
    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_table(pages: DataFrame, settings: dict[str, DataFrame] | None = None, selectors=None, detect=detect_by_cascade) -> DataFrame:
    """The actions of a scan of a whole table, as one batch."""
    settings = default_settings(pages.sparkSession) if settings is None else settings
    posts = page_posts(pages, settings, selectors)
    first = F.min_by(F.struct(*[F.col(c) for c in posts.columns if c != "post_id"]), F.struct("page_id", "position"))
    return act(posts.groupBy("post_id").agg(first.alias("_f")).select("post_id", "_f.*"), settings, detect)
