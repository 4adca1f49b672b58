"""Cleaning, derived text and record queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import cleaning as cl, dedup as dd, ordering as od
from ..sources.tables import answers_from_documents, questions_and_answers, table, wide_table
from .registry import (
    CLEAN, PAGE_SPACE, QA, RAW, clean, entities, legacy, model_input, no_tags, preview, query, visible,
)

# The tables hold no Chinese text, so contact phrases of their languages are added.
CONTACT = [*fv.CONTACT_PHRASES, "worthless", "contact", "@"]


def raw_answers(spark, sf, heavy=True):
    return answers_from_documents((wide_table if heavy else table)(spark, sf, "documents"))


SAMPLE_ID = "substring(sha1(platform || '||' || url || '||' || author || '||' || q), 1, 16)"


@query("clean_documents", f"""WITH {CLEAN}
SELECT {SAMPLE_ID} AS sample_id, q AS question, {model_input('q', 'p')} AS model_input, p AS answer_preview,
       a AS answer_full_clean, author, votes, platform, url, cut AS preview_was_truncated, had_html,
       contact AS has_contact_hint, length(answer_full) AS source_answer_chars, length(a) AS clean_answer_chars
FROM c1 WHERE length(a) >= 20""")
def clean_documents(spark, sf):
    return cl.clean_answers(raw_answers(spark, sf)).select(
        "sample_id", "question", "model_input", "answer_preview", "answer_full_clean", "author", "votes", "platform",
        "url", "extra.preview_was_truncated", "extra.had_html", "extra.has_contact_hint",
        "extra.source_answer_chars", "extra.clean_answer_chars",
    )


@query("cleaning_stats", f"""WITH {CLEAN}
SELECT count(*) AS total, count(*) FILTER (WHERE length(a) >= 20) AS written,
       count(*) FILTER (WHERE length(a) < 20) AS filtered_short, count(*) FILTER (WHERE had_html) AS html_touched,
       count(*) FILTER (WHERE spaced) AS whitespace_normalized, count(*) FILTER (WHERE contact) AS contact_hint_hits,
       count(*) FILTER (WHERE length(a) >= 20 AND cut) AS preview_truncated,
       count(*) FILTER (WHERE length(a) >= 20 AND old <> '' AND old <> p) AS preview_changed_vs_legacy FROM c1""")
def cleaning_stats(spark, sf):
    return cl.cleaning_stats(raw_answers(spark, sf))


@query("cleaning_example_view", f"""WITH {CLEAN}
SELECT doc_id, substring(question, 1, 60) AS question, substring(answer_full, 1, 160) AS raw_answer,
       substring(a, 1, 160) AS clean_full, substring(old, 1, 120) AS legacy_preview, substring(p, 1, 120) AS new_preview
FROM c1 WHERE length(a) >= 20 AND old <> '' AND old <> p ORDER BY doc_id LIMIT 5""")
def cleaning_example_view(spark, sf):
    return cl.cleaning_example_view(raw_answers(spark, sf), "doc_id")


@query("model_input_qa", f"""WITH {QA}, n AS (
  SELECT conv_id, turn, {clean('question')} AS q, {clean('answer_full')} AS a, answer_full FROM qa),
k AS (SELECT *, 'zhihu||||||' || q AS base, {preview('a')} AS p FROM n)
SELECT conv_id, turn, {model_input('q', 'p')} AS model_input,
       substring(sha1(CASE WHEN q = '' THEN base || '||' || answer_full ELSE base END), 1, 16) AS sample_id FROM k""")
def model_input_qa(spark, sf):
    qa = questions_and_answers(table(spark, sf, "conversations"))
    empty = F.lit("")
    return (
        qa.withColumns({"q": tx.normalize_text(F.col("question")), "a": tx.normalize_text(F.col("answer_full"))})
        .select(
            "conv_id", "turn",
            tx.build_model_input(F.col("q"), tx.build_preview(F.col("a"))).alias("model_input"),
            tx.build_sample_id(F.lit(None).cast("string"), empty, empty, F.col("q"), F.col("answer_full")).alias("sample_id"),
        )
    )


@query("build_sample_id", f"""WITH {CLEAN}
SELECT doc_id, {SAMPLE_ID} AS sample_id,
       substring(sha1(platform || '||' || url || '||' || author || '||' || q || '||' || answer_full), 1, 16) AS full_id
FROM c1""")
def build_sample_id(spark, sf):
    raw = raw_answers(spark, sf).withColumn("q", tx.normalize_text(F.col("question")))
    parts = [F.col(c) for c in ("platform", "url", "author", "q", "answer_full")]
    return raw.select(
        "doc_id", tx.build_sample_id(*parts).alias("sample_id"), tx.build_sample_id(*parts, True).alias("full_id")
    )


@query("normalize_text", f"SELECT page_id, {clean(entities('html'))} AS clean FROM pages")
def normalize_text(spark, sf):
    return wide_table(spark, sf, "pages").select("page_id", tx.normalize_text(F.col("html")).alias("clean"))


@query("clean_flags", f"""WITH d AS (SELECT page_id, html, {entities('html')} AS t FROM pages)
SELECT page_id, {no_tags('t')} <> t AS had_html, {clean('t')} <> {visible('t')} AS whitespace_normalized,
       length(html) AS chars_before, length({clean('t')}) AS chars_after FROM d""")
def clean_flags(spark, sf):
    flags = tx.clean_flags(F.col("html"))
    return wide_table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in flags.items()])


@query("has_contact_hint", f"SELECT doc_id, regexp_matches(text, '(?i){'|'.join(CONTACT)}') AS has_contact_hint FROM documents")
def has_contact_hint(spark, sf):
    docs = wide_table(spark, sf, "documents")
    return docs.select("doc_id", tx.has_contact_hint(F.col("text"), CONTACT).alias("has_contact_hint"))


@query("build_preview", f"SELECT doc_id, {preview('text')} AS preview, length(text) > 200 AS cut FROM documents")
def build_preview(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", tx.build_preview(text).alias("preview"), tx.is_cut(text).alias("cut")
    )


@query("truncate_legacy", f"SELECT doc_id, {legacy('text')} AS cut_text FROM documents")
def truncate_legacy(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.truncate_legacy(F.col("text")).alias("cut_text"))


@query("truncate_for_model", """SELECT doc_id, substring(text, 1, 1200) AS for_labels, substring(text, 1, 500) AS for_tuning,
       substring(text, 1, 3000) AS for_pages FROM documents""")
def truncate_for_model(spark, sf):
    cut = lambda n, name: tx.truncate_for_model(F.col("text"), n).alias(name)
    return table(spark, sf, "documents").select(
        "doc_id", cut(fv.LABEL_CHARS, "for_labels"), cut(fv.TUNING_CHARS, "for_tuning"), cut(fv.PAGE_CHARS, "for_pages")
    )


@query("resolve_text", "SELECT doc_id, coalesce(text, '') AS resolved FROM documents")
def resolve_text(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("text", "content")
    return docs.select("doc_id", cl.resolve_text(docs).alias("resolved"))


@query("drop_short", f"WITH {CLEAN} SELECT doc_id, a AS answer_full_clean FROM c1 WHERE length(a) >= 20")
def drop_short(spark, sf):
    raw = raw_answers(spark, sf)
    cleaned = raw.select("doc_id", tx.normalize_text(F.col("answer_full")).alias("answer_full_clean"))
    return cl.drop_short(cleaned)


@query("purge_invalid", f"""WITH {RAW} SELECT doc_id, question FROM raw
WHERE length(answer_full) >= 10 AND question <> '' AND NOT regexp_matches(answer_full, '系统监测|验证按钮')""")
def purge_invalid(spark, sf):
    return cl.purge_invalid(raw_answers(spark, sf)).select("doc_id", "question")


# ---- records -------------------------------------------------------------------------------

BY_SOURCE = f"{RAW}, keyed AS (SELECT doc_id, author || '|' || substring(answer_full, 1, 100) AS key FROM raw)"


def by_source(spark, sf):
    """Answers whose address is their source, so that copies within a source repeat a key."""
    return raw_answers(spark, sf).withColumn("url", F.col("author"))


@query("dedup_key", f"WITH {BY_SOURCE} SELECT doc_id, key FROM keyed")
def dedup_key(spark, sf):
    raw = by_source(spark, sf)
    return raw.select("doc_id", dd.dedup_key(raw).alias("key"))


BY_TEXT = f"{RAW}, keyed AS (SELECT doc_id, '|' || substring(answer_full, 1, 100) AS key FROM raw)"


def by_text(spark, sf):
    """Answers without an address, so that every copy repeats a key."""
    return raw_answers(spark, sf).withColumn("url", F.lit(""))


@query("dedup_first", f"""WITH {BY_TEXT}
SELECT doc_id FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1""")
def dedup_first(spark, sf):
    return dd.dedup_new(by_text(spark, sf), "doc_id").select("doc_id")


@query("anti_existing", f"""WITH {BY_TEXT}
SELECT doc_id FROM keyed WHERE key NOT IN (SELECT key FROM keyed JOIN labels USING (doc_id))""")
def anti_existing(spark, sf):
    answers = by_text(spark, sf)
    stored = answers.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    return dd.anti_existing(answers, stored).select("doc_id")


@query("latest_by_key", """SELECT user_id, event_id, event_type, value FROM events
WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def latest_by_key(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return dd.latest_by_key(events, "user_id", "event_id")


@query("first_per_key", """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def first_per_key(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return od.first_per_key(events, ["user_id", "event_type"], "event_id")


@query("last_per_key", """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def last_per_key(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return od.last_per_key(events, ["user_id", "event_type"], "event_id")


@query("union_distinct", "SELECT text FROM documents UNION SELECT text FROM benchmark UNION SELECT text FROM conversations")
def union_distinct(spark, sf):
    return dd.union_distinct(*[table(spark, sf, t).select("text") for t in ("documents", "benchmark", "conversations")])


@query("union_all", """SELECT source_table, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT 'documents' AS source_table, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark
  UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY 1""")
def union_all(spark, sf):
    texts = [
        table(spark, sf, t).select(F.lit(t).alias("source_table"), "text")
        for t in ("documents", "benchmark", "conversations")
    ]
    return dd.union_all(*texts).groupBy("source_table").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars")
    )


@query("first_n", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 500")
def first_n(spark, sf):
    return od.first_n(table(spark, sf, "documents"), 500, "doc_id").select("doc_id", "lang", "source", "n_chars")


# ---- columns of pages and addresses ------------------------------------------------------------

HIDDEN = "|".join(
    [r"<!--.*?-->"] + [rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "svg", "noscript")]
)


def page_text(x):
    bare = f"regexp_replace(regexp_replace({x}, '(?is){HIDDEN}', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({entities(bare)}, '{PAGE_SPACE}+', ' ', 'g'), ' ')"


@query("html_to_text", f"SELECT page_id, {page_text('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return wide_table(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("parse_count", r"""SELECT event_id,
  coalesce(TRY_CAST(replace(regexp_extract('up ' || replace(CAST(value * 1000 AS VARCHAR), '.', ',') || ' x', '[\d,]+'), ',', '') AS BIGINT), 0) AS votes,
  coalesce(TRY_CAST(regexp_extract(CAST(event_id AS VARCHAR) || ' 条评论', '(\d+)\s*条?评论', 1) AS BIGINT), 0) AS comments
FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS value FROM events)""")
def parse_count(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.round(F.col("value") * 100).cast("bigint").alias("value"))
    shown = F.concat(F.lit("up "), F.replace((F.col("value") * 1000).cast("string"), F.lit("."), F.lit(",")), F.lit(" x"))
    return events.select(
        "event_id", tx.parse_count(shown).alias("votes"),
        tx.parse_comment_count(F.concat(F.col("event_id").cast("string"), F.lit(" 条评论"))).alias("comments"),
    )


HOSTS = [*fv.PLATFORM_HOSTS, ("net", "example.net"), ("com", "example.com")]


@query("platform_of", """SELECT page_id, CASE WHEN contains(url, 'xiaohongshu.com') THEN 'xiaohongshu'
  WHEN contains(url, 'zhihu.com') THEN 'zhihu' WHEN contains(url, 'example.net') THEN 'net'
  WHEN contains(url, 'example.com') THEN 'com' END AS platform FROM pages""")
def platform_of(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.platform_of(F.col("url"), HOSTS).alias("platform"))
