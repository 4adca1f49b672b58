"""Keyword, neighbor, cascade, rule and action queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import annotations as an, detectors as dt, prompts as pr
from ..functions.embedding import embed_text
from ..operators import actions as ac, ann, knn, scoring as sc
from ..session import materialize
from ..sources.tables import table, wide_table
from .registry import clean, query, quoted, round2, values

LOW, AI = fv.LOW_QUALITY, fv.AI_GENERATED

# The tables hold no Chinese text, so words of their languages join the default dictionaries.
WORDS = [*fv.LOW_QUALITY_KEYWORDS, "worthless", "the", "que", "und", "%%%"]
PLATFORM_WORDS = {"zhihu": [*fv.LOW_QUALITY_KEYWORDS_BY_PLATFORM["zhihu"], "for", "ch "], "src": ["tion"]}
AI_WORDS = [*fv.AI_KEYWORDS, "de la", "###", "***"]
RULE_WORDS = [*fv.RULE_SCORE_KEYWORDS, "worthless", "@"]
RULE_KEYS = [*fv.RULE_KEYWORDS[LOW], "tion", "***"]


def hits(c, words):
    return f"list_filter({values(words)}, lambda k: contains({c}, k))"


@query("keyword_hits", f"SELECT doc_id, array_to_string({hits('text', WORDS)}, ',') AS hits FROM documents")
def keyword_hits(spark, sf):
    docs = wide_table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(dt.keyword_hits(F.col("text"), WORDS), ",").alias("hits"))


PLATFORM = "CASE doc_id % 3 WHEN 0 THEN 'zhihu' WHEN 1 THEN 'xiaohongshu' END"
LOW_HITS = f"CASE WHEN platform = 'zhihu' THEN {hits('text', PLATFORM_WORDS['zhihu'])} ELSE {hits('text', WORDS)} END"


@query("keyword_hits_by_platform", f"""SELECT doc_id, array_to_string({LOW_HITS}, ',') AS hits FROM (
  SELECT *, {PLATFORM} AS platform FROM documents)""")
def keyword_hits_by_platform(spark, sf):
    docs = wide_table(spark, sf, "documents").withColumn("platform", F.expr(PLATFORM))
    found = dt.keyword_hits_by_platform(F.col("text"), F.col("platform"), WORDS, PLATFORM_WORDS)
    return docs.select("doc_id", F.array_join(found, ",").alias("hits"))


def count_all(pattern):
    return f"len(regexp_extract_all(text, {quoted(pattern)}))"


def _words():
    total = []
    for w in RULE_WORDS:
        if any(x.isascii() and x.isalpha() for x in w):
            total.append(count_all(f"(?i){w}"))
        else:
            total.append(f"CAST((strlen(text) - strlen(replace(text, {quoted(w)}, ''))) / {len(w.encode())} AS BIGINT)")
    return " + ".join(total)


LIST_LINE = rf"(?m)^[0-9]+[.、][{fv.PAGE_SPACE}]*[^\n]{{0,10}}$"
RULE = f"""m AS (SELECT doc_id, lang, text, length(text) AS chars, {_words()} AS words,
  {' + '.join(count_all(p) for p in [LIST_LINE, *dt.RUN_PATTERNS])} AS patterns, {count_all(dt.SENTENCE)} AS sentences,
  length(regexp_replace(text, {quoted(dt.PLAIN)}, '', 'g')) AS special FROM src),
f AS (SELECT *, chars < 30 AS short, sentences > 0 AND chars::DOUBLE / greatest(sentences, 1)::DOUBLE < 10 AS choppy,
  chars > 0 AND special::DOUBLE / greatest(chars, 1)::DOUBLE > 0.3::DOUBLE AS symbols FROM m),
s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  (CASE WHEN short THEN 0.3::DOUBLE WHEN chars > 2000 THEN (-0.1)::DOUBLE ELSE 0.0::DOUBLE END)
  + least(words::DOUBLE * 0.1::DOUBLE, 0.4::DOUBLE) + least(patterns::DOUBLE * 0.05::DOUBLE, 0.3::DOUBLE)
  + (CASE WHEN choppy THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN symbols THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END))) AS confidence FROM f)"""


@query("low_quality_score", f"""WITH src AS (SELECT doc_id, lang, text FROM documents), {RULE}
SELECT doc_id, confidence > 0.5::DOUBLE AS should_filter, confidence, concat_ws('; ', CASE WHEN short THEN '{fv.REASON_SHORT}' END,
  CASE WHEN words > 0 THEN '包含 ' || words || ' 个低质量关键词' END, CASE WHEN patterns > 0 THEN '匹配 ' || patterns || ' 个低质量模式' END,
  CASE WHEN choppy THEN '{fv.REASON_SENTENCES}' END, CASE WHEN symbols THEN '{fv.REASON_SPECIAL}' END) AS reasons FROM s""")
def low_quality_score(spark, sf):
    docs = wide_table(spark, sf, "documents").select("doc_id", "text")
    scored = dt.with_low_quality_score(docs, "text", "s", RULE_WORDS)
    return scored.select("doc_id", "s.should_filter", "s.confidence", F.array_join("s.reasons", "; ").alias("reasons"))


@query("quality_by_language", f"""WITH src AS (SELECT doc_id, lang, {clean('text')} AS text FROM documents WHERE length({clean('text')}) >= 20), {RULE}
SELECT lang, count(*) AS answers, count(*) FILTER (WHERE confidence > 0.5::DOUBLE) AS flagged,
  CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS BIGINT)::DOUBLE / count(*)::DOUBLE / 10000.0::DOUBLE AS mean_score FROM s GROUP BY 1""")
def quality_by_language(spark, sf):
    """Clean, drop short answers, score, and aggregate per language."""
    from ..functions.text import normalize_text
    from ..operators.cleaning import drop_short

    docs = wide_table(spark, sf, "documents").select("lang", normalize_text(F.col("text")).alias("clean"))
    scored = dt.with_low_quality_score(drop_short(docs, "clean"), "clean", "s", RULE_WORDS)
    points = F.round(F.col("s.confidence") * 10000).cast("bigint")
    return scored.groupBy("lang").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if("s.should_filter").alias("flagged"),
        (F.sum(points).cast("double") / F.count(F.lit(1)).cast("double") / 10000.0).alias("mean_score"),
    )


@query("fallback_rule_score", f"""SELECT doc_id, n > 0 AS should_filter, least(0.9::DOUBLE, 0.5::DOUBLE + n::DOUBLE * 0.15::DOUBLE) AS confidence
FROM (SELECT doc_id, len({hits('text', RULE_KEYS)}) AS n FROM documents)""")
def fallback_rule_score(spark, sf):
    docs = wide_table(spark, sf, "documents")
    return docs.select("doc_id", dt.fallback_rule_score(F.col("text"), LOW, RULE_KEYS).alias("s")).select("doc_id", "s.*")


@query("two_class_detection", """SELECT event_id, coalesce(a, 0.0::DOUBLE) > coalesce(h, 0.0::DOUBLE) AS should_filter, coalesce(a, 0.0::DOUBLE) AS confidence
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 500.0::DOUBLE END AS a,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1.0::DOUBLE - value / 500.0::DOUBLE END AS h FROM events)""")
def two_class_detection(spark, sf):
    share = F.col("value") / F.lit(500.0)
    ai, human = F.when(F.col("event_id") % 7 != 0, share), F.when(F.col("event_id") % 5 != 0, F.lit(1.0) - share)
    return table(spark, sf, "events").select("event_id", dt.two_class_detection(ai, human).alias("d")).select("event_id", "d.*")


@query("to_detection", f"""SELECT event_id, CASE WHEN k = 0 THEN value > 250 WHEN k = 1 THEN value > 100 ELSE value > 400 END AS should_filter,
  CASE WHEN k = 0 THEN value / 500.0::DOUBLE WHEN k = 1 THEN CASE WHEN value > 100 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE - 0.7::DOUBLE END
  ELSE CASE WHEN value > 400 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE - 0.7::DOUBLE END END AS confidence,
  CASE WHEN k = 0 AND event_id % 2 = 0 THEN 'own' ELSE 'overall' END AS reason FROM (SELECT *, event_id % 3 AS k FROM events)""")
def to_detection(spark, sf):
    value, k = F.col("value"), F.col("event_id") % 3
    own = F.when(F.col("event_id") % 2 == 0, "own").otherwise("")
    results = F.when(k == 0, F.create_map(F.lit(LOW), an.result(value > 250, value / F.lit(500.0), own)))
    reply = F.struct(
        results.alias("task_results"), F.when(k == 1, value > 100).otherwise(value > 400).alias(LOW),
        F.lit(False).alias(AI), F.lit(0.7).alias("confidence"), F.lit("overall").alias("reason"),
    )
    return table(spark, sf, "events").select("event_id", dt.to_detection(reply, LOW).alias("d")).select("event_id", "d.*")


@query("action_label", f"""SELECT event_id, CASE event_type WHEN 'view' THEN '{fv.DETECTOR_LABELS['ai-content']}' WHEN 'click' THEN '{fv.DETECTOR_LABELS['low-quality']}'
  ELSE '{fv.OTHER_LABEL}' END AS label_text, '{fv.CONFIDENCE_LABEL}' || printf('%.1f%%', (event_id % 101) / 100.0::DOUBLE * 100.0::DOUBLE) AS confidence_text FROM events""")
def action_label(spark, sf):
    detector = F.when(F.col("event_type") == "view", "ai-content").when(F.col("event_type") == "click", "low-quality").otherwise("x")
    confidence = (F.col("event_id") % 101) / F.lit(100.0)
    return table(spark, sf, "events").select("event_id", dt.action_label(detector, confidence).alias("a")).select("event_id", "a.*")


# ---- nearest examples --------------------------------------------------------------------------

CENTERS = """centers AS (SELECT label AS id, list(m ORDER BY i) AS v FROM (
  SELECT label, i, CAST(sum(CAST(e[i] AS DECIMAL(18, 9))) AS DOUBLE) / count(*)::DOUBLE AS m
  FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


def nearest(queries, base, qid, bid, k=3):
    """Top k by rounded squared distance and id."""
    d = "round(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS neighbor_rank
      FROM (SELECT q.{qid} AS query_id, b.{bid} AS id, {d} AS distance FROM {queries} q, {base} b)
      QUALIFY neighbor_rank <= {k}"""


def label_centers(spark, sf):
    """Mean vector of every label, summed exactly: as many rows as there are labels."""
    one = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = F.sum(F.col("x").cast("double").cast("decimal(18,9)")).cast("double") / F.count(F.lit(1)).cast("double")
    means = one.groupBy("label", "i").agg(mean.alias("m"))
    # One entry per dimension.
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"])
    return means.groupBy("label").agg(vector.alias("embedding")).withColumnRenamed("label", "id")


@query("knn_join", f"""WITH {CENTERS}, q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT query_id, id, neighbor_rank, round(distance, 4) AS distance FROM ({nearest('q', 'centers', 'vec_id', 'id')})""")
def knn_join(spark, sf):
    queries = wide_table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    found = knn.knn_join(queries, label_centers(spark, sf))
    return found.withColumn("distance", F.round("distance", 4))


@query("knn_join_cells", f"""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT query_id, id, neighbor_rank, round(distance, 4) AS distance FROM ({nearest('q', 'q', 'vec_id', 'vec_id')})""")
def knn_join_cells(spark, sf):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    found = knn.knn_join_cells(queries, vectors.select(F.col("vec_id").alias("id"), "embedding"))
    return found.withColumn("distance", F.round("distance", 4))


@query("knn_votes", f"""WITH {CENTERS}, q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT query_id, CAST(count(*) FILTER (WHERE id % 2 = 1) AS DOUBLE) / 3.0::DOUBLE AS votes FROM ({nearest('q', 'centers', 'vec_id', 'id')}) GROUP BY 1""")
def knn_votes(spark, sf):
    base = label_centers(spark, sf).withColumn("odd", (F.col("id") % 2).cast("int"))
    local = knn.collect_base(base, ["id", "embedding", "odd"])
    near = knn.nearest_examples(F.col("embedding"), local, {"odd": "int"})
    return wide_table(spark, sf, "embeddings").select("vec_id", near.alias("n")).select(
        F.col("vec_id").alias("query_id"), dt.knn_votes(F.col("n"), "odd").alias("votes")
    )


def _examples():
    rows = ", ".join(
        f"('example_{i}', {quoted(text)}, {int(low is not None)}, {int(ai is not None)})"
        for i, (text, _, low, ai) in enumerate(fv.EXAMPLES)
    )
    return f"ex(id, text, low, ai) AS (VALUES {rows})"


def embedded(name, source, key):
    """Hashed character pairs of unit length, in single precision."""
    return f"""{name}_u AS (SELECT {key}, list_transform(string_split(text, ''), lambda c: unicode(c)) AS u FROM {source}),
{name}_c AS (SELECT {key}, h, count(*) AS n FROM (SELECT {key}, unnest(list_transform(range(1, len(u)), lambda i: (u[i] * 31 + u[i + 1]) % 64)) AS h FROM {name}_u) GROUP BY 1, 2),
{name}_n AS (SELECT {key}, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM {name}_c GROUP BY 1),
{name} AS (SELECT {key}, list(CAST(CAST(CASE WHEN size IS NULL THEN 0.0::DOUBLE ELSE coalesce(n, 0)::DOUBLE / size END AS FLOAT) AS DOUBLE) ORDER BY h) AS v
  FROM (SELECT {key}, unnest(range(0, 64)) AS h FROM {source}) LEFT JOIN {name}_c USING ({key}, h) LEFT JOIN {name}_n USING ({key}) GROUP BY 1)"""


def _result(task, score, cutoff, hit_list):
    positive = f"{score} > {cutoff}::DOUBLE"
    confidence = round2(f"(CASE WHEN {positive} THEN {score} ELSE 1.0::DOUBLE - {score} END)")
    reason = (
        f"CASE WHEN len({hit_list}) > 0 THEN '{fv.HIT_REASON[task]}' || array_to_string({hit_list}[1:2], ', ') ELSE '{fv.VOTE_REASON}' END"
    )
    return positive, confidence, reason


LOW_POS, LOW_CONF, LOW_WHY = _result(LOW, "low_score", 0.45, "low_hits")
AI_POS, AI_CONF, AI_WHY = _result(AI, "ai_score", 0.5, "ai_hits")
def scored_by(examples: str, source: str) -> str:
    """The scores of a source (doc_id, text) from examples ex(id, text, low, ai)."""
    return f"""{examples}, {embedded('dv', source, 'doc_id')}, {embedded('ev', 'ex', 'id')},
near AS ({nearest('dv', 'ev', 'doc_id', 'id')}),
votes AS (SELECT query_id AS doc_id, CAST(sum(low) AS DOUBLE) / 3.0::DOUBLE AS low_votes, CAST(sum(ai) AS DOUBLE) / 3.0::DOUBLE AS ai_votes,
  max(CASE WHEN neighbor_rank = 1 THEN substring(text, 1, 80) || '...' END) AS rag_example FROM near JOIN ex USING (id) GROUP BY 1),
hit AS (SELECT doc_id, text, {LOW_HITS} AS low_hits, {hits('text', AI_WORDS)} AS ai_hits FROM (SELECT *, {PLATFORM} AS platform FROM {source})),
score AS (SELECT *, low_votes * 0.6::DOUBLE + least(0.4::DOUBLE, len(low_hits)::DOUBLE * 0.15::DOUBLE) AS low_score,
  ai_votes * 0.6::DOUBLE + least(0.4::DOUBLE, len(ai_hits)::DOUBLE * 0.18::DOUBLE) AS ai_score FROM hit JOIN votes USING (doc_id)),
by_examples AS (SELECT doc_id, {LOW_POS} AS low, {AI_POS} AS ai, {LOW_CONF} AS low_conf, {AI_CONF} AS ai_conf,
  {LOW_WHY} AS low_why, {AI_WHY} AS ai_why, rag_example FROM score)"""


SCORED = scored_by(_examples(), "documents")
ANSWER = f"""SELECT doc_id, low AS is_low_quality, ai AS is_ai_generated, greatest(low_conf, ai_conf) AS confidence,
  CASE WHEN ai THEN 'ai_generated' WHEN low THEN 'low_quality' ELSE 'genuine' END AS label,
  CASE WHEN low AND ai THEN '{LOW}: ' || low_why || ' | {AI}: ' || ai_why WHEN low THEN '{LOW}: ' || low_why
    WHEN ai THEN '{AI}: ' || ai_why ELSE '{fv.NORMAL_REASON}' END AS reason, rag_example, detect_method"""


def requests(spark, sf):
    return wide_table(spark, sf, "documents").select(
        "doc_id", "text", F.expr(PLATFORM).alias("platform"), F.lit(None).cast("array<string>").alias("task_ids")
    )


def classified(spark, sf, **kw):
    return sc.classify(
        requests(spark, sf), keywords=WORDS, by_platform=PLATFORM_WORDS, ai_keywords=AI_WORDS, **kw
    ).drop("text", "platform", "task_ids")


@query("hybrid_score", f"WITH {SCORED} SELECT doc_id, low AS low_label, low_conf AS low_confidence, low_why AS low_reason, ai AS ai_label, ai_conf AS ai_confidence, ai_why AS ai_reason FROM by_examples")
def hybrid_score(spark, sf):
    part = lambda t, n: [an.task_entry(F.col("task_results"), t)[c].alias(f"{n}_{c}") for c in ("label", "confidence", "reason")]
    return classified(spark, sf).select("doc_id", *part(LOW, "low"), *part(AI, "ai"))


@query("example_snippet", f"WITH {SCORED} SELECT doc_id, rag_example FROM by_examples")
def example_snippet(spark, sf):
    return classified(spark, sf).select("doc_id", "rag_example")


# A stand-in for a model: sure about some prompts only, judged by their length.
def sure_by_length(prompts):
    return [
        '{"task_results": {"is_low_quality": {"label": %s, "confidence": %s, "reason": "m"}}}'
        % ("true" if len(p) % 3 == 0 else "false", ("0.95", "0.9", "0.89", '"?"')[len(p) % 4])
        for p in prompts
    ]


HEAD_CHARS = len(pr.scoring_prompt_head(fv.TASK_IDS)) + 1


@query("classify_cascade", f"""WITH {SCORED}, asked AS (SELECT doc_id, {HEAD_CHARS} + least(length(text), 1200) AS n FROM documents),
whole AS (
  SELECT b.doc_id, CASE WHEN n % 4 < 2 THEN n % 3 = 0 ELSE low END AS low, CASE WHEN n % 4 < 2 THEN false ELSE ai END AS ai,
    CASE n % 4 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE low_conf END AS low_conf, CASE WHEN n % 4 < 2 THEN 0.0::DOUBLE ELSE ai_conf END AS ai_conf,
    CASE WHEN n % 4 < 2 THEN 'm' ELSE low_why END AS low_why, ai_why, CASE WHEN n % 4 < 2 THEN NULL ELSE rag_example END AS rag_example,
    CASE WHEN n % 4 < 2 THEN '{fv.METHOD_MODEL}' ELSE '{fv.METHOD_EXAMPLES}' END AS detect_method
  FROM by_examples b JOIN asked USING (doc_id))
{ANSWER} FROM whole""")
def classify_cascade(spark, sf):
    return classified(spark, sf, predict_fn=sure_by_length).drop("task_results")


# ---- actions -----------------------------------------------------------------------------------------

POSTS = """posts AS (SELECT event_id AS post_id, CASE WHEN event_type IN ('view', 'click') THEN 'zhihu' WHEN event_type = 'error' THEN 'other' ELSE 'xiaohongshu' END AS platform FROM events)"""
DETECTIONS = """det AS (SELECT event_id AS post_id, unnest(['ai-content', 'low-quality']) AS detector_id, event_id % 3 > 0 AS should_filter, (event_id % 101) / 100.0::DOUBLE AS confidence FROM events)"""


def posts(spark, sf):
    kind = F.col("event_type")
    platform = F.when(kind.isin("view", "click"), "zhihu").when(kind == "error", "other").otherwise("xiaohongshu")
    return table(spark, sf, "events").select(F.col("event_id").alias("post_id"), platform.alias("platform"))


def detections(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select(
        n.alias("post_id"), F.explode(F.array(*[F.lit(d) for d in fv.RUNNABLE_DETECTORS])).alias("detector_id"),
        (n % 3 > 0).alias("should_filter"), ((n % 101) / F.lit(100.0)).alias("confidence"),
    )


@query("over_threshold", f"""WITH {DETECTIONS} SELECT * FROM det WHERE should_filter AND confidence >= CASE detector_id WHEN 'ai-content' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END""")
def over_threshold(spark, sf):
    return ac.over_threshold(detections(spark, sf), ac.default_settings(spark)["detectors"])


@query("decide_actions", f"""WITH {POSTS}, {DETECTIONS}, hit AS (
  SELECT * FROM posts JOIN det USING (post_id) WHERE should_filter AND (
    (platform = 'zhihu' AND detector_id = 'low-quality' AND confidence >= 0.6::DOUBLE) OR
    (platform = 'xiaohongshu' AND detector_id = 'ai-content' AND confidence >= 0.7::DOUBLE)))
SELECT post_id, platform, detector_id, confidence, 'blur' AS effect_id, 8.0::DOUBLE AS strength, NULL AS label_text, NULL AS confidence_text FROM hit
UNION ALL SELECT post_id, platform, detector_id, confidence, 'label', NULL,
  CASE detector_id WHEN 'ai-content' THEN '{fv.DETECTOR_LABELS['ai-content']}' ELSE '{fv.DETECTOR_LABELS['low-quality']}' END,
  '{fv.CONFIDENCE_LABEL}' || printf('%.1f%%', confidence * 100.0::DOUBLE) FROM hit""")
def decide_actions(spark, sf):
    return ac.decide_actions(posts(spark, sf), detections(spark, sf), ac.default_settings(spark))


@query("skip_scored", f"""WITH {POSTS}, done AS (SELECT event_id AS post_id, CASE WHEN value > 250 THEN 'ai-content' ELSE 'low-quality' END AS d FROM events)
SELECT post_id, platform FROM posts JOIN done USING (post_id) WHERE (platform = 'zhihu' AND d <> 'low-quality') OR (platform = 'xiaohongshu' AND d <> 'ai-content')""")
def skip_scored(spark, sf):
    done = table(spark, sf, "events").select(
        F.col("event_id").alias("post_id"), F.when(F.col("value") > 250, "ai-content").otherwise("low-quality").alias("detector_id")
    )
    return ac.skip_scored(posts(spark, sf), done, ac.default_settings(spark)["platforms"])


@query("merge_settings", """WITH d AS (SELECT user_id AS section, max(value) AS value FROM events GROUP BY 1),
s AS (SELECT user_id AS section, min(value) AS value FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT section, coalesce(s.value, d.value) AS value FROM d FULL JOIN s USING (section)""")
def merge_settings(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("section"), "event_type", "value")
    defaults = events.groupBy("section").agg(F.max("value").alias("value"))
    stored = events.filter("event_type = 'signup'").groupBy("section").agg(F.min("value").alias("value"))
    return ac.merge_settings(defaults, stored)


# ---- a base of more rows than travel with a job ------------------------------------------------------

LARGE = """large AS (SELECT 'd' || doc_id AS place, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
ex AS (SELECT 'example_' || place AS id, text, CAST(length(text) % 3 = 0 AS INT) AS low, CAST(length(text) % 3 = 1 AS INT) AS ai FROM large)"""
TITLES = "titles AS (SELECT page_id AS doc_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS text FROM pages)"


def large_base(spark, sf):
    """All documents and turns as labeled examples; their label follows their length."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("place"), "text")
    turns = table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("place"), "text")
    kind = F.length("text") % 3
    label = F.when(kind == 0, "low_quality").when(kind == 1, "ai_generated").otherwise("genuine")
    return docs.unionByName(turns).select(
        "text", F.lit(None).cast("string").alias("category"), label.alias("label"),
        F.lit(None).cast("map<string,struct<label:boolean,reason:string>>").alias("task_annotations"), "place",
    )


def titles(spark, sf):
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), title.alias("text"))


@query("classify_large_base", f"WITH {TITLES}, {LARGE}, {scored_by('', 'titles').removeprefix(', ')}, whole AS (SELECT *, '{fv.METHOD_EXAMPLES}' AS detect_method FROM by_examples) {ANSWER} FROM whole")
def classify_large_base(spark, sf):
    """Titles scored from a base that is searched by cells."""
    asked = titles(spark, sf).select("*", F.expr(PLATFORM).alias("platform"), F.lit(None).cast("array<string>").alias("task_ids"))
    return sc.classify(
        asked, large_base(spark, sf), "place", keywords=WORDS, by_platform=PLATFORM_WORDS, ai_keywords=AI_WORDS, id_col="doc_id"
    ).drop("text", "platform", "task_ids", "task_results")


@query("knn_lists_recall", f"WITH {TITLES} SELECT count(*) AS queries, count(*) * 3 AS pairs, true AS recall_reached FROM titles")
def knn_lists_recall(spark, sf):
    """Whether the search by lists and codes meets at least nine tenths of the exact neighbors of all titles."""
    base = large_base(spark, sf).select(F.col("place").alias("id"), embed_text(F.col("text")).alias("embedding"))
    asked = titles(spark, sf).select(F.col("doc_id").alias("query_id"), embed_text(F.col("text")).alias("embedding"))
    # Both are read many times, by two searches.
    base, asked = materialize(base, "recall-base"), materialize(asked, "recall-asked")
    found = ann.recall_of(ann.knn_join_lists(asked, base), knn.knn_join_cells(asked, base))
    return found.select("queries", "pairs", (F.col("recall") >= 0.9).alias("recall_reached"))
