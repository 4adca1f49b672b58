"""Prompt, reply and cost queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import annotations as an, prompts as pr, replies as rp
from ..operators import labeling as lb
from ..session import scratch_path
from ..sources.jsonl import annotator_suffix
from ..sources.tables import table, wide_table
from .registry import SQL, query, quoted, round2

LOW, AI = fv.LOW_QUALITY, fv.AI_GENERATED


def text(x):
    return quoted(x)


@query("build_label_prompt", f"SELECT doc_id, {text(pr.label_prompt_head())} || substring(text, 1, 1200) || chr(10) AS prompt FROM documents")
def build_label_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pr.build_label_prompt(F.col("text")).alias("prompt"))


@query("build_service_prompt", f"""SELECT doc_id, CASE n_chars % 4 WHEN 1 THEN {text(pr.scoring_prompt_head([LOW]))}
  WHEN 2 THEN {text(pr.scoring_prompt_head([AI]))} WHEN 3 THEN {text(pr.scoring_prompt_head([AI, LOW]))}
  ELSE {text(pr.scoring_prompt_head([LOW, AI]))} END || substring(text, 1, 1200) || chr(10) AS prompt FROM documents""")
def build_service_prompt(spark, sf):
    n = F.col("n_chars") % 4
    low, ai = F.lit(LOW), F.lit(AI)
    asked = F.when(n == 1, F.array(low)).when(n == 2, F.array(ai)).when(n == 3, F.array(ai, low))
    return table(spark, sf, "documents").select("doc_id", pr.build_service_prompt(F.col("text"), asked).alias("prompt"))


@query("build_inference_prompt", f"""SELECT doc_id, {text(fv.SINGLE_PROMPT_HEAD.format(task_id=AI))} || substring(text, 1, 1200)
  || {text(fv.PROMPT_TAIL)} AS prompt FROM documents""")
def build_inference_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pr.build_inference_prompt(F.col("text"), AI).alias("prompt"))


TUNING_HEAD = fv.TUNING_PROMPT_HEAD.format(task_id=LOW, description=fv.TASKS[0]["description"])


@query("build_sft_prompt", f"""SELECT doc_id, {text(TUNING_HEAD)} || substring(text, 1, 500) || {text(fv.PROMPT_TAIL)} AS prompt FROM documents""")
def build_sft_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pr.build_sft_prompt(F.col("text"), LOW).alias("prompt"))


# Replies derived from every event; the expressions below are read by both engines.
NUMBER = "'0.' || lpad(CAST(event_id % 1000 AS STRING), 3, '0')"
REPLY = f"""CASE event_type
  WHEN 'error' THEN 'Sure: {{"task_results": {{}}}} }}'
  WHEN 'signup' THEN '{{"task_results": {{"{LOW}": {{"label": "true", "confidence": ' || {NUMBER} || ', "reason": "r1"}}}}}}'
  WHEN 'purchase' THEN 'x {{"task_results": {{"{LOW}": {{"label": false, "confidence": "' || {NUMBER} || '"}}, "{AI}": {{"label": true, "confidence": 0.9, "reason": "r2"}}}}}} y'
  WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'no object here' ELSE '{{"task_results": {{"{LOW}": [1]}}}}' END
  ELSE '{{"task_results": {{"{LOW}": {{"label": true, "confidence": ' || {NUMBER} || ', "reason": "r3"}}, "{AI}": {{"label": null, "confidence": null}}}}}}' END"""
PARSED = f"""parsed AS (SELECT event_id, event_type, event_type IN ('signup', 'purchase', 'click') AS good,
  CASE event_type WHEN 'purchase' THEN false WHEN 'click' THEN true END AS low,
  CASE event_type WHEN 'purchase' THEN true END AS ai, CAST({NUMBER} AS DOUBLE) AS n,
  CASE event_type WHEN 'signup' THEN 'r1' WHEN 'click' THEN 'r3' ELSE '' END AS low_reason,
  CASE event_type WHEN 'purchase' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS ai_confidence FROM events)"""


def replies(spark, sf):
    return wide_table(spark, sf, "events").select("event_id", "event_type", F.expr(REPLY).alias("reply"))


@query("parse_task_results", f"""WITH {PARSED}
SELECT event_id, CASE WHEN good THEN low END AS low_label, CASE WHEN good THEN {round2('n')} END AS low_confidence,
  CASE WHEN good THEN low_reason END AS low_reason, CASE WHEN good THEN ai END AS ai_label,
  CASE WHEN good THEN ai_confidence END AS ai_confidence, CASE WHEN good THEN 'm' END AS annotator,
  CASE WHEN NOT good THEN '{fv.NO_JSON_REASON}' END AS error FROM parsed""")
def parse_task_results(spark, sf):
    p = replies(spark, sf).withColumn("p", rp.parse_task_results(F.col("reply"), F.lit("m")))
    low, ai = (an.task_entry(F.col("p.annotations"), t) for t in fv.TASK_IDS)
    return p.select(
        "event_id", low["label"].alias("low_label"), low["confidence"].alias("low_confidence"),
        low["reason"].alias("low_reason"), ai["label"].alias("ai_label"), ai["confidence"].alias("ai_confidence"),
        low["annotator"].alias("annotator"), "p.error",
    )


@query("parse_service_results", f"""WITH {PARSED}
SELECT event_id, event_type IN ('signup', 'purchase') AS usable,
  CASE WHEN event_type IN ('signup', 'purchase') THEN low END AS low_label,
  CASE WHEN event_type IN ('signup', 'purchase') THEN {round2('n')} END AS low_confidence,
  CASE WHEN event_type IN ('signup', 'purchase') THEN ai_confidence END AS ai_confidence FROM parsed""")
def parse_service_results(spark, sf):
    p = replies(spark, sf).withColumn("p", rp.parse_service_results(F.col("reply")))
    low, ai = (an.task_entry(F.col("p"), t) for t in fv.TASK_IDS)
    return p.select(
        "event_id", F.col("p").isNotNull().alias("usable"), low["label"].alias("low_label"),
        low["confidence"].alias("low_confidence"), ai["confidence"].alias("ai_confidence"),
    )


SINGLE = f"""CASE event_type WHEN 'error' THEN 'none' WHEN 'view' THEN '{{"label": "true"'
  WHEN 'signup' THEN 'a {{"label": true, "confidence": ' || {NUMBER} || ', "evidence": "e"}} b'
  WHEN 'click' THEN '{{"label": 3, "confidence": "high", "reason": "r"}}' ELSE '{{"label": false}}' END"""


@query("parse_single_label", f"""SELECT event_id, CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN false END AS label,
  CASE WHEN event_type IN ('error', 'view') THEN '解析失败' WHEN event_type = 'click' THEN 'r' ELSE '' END AS reason,
  CASE WHEN event_type = 'signup' THEN 'e' ELSE '' END AS evidence,
  CASE WHEN event_type = 'signup' THEN CAST({NUMBER} AS DOUBLE) ELSE 0.0::DOUBLE END AS confidence, '{AI}' AS task_id FROM events""")
def parse_single_label(spark, sf):
    events = wide_table(spark, sf, "events").select("event_id", F.expr(SINGLE).alias("reply"))
    return events.select("event_id", rp.parse_single_label(F.col("reply"), AI).alias("p")).select("event_id", "p.*")


BODY = """CASE event_id % 4
  WHEN 0 THEN '{"message": {"content": "  hello ' || event_type || ' \\n"}}'
  WHEN 1 THEN '{"choices": [{"message": {"content": "one two"}}], "usage": {"prompt_tokens": ' || CAST(event_id AS STRING) || ', "completion_tokens": 7}}'
  WHEN 2 THEN '{"output": {"choices": [{"message": {"content": "' || event_type || '"}}]}, "usage": {"input_tokens": 5}}'
  ELSE '{"choices": [{"message": {"content": "a b c"}}]}' END"""
PROVIDER = "CASE event_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'openai' WHEN 2 THEN 'qwen' ELSE 'doubao' END"


@query("unwrap_response", f"""SELECT event_id, {PROVIDER} AS provider,
  CASE event_id % 4 WHEN 0 THEN 'hello ' || event_type WHEN 1 THEN 'one two' WHEN 2 THEN event_type ELSE 'a b c' END AS content,
  CASE event_id % 4 WHEN 1 THEN event_id WHEN 2 THEN 5 ELSE 2 END AS prompt_tokens,
  CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 1 ELSE 3 END AS completion_tokens FROM events""")
def unwrap_response(spark, sf):
    events = wide_table(spark, sf, "events").withColumns(
        {"body": F.expr(BODY.replace("\\n", "\\\\n")), "provider": F.expr(PROVIDER)}
    )
    parts = rp.unwrap_response(F.col("body"), F.col("provider"), F.lit("two words"))
    return events.select("event_id", "provider", parts.alias("p")).select("event_id", "provider", "p.*")


@query("estimate_tokens", r"""SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) +
  len(regexp_extract_all(text, '[^\t\n\x0b\f\r 一-鿿]+')) AS tokens FROM documents""")
def estimate_tokens(spark, sf):
    return wide_table(spark, sf, "documents").select("doc_id", rp.estimate_tokens(F.col("text")).alias("tokens"))


# A stand-in for a model: its reply follows from the length of the prompt.
def reply_by_length(prompts):
    out = []
    for p in prompts:
        n = len(p)
        if n % 11 == 0:
            raise ValueError("no answer today, sorry: this row is lost")
        label = "null" if n % 5 == 0 else "true" if n % 3 == 0 else "false"
        out.append(
            '{"task_results": {"is_low_quality": {"label": %s, "confidence": 0.%d, "reason": "r"}}}' % (label, n % 10)
        )
    return out


HEAD_CHARS = len(pr.label_prompt_head()) + 1
LABELED = f"""asked AS (SELECT doc_id, source, text, {HEAD_CHARS} + least(length(text), 1200) AS n FROM documents),
labeled AS (SELECT doc_id, source, n, n % 11 = 0 AS failed, CASE WHEN n % 11 = 0 OR n % 5 = 0 THEN NULL ELSE n % 3 = 0 END AS low,
  CASE WHEN n % 11 = 0 THEN '预标失败: no answer today, sorry: this r' ELSE 'r' END AS reason,
  CASE WHEN n % 11 = 0 THEN 'system' ELSE 'qwen3:8b' END AS annotator,
  CASE WHEN n % 11 = 0 THEN 0.0::DOUBLE ELSE (n % 10) / 10.0::DOUBLE END AS confidence FROM asked)"""


def labeled(spark, sf):
    docs = wide_table(spark, sf, "documents").select("doc_id", "source", "text")
    return lb.label_with_model(docs, pr.build_label_prompt(F.col("text")), reply_by_length, "qwen3:8b")


@query("label_with_model", f"WITH {LABELED} SELECT doc_id, failed, low AS label, reason, annotator, confidence FROM labeled")
def label_with_model(spark, sf):
    return labeled(spark, sf).select(
        "doc_id", "failed", *[an.task_entry(F.col("predicted"), LOW)[c].alias(c) for c in ("label", "reason", "annotator", "confidence")]
    )


@query("label_with_store", SQL["label_with_model"])
def label_with_store(spark, sf):
    """The same from a reply store: each distinct prompt is asked once, though the labels are made twice."""
    docs = wide_table(spark, sf, "documents").select("doc_id", "text")
    store = scratch_path(spark, "replies")
    for _ in range(2):
        rows = lb.label_with_model(docs, pr.build_label_prompt(F.col("text")), reply_by_length, "qwen3:8b", store=store)
    return rows.select(
        "doc_id", "failed", *[an.task_entry(F.col("predicted"), LOW)[c].alias(c) for c in ("label", "reason", "annotator", "confidence")]
    )


@query("run_summary", f"""WITH {LABELED} SELECT count(*) AS rows, count(*) FILTER (WHERE failed) AS failures, count(*) AS need_review FROM labeled""")
def run_summary(spark, sf):
    rows = lb.attach_auto_labels(labeled(spark, sf), "predicted", "hybrid", "local", "qwen3:8b", "")
    return lb.run_summary(rows).select("rows", "failures", "need_review")


@query("label_cost", """SELECT CASE doc_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'openai' WHEN 2 THEN 'qwen' ELSE 'doubao' END AS provider,
  CAST(sum(n_chars + length(source)) AS BIGINT) AS tokens,
  CAST(round(CAST(sum(n_chars + length(source)) AS DECIMAL(20, 0)) * CAST(any_value(CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.01 WHEN 2 THEN 0.001 ELSE 0.0008 END) AS DECIMAL(10, 7)) * CAST(0.001 AS DECIMAL(4, 3)), 4) AS DOUBLE) AS cost
FROM documents GROUP BY 1""")
def label_cost(spark, sf):
    used = table(spark, sf, "documents").select(
        F.expr(PROVIDER.replace("event_id", "doc_id")).alias("provider"),
        F.col("n_chars").alias("prompt_tokens"), F.length("source").alias("completion_tokens"),
    )
    return lb.label_cost(used)


@query("annotator_suffix", """SELECT event_id, 'local-' || CASE WHEN s = '' THEN 'unknown' ELSE s END AS suffix FROM (
  SELECT event_id, regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS s
  FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN ' :: ' ELSE event_type || ': ' || props || '--x_' END AS name FROM events))""")
def annotator_suffix_query(spark, sf):
    name = F.when(F.col("event_type") == "error", " :: ").otherwise(
        F.concat("event_type", F.lit(": "), "props", F.lit("--x_"))
    )
    return table(spark, sf, "events").select("event_id", annotator_suffix(F.lit("local"), name).alias("suffix"))
