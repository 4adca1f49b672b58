"""Split, rebalancing and tuning-row queries."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import ordering as od, training as tr
from ..sources.tables import gold_annotations, table
from .annotations import model_annotations
from .registry import GOLD, key60, query, quoted

LOW, AI = fv.LOW_QUALITY, fv.AI_GENERATED
LOW_TEXT = next(t["description"] for t in fv.TASKS if t["task_id"] == LOW)


def labeled(spark, sf, task=LOW, check=True):
    rows = gold_annotations(table(spark, sf, "labels")).join(
        table(spark, sf, "documents").select("doc_id", "text"), "doc_id"
    )
    return tr.task_dataset(rows, task, "task_annotations", "text", check)


def labels_only(spark, sf, task=LOW):
    rows = gold_annotations(table(spark, sf, "labels"))
    return tr.task_dataset(rows.withColumn("text", F.col("sample_id")), task, "task_annotations", "text")


@query("task_dataset", f"""WITH {GOLD} SELECT doc_id, text, low AS task_label, low_reason AS task_reason FROM gold JOIN documents USING (doc_id)""")
def task_dataset(spark, sf):
    return labeled(spark, sf).select("doc_id", "text", "task_label", "task_reason")


@query("resolve_fields", """SELECT 'predicted_task_annotations' AS annotation_field, 'content' AS text_field, count(*) AS rows
FROM documents WHERE n_chars % 5 <> 0""")
def resolve_fields(spark, sf):
    docs = model_annotations(spark, sf).join(
        table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), "doc_id"
    )
    both = docs.join(gold_annotations(table(spark, sf, "labels")).select("doc_id", "task_annotations"), "doc_id", "left")
    field, text = tr.resolve_annotation_field(both, LOW), tr.resolve_text_field(both)
    return tr.labeled_for_task(both, LOW, field).groupBy(
        F.lit(field).alias("annotation_field"), F.lit(text).alias("text_field")
    ).agg(F.count(F.lit(1)).alias("rows"))


def held_out(source, ratio, name):
    """Held-out rows per class: total rounded up, kept rows shared by largest remainder (two classes)."""
    return f"""{name}_n AS (SELECT task_label, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY 1),
{name}_e AS (SELECT *, total - ceil(total * {ratio}) AS keep, n * (total - ceil(total * {ratio}))::DOUBLE / total AS exact FROM {name}_n),
{name}_f AS (SELECT *, floor(exact) AS low, row_number() OVER (ORDER BY floor(exact) - exact, task_label) AS r, keep - sum(floor(exact)) OVER () AS spare FROM {name}_e),
{name} AS (SELECT task_label, n - (low + CASE WHEN r <= spare THEN 1 ELSE 0 END) AS held FROM {name}_f)"""


H = key60("'42|' || doc_id")
SPLIT = f"""{GOLD}, base AS (SELECT doc_id, low AS task_label, {H} AS h FROM gold),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_label ORDER BY h, doc_id) AS rank FROM base),
{held_out('ranked', '0.1::DOUBLE', 'tested')},
rest AS (SELECT ranked.*, held FROM ranked JOIN tested USING (task_label) WHERE rank > held),
{held_out('rest', '(0.1::DOUBLE / (1 - 0.1::DOUBLE))', 'validated')},
split AS (SELECT doc_id, r.task_label, CASE WHEN rank <= t.held THEN 'test' WHEN rank <= t.held + v.held THEN 'val' ELSE 'train' END AS split
  FROM ranked r JOIN tested t ON r.task_label = t.task_label JOIN validated v ON r.task_label = v.task_label)"""


@query("stratified_split", f"WITH {SPLIT} SELECT * FROM split")
def stratified_split(spark, sf):
    return tr.stratified_split(labels_only(spark, sf), "doc_id").select("doc_id", "task_label", "split")


@query("train_test_split", f"""WITH {GOLD}, base AS (SELECT doc_id, ai AS task_label, {H} AS h FROM gold),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_label ORDER BY h, doc_id) AS rank FROM base), {held_out('ranked', '0.2::DOUBLE', 'tested')}
SELECT doc_id, r.task_label, CASE WHEN rank <= held THEN 'test' ELSE 'train' END AS split FROM ranked r JOIN tested t ON r.task_label = t.task_label""")
def train_test_split(spark, sf):
    return tr.train_test_split(labels_only(spark, sf, AI), "doc_id", 0.2).select("doc_id", "task_label", "split")


@query("approximate_split", f"""SELECT doc_id, CASE WHEN s < 0.1::DOUBLE THEN 'test' WHEN s < 0.2::DOUBLE THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, {H}::DOUBLE / 1152921504606846976.0::DOUBLE AS s FROM labels)""")
def approximate_split(spark, sf):
    return tr.approximate_split(table(spark, sf, "labels"), "doc_id").select("doc_id", "split")


DRAWN = f"""pos AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS i FROM {{source}} WHERE task_label),
size AS (SELECT count(*) FILTER (WHERE task_label) AS p, count(*) FILTER (WHERE NOT task_label) AS n FROM {{source}}),
draws AS (SELECT d, {key60("'42|' || d")} % p AS i FROM (SELECT p, unnest(range(0, CASE WHEN n::DOUBLE / p > 3 THEN CAST(ceil(n / 3.0::DOUBLE) AS BIGINT) - p ELSE 0 END)) AS d FROM size))"""


@query("rebalance", f"""WITH {GOLD}, base AS (SELECT doc_id, low AS task_label, {H} AS h FROM gold), {DRAWN.format(source='base')}
SELECT doc_id, task_label, 0 AS copy_no FROM base UNION ALL SELECT doc_id, true, d + 1 FROM draws JOIN pos USING (i)""")
def rebalance(spark, sf):
    rows, _ = tr.rebalance(labels_only(spark, sf), "doc_id", shuffle=False)
    return rows.select("doc_id", "task_label", "copy_no")


@query("shuffle", "SELECT doc_id, row_number() OVER (ORDER BY " + H + ", doc_id) - 1 AS position FROM labels")
def shuffle(spark, sf):
    """The place of every row in seeded order."""
    labels = table(spark, sf, "labels").select("doc_id")
    return od.with_row_index(labels, [od.hash_key(42, F.col("doc_id")), F.col("doc_id")], "position")


@query("shuffled_rows", "SELECT doc_id, quality, toxic FROM labels")
def shuffled_rows(spark, sf):
    return od.shuffle_rows(table(spark, sf, "labels"), 42, "doc_id")


@query("load_presplit", f"""WITH {SPLIT}, tr AS (SELECT doc_id, task_label, {H} AS h FROM split WHERE split = 'train'), {DRAWN.format(source='tr')}
SELECT doc_id, task_label, 0 AS copy_no, 'train' AS split FROM tr UNION ALL SELECT doc_id, true, d + 1, 'train' FROM draws JOIN pos USING (i)
UNION ALL SELECT doc_id, task_label, 0, 'test' FROM split WHERE split = 'val'""")
def load_presplit(spark, sf):
    parts = tr.stratified_split(labels_only(spark, sf), "doc_id").drop("task_annotation", "task_label", "task_reason")
    rows = tr.load_presplit(
        parts.filter("split = 'train'"), parts.filter("split = 'val'"), LOW, "doc_id", "task_annotations", "text"
    )
    return rows.select("doc_id", "task_label", "copy_no", "split")


@query("sft_rows", f"""WITH {GOLD} SELECT doc_id, {quoted(fv.TUNING_PROMPT_HEAD.format(task_id=LOW, description=LOW_TEXT))} || substring(text, 1, 500)
  || {quoted(fv.PROMPT_TAIL)} AS prompt_text, CASE WHEN low THEN '{{"label": true}}' ELSE '{{"label": false}}' END || '</s>' AS answer_text
FROM gold JOIN documents USING (doc_id)""")
def sft_rows(spark, sf):
    return tr.format_sft(labeled(spark, sf, check=False), LOW, "</s>").select("doc_id", "prompt_text", "answer_text")


CODES = "list_transform(string_split({x}, ''), lambda c: unicode(c))"


@query("pack_tokens", f"""WITH {GOLD}, ids AS (
  SELECT doc_id, {CODES.format(x="'T' || substring(text, 1, 500)")} AS p, {CODES.format(x="CASE WHEN low THEN 'yes' ELSE 'no' END")} AS a
  FROM gold JOIN documents USING (doc_id)),
cut AS (SELECT doc_id, p[1:256 - len(a)] AS p, a, 256 - len(p[1:256 - len(a)]) - len(a) AS rest FROM ids)
SELECT doc_id, array_to_string(list_concat(p, a, list_transform(range(0, rest), lambda i: 0)), ',') AS input_ids,
  array_to_string(list_concat(list_transform(range(0, len(p) + len(a)), lambda i: 1), list_transform(range(0, rest), lambda i: 0)), ',') AS attention_mask,
  array_to_string(list_concat(list_transform(p, lambda i: -100), a, list_transform(range(0, rest), lambda i: -100)), ',') AS labels FROM cut""")
def pack_tokens(spark, sf):
    """Characters stand in for the tokens of a caller's tokenizer."""
    codes = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    rows = labeled(spark, sf, check=False).select(
        "doc_id", codes(F.concat(F.lit("T"), F.substring("text", 1, 500))).alias("p"),
        codes(F.when(F.col("task_label"), "yes").otherwise("no")).alias("a"),
    )
    packed = rows.select("doc_id", tr.pack_tokens(F.col("p"), F.col("a"), 256, 0).alias("t"))
    text = lambda c: F.array_join(F.col(f"t.{c}").cast("array<string>"), ",").alias(c)
    return packed.select("doc_id", text("input_ids"), text("attention_mask"), text("labels"))




@query("class_checks", """SELECT lang, source, count(*) FILTER (WHERE quality = 0) AS positive, count(*) FILTER (WHERE quality <> 0) AS negative,
  count(*) FILTER (WHERE quality = 0) > 0 AND count(*) FILTER (WHERE quality <> 0) > 0 AS both_classes
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def class_checks(spark, sf):
    """Which languages and sources have both classes."""
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("task_label"))
    return tr.class_checks(table(spark, sf, "documents").join(labels, "doc_id"), ["lang", "source"])


@query("split_ratio_error", """WITH r AS (SELECT event_id, (event_id % 13 - 1) / 10.0::DOUBLE AS val, (event_id % 7) / 10.0::DOUBLE AS test, (event_id % 11) / 10.0::DOUBLE AS train FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 AND abs(train + val + test - 1.0::DOUBLE) > 1e-8 THEN 'the ratios must add up to 1'
  WHEN NOT (val > 0 AND val < 1) THEN 'val must lie between 0 and 1' WHEN NOT (test > 0 AND test < 1) THEN 'test must lie between 0 and 1'
  WHEN val + test >= 1 THEN 'val + test must be below 1' END AS error FROM r""")
def split_ratio_error(spark, sf):
    n = F.col("event_id")
    val, test = (n % 13 - 1) / F.lit(10.0), (n % 7) / F.lit(10.0)
    train = F.when(n % 2 == 0, (n % 11) / F.lit(10.0))
    return table(spark, sf, "events").select("event_id", tr.split_ratio_error(val, test, train).alias("error"))
