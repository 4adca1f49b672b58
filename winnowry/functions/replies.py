"""Model replies: unwrapping, JSON results, token counts."""

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .annotations import annotation, result, task_map
from .numeric import round2


def estimate_tokens(c: Column) -> Column:
    """Native estimate: CJK characters plus runs of other visible characters."""
    cjk = F.length(c) - F.length(F.regexp_replace(c, r"[一-鿿]", ""))
    return F.coalesce(cjk + F.regexp_count(c, F.lit(r"[^\s一-鿿]+")), F.lit(0))


def token_counter(encode):
    """Exact counts with a tokenizer of the caller's: ``encode(text) -> token ids``."""

    @F.pandas_udf("int")
    def count(s):
        return s.map(lambda t: len(encode(t)), na_action="ignore")

    return count


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def unwrap_response(body: Column, provider: Column, prompt: Column, tokens=estimate_tokens) -> Column:
    """Reply text and token counts from a provider's response body."""
    v = F.try_parse_json(body)
    content, sent, received = (F.lit(None).cast(t) for t in ("string", "bigint", "bigint"))
    for name, (content_path, sent_path, received_path) in fv.REPLY_PATHS.items():
        mine = provider == name
        content = F.when(mine, F.try_variant_get(v, content_path, "string")).otherwise(content)
        if sent_path:
            sent = F.when(mine, F.try_variant_get(v, sent_path, "bigint")).otherwise(sent)
            received = F.when(mine, F.try_variant_get(v, received_path, "bigint")).otherwise(received)
    content = F.regexp_replace(
        content, rf"\A[{fv.TEXT_SPACE}]+|[{fv.TEXT_SPACE}]+\z", ""
    )
    return F.struct(
        content.alias("content"),
        F.coalesce(sent, tokens(prompt).cast("bigint")).alias("prompt_tokens"),
        F.coalesce(received, tokens(content).cast("bigint")).alias("completion_tokens"),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reply_json(content: Column) -> Column:
    """From the first opening to the last closing brace, as a variant; null if that is not one JSON value.

    The text is parsed as the only entry of an array, since the parser ignores what follows a whole value.
    """
    body = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    listed = F.try_parse_json(F.when(body != "", F.concat(F.lit("["), body, F.lit("]"))))
    return let(
        listed, lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))
    )


def _entries(v: Column, task_ids) -> Column:
    """The results' type and every task's entry."""
    return F.struct(
        F.schema_of_variant(F.try_variant_get(v, "$.task_results", "variant")).alias("kind"),
        *[F.try_variant_get(v, f"$.task_results['{t}']", "variant").alias(t) for t in task_ids],
    )


def _well_formed(v: Column, found: Column, task_ids) -> Column:
    """The reply parsed, and neither the results nor any task's entry is something other than an object."""
    good = v.isNotNull() & F.coalesce(found["kind"].startswith("OBJECT"), F.lit(True))
    for t in task_ids:
        good = good & F.coalesce(_kind(found[t]).startswith("OBJECT"), F.lit(True))
    return good


def _label(entry: Column) -> Column:
    v = F.try_variant_get(entry, "$.label", "variant")
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(entry, "$.label", "boolean"))


def _number(entry: Column, path: str = "$.confidence") -> Column:
    return F.try_variant_get(entry, path, "double")


def parse_task_results(content: Column, annotator: Column, task_ids=None) -> Column:
    """Annotations of every task, or null with an error text if the reply as a whole is unusable."""
    task_ids = fv.TASK_IDS if task_ids is None else task_ids

    def one(e):
        return annotation(
            _label(e),
            F.coalesce(F.try_variant_get(e, "$.reason", "string"), F.lit("")),
            annotator,
            F.lit("auto"),
            F.coalesce(let(_number(e), round2), F.lit(0.0)),
        )

    def results(v):
        return let(
            _entries(v, task_ids),
            lambda found: F.when(_well_formed(v, found, task_ids), task_map(lambda t: one(found[t]), task_ids)),
        )

    return let(
        let(reply_json(content), results),
        lambda m: F.struct(m.alias("annotations"), F.when(m.isNull(), F.lit(fv.NO_JSON_REASON)).alias("error")),
    )


def parse_service_results(content: Column, task_ids=None) -> Column:
    """Task results; null if the reply, a confidence or a reason cannot be used, so that scoring goes on."""
    task_ids = fv.TASK_IDS if task_ids is None else task_ids

    def label(e):
        raw = F.try_variant_get(e, "$.label", "variant")
        number = F.when(_kind(raw).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(e, "$.label", "double"))
        return F.coalesce(_label(e), F.when(number == 1.0, True).when(number == 0.0, False))

    def usable(e):
        confidence = F.try_variant_get(e, "$.confidence", "variant")
        reason = F.try_variant_get(e, "$.reason", "variant")
        return (confidence.isNull() | _number(e).isNotNull()) & (reason.isNull() | (_kind(reason) == "STRING"))

    def one(e):
        return result(label(e), let(_number(e), round2), F.try_variant_get(e, "$.reason", "string"))

    def results(v):
        def of(found):
            good = _well_formed(v, found, task_ids)
            for t in task_ids:
                good = good & usable(found[t])
            return F.when(good, task_map(lambda t: one(found[t]), task_ids))

        return let(_entries(v, task_ids), of)

    return let(reply_json(content), results)


def parse_single_label(content: Column, task_id: str) -> Column:
    """One task's reply; an unusable one has no label, a fixed reason and no confidence."""

    def parsed(v):
        good = F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))
        text = lambda path, default: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(default))
        return F.struct(
            text("$.task_id", task_id).alias("task_id"),
            _label(v).alias("label"),
            F.when(good, text("$.reason", "")).otherwise(F.lit(fv.UNPARSED_REASON)).alias("reason"),
            text("$.evidence", "").alias("evidence"),
            F.coalesce(_number(v), F.lit(0.0)).alias("confidence"),
        )

    return let(reply_json(content), parsed)
