"""Model-assisted labeling."""

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.annotations import failed_annotations, should_review
from ..functions.replies import estimate_tokens, parse_task_results

REPLY = "struct<reply:string,error:string>"


def model_replies(prompt: Column, predict_fn) -> Column:
    """Replies of ``predict_fn(prompts: pandas.Series) -> sequence of str``, in Arrow batches.

    The model counts as nondeterministic, so a plan asks it once per row. A batch that fails is halved until
    the bad rows are alone, so an error stays with its own row at the cost of a few more calls. A wrong number
    of replies ends the job. Rows with a null prompt never reach the model.
    """

    @F.pandas_udf(REPLY)
    def call(prompts: pd.Series) -> pd.DataFrame:
        replies = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        errors = replies.copy()
        asked = prompts[prompts.notna()]
        open_ = [asked] if len(asked) else []
        while open_:
            part = open_.pop()
            try:
                found = list(predict_fn(part))
            except Exception as e:
                if len(part) == 1:
                    errors[part.index[0]] = str(e)
                else:
                    open_ += [part.iloc[: len(part) // 2], part.iloc[len(part) // 2 :]]
                continue
            if len(found) != len(part):
                raise ValueError(f"{len(part)} prompts got {len(found)} replies")
            replies[part.index] = found
        return pd.DataFrame({"reply": replies, "error": errors})

    return call.asNondeterministic()(prompt)


def label_with_model(
    df: DataFrame, prompt: Column, predict_fn, annotator: str, tokens=estimate_tokens, store: str | None = None
) -> DataFrame:
    """Adds ``predicted``, ``failed`` and the token counts. A failed row gets the failure annotations.

    With a ``store`` the replies are kept there under ``annotator``: the model is asked at once, and once for each
    distinct prompt that it was not asked before. Without one, every action asks it again.
    """
    asked = df.withColumn("_prompt", prompt)
    if store is None:
        answered = asked.withColumn("_r", model_replies(F.col("_prompt"), predict_fn))
    else:
        from .reply_store import with_stored_replies

        answered = with_stored_replies(asked, F.col("_prompt"), predict_fn, annotator, store, "_r")
    parsed = answered.withColumn("_p", parse_task_results(F.col("_r.reply"), F.lit(annotator)))
    error = F.coalesce(F.col("_r.error"), F.col("_p.error"))
    count = lambda c: F.when(error.isNull(), tokens(c)).otherwise(0).cast("bigint")
    return parsed.withColumns(
        {
            "failed": error.isNotNull(),
            "predicted": F.when(error.isNull(), F.col("_p.annotations")).otherwise(failed_annotations(error)),
            "prompt_tokens": count(F.col("_prompt")),
            "completion_tokens": count(F.col("_r.reply")),
        }
    ).drop("_prompt", "_r", "_p")


def annotator_name(provider: str, model: str) -> str:
    return model if provider == fv.LOCAL_PROVIDER else provider


def attach_auto_labels(
    df: DataFrame, predicted: str, output_format: str, provider: str, model: str, generated_at: str,
    threshold: float = fv.REVIEW_THRESHOLD,
) -> DataFrame:
    """review: predictions only; train: task annotations only; hybrid: both."""
    if output_format not in ("review", "train", "hybrid"):
        raise ValueError(f"unknown output format: {output_format}")
    columns = {}
    if output_format in ("review", "hybrid"):
        columns["predicted_task_annotations"] = F.col(predicted)
    if output_format in ("train", "hybrid"):
        columns["task_annotations"] = F.col(predicted)
    columns["need_review"] = should_review(F.col(predicted), threshold)
    columns["auto_label_meta"] = F.struct(
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.lit(output_format).alias("output_format"),
        F.lit(threshold).alias("review_threshold"),
        F.lit(generated_at).alias("generated_at"),
    )
    out = df.withColumns(columns)
    return out if predicted in columns else out.drop(predicted)


def label_stats(df: DataFrame, field: str) -> DataFrame:
    """Positive, negative and unknown labels per task."""
    label = F.col("annotation.label")
    return (
        df.select(F.explode(field).alias("task_id", "annotation"))
        .groupBy("task_id")
        .agg(
            F.count_if(label).alias("positive"),
            F.count_if(~label).alias("negative"),
            F.count_if(label.isNull()).alias("unknown"),
        )
    )


def run_summary(df: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("failed").alias("failures"),
        F.count_if("need_review").alias("need_review"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
    )


def label_cost(df: DataFrame, provider: str = "provider", rates=None) -> DataFrame:
    """Tokens and cost per provider, to four decimals. A provider without a rate costs nothing."""
    rates = fv.RATE_PER_1K if rates is None else rates
    rate = F.lit(0).cast("decimal(10,6)")
    for name, value in rates.items():
        rate = F.when(F.col(provider) == name, F.lit(value).cast("decimal(10,6)")).otherwise(rate)
    sums = df.groupBy(provider).agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("tokens")
    )
    cost = F.round(F.col("tokens").cast("decimal(20,0)") * rate / 1000, 4).cast("double")
    return sums.withColumn("cost", cost)
