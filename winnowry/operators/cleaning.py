"""Raw answers to cleaned samples."""

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.annotations import empty_annotations
from .dedup import answer_text
from .stages import computed, filter_computed


def drop_short(
    df: DataFrame, column: str = "answer_full_clean", n: int = fv.MIN_ANSWER_CHARS, costly: list[str] | None = None
) -> DataFrame:
    """Rows whose text is long enough. ``costly`` names computed columns that later filters must not compute again."""
    return filter_computed(df, F.length(column) >= n, [column] if costly is None else costly)


def purge_invalid(raw: DataFrame, n: int = fv.MIN_RAW_ANSWER_CHARS) -> DataFrame:
    """Drop blocked pages, very short answers and records without a question."""
    answer = answer_text(raw)
    blocked = F.lit(False)
    for phrase in fv.BLOCKED_PAGE_PHRASES:
        blocked = blocked | answer.contains(phrase)
    return raw.filter(~blocked & (F.length(answer) >= n) & (F.col("question") != ""))


def _derived(raw: DataFrame, entities: bool) -> DataFrame:
    """Texts and flags of every raw record. A column the input lacks counts as empty."""
    col = lambda name: F.col(name) if name in raw.columns else F.lit("")
    answer = tx.text_stages(col("answer_full"), entities)
    return (
        raw.withColumns(
            {
                "_question": tx.normalize_text(col("question"), entities),
                "_detail": tx.normalize_text(col("question_detail"), entities),
                "_legacy": tx.normalize_text(col("answer_truncated"), entities),
                "_decoded": answer.decoded,
            }
        )
        .withColumn("_bare", tx.strip_tags(F.col("_decoded")))
        .withColumn("_visible", tx.strip_zero_width(F.col("_bare")))
        .withColumn("_clean", tx.collapse_space(F.col("_visible")))
        .withColumns(
            {
                "_had_html": F.col("_bare") != F.col("_decoded"),
                "_spaced": F.col("_clean") != F.col("_visible"),
                "_contact": tx.has_contact_hint(F.col("_clean")),
                "_before": F.length(answer.source),
                "_after": F.length("_clean"),
            }
        )
        .withColumns(
            {"_preview": tx.build_preview(F.col("_clean")), "_cut": tx.is_cut(F.col("_clean"))}
        )
    )


def clean_answers(
    raw: DataFrame, include_answer_in_id: bool = False, entities: bool = True, observation: Observation | None = None
) -> DataFrame:
    """Cleaned samples: short answers dropped, texts derived, annotations empty.

    An ``observation`` gets the counters of ``cleaning_stats`` while the samples are written, with no pass of its own.
    """
    col = lambda name, default: (
        F.coalesce(F.col(name), F.lit(default)) if name in raw.columns else F.lit(default)
    )
    d = _derived(raw, entities)
    if observation is not None:
        d = computed(d, {c: F.col(c) for c in d.columns if c not in raw.columns})
        d = d.observe(observation, *[c.alias(n) for n, c in stat_columns().items()])
    d = drop_short(d, "_clean", costly=[c for c in d.columns if c not in raw.columns])
    platform = col("platform", fv.DEFAULT_PLATFORM)
    d = d.withColumn("model_input", tx.build_model_input(F.col("_question"), F.col("_preview")))
    return d.select(
        tx.build_sample_id(
            platform, col("url", ""), col("author", ""), F.col("_question"), col("answer_full", ""),
            include_answer_in_id,
        ).alias("sample_id"),
        F.col("_question").alias("question"),
        F.col("_detail").alias("question_detail"),
        F.col("model_input").alias("content"),
        "model_input",
        F.col("_preview").alias("answer_preview"),
        F.col("_clean").alias("answer_full_clean"),
        empty_annotations().alias("task_annotations"),
        col("author", "").alias("author"),
        col("votes", 0).cast("bigint").alias("votes"),
        col("comment_count", 0).cast("bigint").alias("comment_count"),
        platform.alias("platform"),
        col("url", "").alias("url"),
        col("collected_at", "").alias("collected_at"),
        F.struct(
            F.col("_cut").alias("preview_was_truncated"),
            F.lit(fv.PREVIEW_CHARS).alias("preview_max_chars"),
            F.col("_had_html").alias("had_html"),
            F.col("_contact").alias("has_spam"),
            F.col("_contact").alias("has_contact_hint"),
            F.col("_before").alias("source_answer_chars"),
            F.col("_after").alias("clean_answer_chars"),
        ).alias("extra"),
    )


def stat_columns() -> dict[str, Column]:
    """Counters over derived records. Html, space and contact counts come before the length filter, the rest after."""
    kept = F.col("_after") >= fv.MIN_ANSWER_CHARS
    changed = (F.col("_legacy") != "") & (F.col("_legacy") != F.col("_preview"))
    return {
        "total": F.count(F.lit(1)),
        "written": F.count_if(kept),
        "filtered_short": F.count_if(~kept),
        "html_touched": F.count_if("_had_html"),
        "whitespace_normalized": F.count_if("_spaced"),
        "contact_hint_hits": F.count_if("_contact"),
        "preview_truncated": F.count_if(kept & F.col("_cut")),
        "preview_changed_vs_legacy": F.count_if(kept & changed),
    }


def cleaning_stats(raw: DataFrame, entities: bool = True) -> DataFrame:
    """One row of counters."""
    return _derived(raw, entities).agg(*[c.alias(n) for n, c in stat_columns().items()])


def cleaning_example_view(raw: DataFrame, order: str, n: int = 5, entities: bool = True) -> DataFrame:
    """The first n records whose preview differs from the old one, with clipped columns."""
    d = _derived(raw, entities)
    clip = lambda name, size: F.substring(F.coalesce(F.col(name), F.lit("")), 1, size)
    changed = (F.col("_legacy") != "") & (F.col("_legacy") != F.col("_preview"))
    return (
        filter_computed(d, (F.col("_after") >= fv.MIN_ANSWER_CHARS) & changed, [c for c in d.columns if c not in raw.columns])
        .orderBy(order)
        .limit(n)
        .select(
            order,
            clip("question", 60).alias("question"),
            clip("answer_full", 160).alias("raw_answer"),
            clip("_clean", 160).alias("clean_full"),
            clip("_legacy", 120).alias("legacy_preview"),
            clip("_preview", 120).alias("new_preview"),
        )
    )


def resolve_text(df: DataFrame, field: str = "model_input") -> Column:
    """The named field; a missing ``model_input`` falls back to ``content``, any other is an error."""
    if field == "model_input":
        found = [F.col(c) for c in ("model_input", "content") if c in df.columns]
        return F.coalesce(*found, F.lit(""))
    if field not in df.columns:
        raise ValueError(f"no such text field: {field}")
    return F.col(field)


def parse_collected_at(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "collected_at", F.try_to_timestamp("collected_at", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    )


