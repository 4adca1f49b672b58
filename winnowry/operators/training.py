"""Task data sets: field choice, splits, rebalancing, tuning rows, token rows."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.annotations import task_entry, task_label
from ..functions.prompts import build_sft_prompt, sft_answer
from ..session import materialize
from .ordering import class_histogram, hash_key, shuffle_rows, split_at_ranks, with_row_index

TEXT_FIELDS = ["text", "model_input", "content"]
ANNOTATION_FIELDS = ["task_annotations", "predicted_task_annotations"]


def labeled_for_task(df: DataFrame, task_id: str, field: str = "task_annotations") -> DataFrame:
    return df.filter(task_label(F.col(field), task_id).isNotNull())


def resolve_text_field(df: DataFrame, field: str = "auto") -> str:
    names = TEXT_FIELDS if field == "auto" else [field]
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"no text field among {names}")


def resolve_annotation_field(df: DataFrame, task_id: str, field: str = "auto") -> str:
    """auto: the field with more true or false labels for the task; equal counts prefer the first."""
    if field != "auto":
        if field not in df.columns:
            raise ValueError(f"no such annotation field: {field}")
        return field
    present = [f for f in ANNOTATION_FIELDS if f in df.columns]
    if present:
        counts = df.agg(*[F.count_if(task_label(F.col(f), task_id).isNotNull()).alias(f) for f in present]).first()
        best = max(present, key=lambda f: counts[f])
        if counts[best]:
            return best
    raise ValueError(f"task {task_id} has no true or false label")


def split_ratio_check(val: float, test: float, train: float | None = None) -> None:
    if train is not None and abs(train + val + test - 1.0) > 1e-8:
        raise ValueError("the ratios must add up to 1")
    for name, ratio in (("val", val), ("test", test)):
        if not 0 < ratio < 1:
            raise ValueError(f"{name} must lie between 0 and 1")
    if val + test >= 1:
        raise ValueError("val + test must be below 1")


def split_ratio_error(val: Column, test: Column, train: Column | None = None) -> Column:
    """The same for a table of ratios: what is wrong with a row, null if nothing is."""
    inside = lambda c: F.coalesce((c > 0) & (c < 1), F.lit(False))
    whole = F.lit(False) if train is None else F.coalesce(F.abs(train + val + test - 1.0) > 1e-8, F.lit(False))
    return (
        F.when(whole, "the ratios must add up to 1")
        .when(~inside(val), "val must lie between 0 and 1").when(~inside(test), "test must lie between 0 and 1")
        .when(val + test >= 1, "val + test must be below 1")
    )


def class_checks(df: DataFrame, by: list[str], label: str = "task_label") -> DataFrame:
    """(by, positive, negative, both_classes) for every group of rows, by one aggregate."""
    counted = df.groupBy(*by).agg(F.count_if(F.col(label)).alias("positive"), F.count_if(~F.col(label)).alias("negative"))
    return counted.withColumn("both_classes", (F.col("positive") > 0) & (F.col("negative") > 0))


def class_counts(df: DataFrame, label: str = "task_label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def both_classes_check(counts: dict) -> None:
    if not counts.get(True) or not counts.get(False):
        raise ValueError(f"both classes are needed: {counts}")


def task_dataset(
    df: DataFrame, task_id: str, annotation_field: str = "auto", text_field: str = "auto", check: bool = True
) -> DataFrame:
    """Rows labeled for the task, with text, annotation, label and reason."""
    field = resolve_annotation_field(df, task_id, annotation_field)
    text = resolve_text_field(df, text_field)
    rows = labeled_for_task(df, task_id, field).withColumns(
        {"text": F.col(text), "task_annotation": task_entry(F.col(field), task_id)}
    )
    rows = rows.withColumns(
        {
            "task_label": F.col("task_annotation.label"),
            "task_reason": F.coalesce("task_annotation.reason", F.lit("")),
        }
    )
    if check:
        both_classes_check({r["task_label"]: r["rows"] for r in class_counts(rows).collect()})
    return rows


def _largest_remainder(counts: dict, total: int) -> dict:
    """``total`` draws shared over classes in proportion; the largest remainders take the rest."""
    rows = sum(counts.values())
    exact = {c: n * total / rows for c, n in counts.items()}
    share = {c: math.floor(x) for c, x in exact.items()}
    left = total - sum(share.values())
    for c in sorted(counts, key=lambda c: (share[c] - exact[c], c))[:left]:
        share[c] += 1
    return share


def _held_out(counts: dict, ratio: float) -> dict:
    """Held-out rows per class: a total rounded up, the kept rows shared by largest remainder."""
    rows = sum(counts.values())
    held = math.ceil(rows * ratio)
    kept = _largest_remainder(counts, rows - held)
    return {c: n - kept[c] for c, n in counts.items()}


def stratified_split(
    df: DataFrame, id_col: str, val: float = 0.1, test: float = 0.1, seed=42, label: str = "task_label"
) -> DataFrame:
    """Adds ``split``: test, val or train. Class sizes are exact; membership follows a seeded hash of the id.

    No row moves: per-class ranks are turned into key limits by counting (see ``split_at_ranks``). The rows are
    stored first, so that whatever made them runs once; the counts then read two narrow columns of them.
    """
    split_ratio_check(val, test)
    df = materialize(df, "split-rows")
    key = hash_key(seed, F.col(id_col))
    histogram = class_histogram(df, F.col(label), key)
    counts = {c: sum(cells.values()) for c, cells in histogram.items()}
    both_classes_check(counts)
    tested = _held_out(counts, test)
    rest = {c: counts[c] - tested[c] for c in counts}
    validated = _held_out(rest, val / (1 - test))
    ranks = {c: [tested[c], tested[c] + validated[c]] for c in counts}
    return split_at_ranks(df, label, key, ranks, histogram, ["test", "val", "train"])


def approximate_split(df: DataFrame, id_col: str, val: float = 0.1, test: float = 0.1, seed=42) -> DataFrame:
    """Splits by hash thresholds alone: one pass, sizes in expectation."""
    split_ratio_check(val, test)
    share = hash_key(seed, F.col(id_col)).cast("double") / float(1 << 60)
    return df.withColumn(
        "split", F.when(share < test, "test").when(share < test + val, "val").otherwise("train")
    )


def train_test_split(df: DataFrame, id_col: str, test: float, seed=42, label: str = "task_label") -> DataFrame:
    if not 0 < test < 1:
        raise ValueError("test must lie between 0 and 1")
    df = materialize(df, "split-rows")
    key = hash_key(seed, F.col(id_col))
    histogram = class_histogram(df, F.col(label), key)
    counts = {c: sum(cells.values()) for c, cells in histogram.items()}
    both_classes_check(counts)
    ranks = {c: [n] for c, n in _held_out(counts, test).items()}
    return split_at_ranks(df, label, key, ranks, histogram, ["test", "train"])


@dataclass
class Balance:
    original_positive: int
    original_negative: int
    balanced_positive: int
    balanced_negative: int
    added_positive: int
    strategy: str


def rebalance(
    df: DataFrame, id_col: str, max_negative_ratio: float = 3.0, seed=42, label: str = "task_label",
    shuffle: bool = True,
) -> tuple[DataFrame, Balance]:
    """Draw positives with replacement until negatives are at most ``max_negative_ratio`` times as many.

    Draw i takes the positive number ``hash(seed, i) mod positives``. ``copy_no`` is 0 for original rows and
    the number of the draw, from 1, for drawn copies.
    """
    if max_negative_ratio <= 0:
        raise ValueError("max_negative_ratio must be above 0")
    counts = {r[label]: r["rows"] for r in class_counts(df, label).collect()}
    positive, negative = counts.get(True, 0), counts.get(False, 0)
    original = df.withColumn("copy_no", F.lit(0).cast("bigint"))
    if not positive or not negative:
        return original, Balance(positive, negative, positive, negative, 0, "unchanged")
    added = 0
    if negative / positive > max_negative_ratio:
        added = math.ceil(negative / max_negative_ratio) - positive
        draws = df.sparkSession.range(added).select(
            (F.col("id") + 1).alias("copy_no"), (hash_key(seed, F.col("id")) % positive).alias("row_index")
        )
        content = [hash_key(seed, F.col(id_col)), F.col(id_col)]
        indexed = with_row_index(df.filter(label), content)
        # Few positives: Spark sends them to the draws. Many: every one is drawn about equally often.
        drawn = draws.join(indexed, "row_index").select(*df.columns, "copy_no")
        original = original.unionByName(drawn)
    strategy = "oversample_positive" if added else "unchanged"
    balance = Balance(positive, negative, positive + added, negative, added, strategy)
    return (shuffle_rows(original, seed, id_col, "copy_no") if shuffle else original), balance


def load_presplit(
    train: DataFrame | None, val: DataFrame | None, task_id: str, id_col: str, annotation_field: str = "auto",
    text_field: str = "auto", max_negative_ratio: float | None = 3.0, seed=42,
) -> DataFrame:
    """Given train and val inputs, each resolved for itself; only train is rebalanced (null: not at all)."""
    if (train is None) != (val is None):
        raise ValueError("give both train and val, or neither")
    fields = [id_col, "text", "task_annotation", "task_label", "task_reason"]
    t = task_dataset(train, task_id, annotation_field, text_field).select(*fields)
    v = task_dataset(val, task_id, annotation_field, text_field).select(*fields)
    if max_negative_ratio is not None:
        t, _ = rebalance(t, id_col, max_negative_ratio, seed, shuffle=False)
    else:
        t = t.withColumn("copy_no", F.lit(0).cast("bigint"))
    v = v.withColumn("copy_no", F.lit(0).cast("bigint"))
    return t.withColumn("split", F.lit("train")).unionByName(v.withColumn("split", F.lit("test")))


def format_sft(df: DataFrame, task_id: str, end_token: str = "") -> DataFrame:
    return df.withColumns(
        {
            "prompt_text": build_sft_prompt(F.col("text"), task_id),
            "answer_text": sft_answer(F.col("task_label"), end_token),
        }
    )


def pack_tokens(prompt_ids: Column, answer_ids: Column, max_len: int, pad: int) -> Column:
    """Fixed-length token rows: the prompt is cut so that the answer fits; only answer tokens are labels."""
    fits = F.size(answer_ids) < max_len
    checked = F.when(
        fits, answer_ids
    ).otherwise(F.raise_error(F.lit(f"an answer does not fit into {max_len} tokens")).cast("array<int>"))
    prompt = F.slice(prompt_ids, F.lit(1), F.lit(max_len) - F.size(answer_ids))
    used = F.size(prompt) + F.size(answer_ids)
    rest = F.lit(max_len) - used
    repeat = lambda value, n: F.array_repeat(F.lit(value), n)
    return F.struct(
        F.concat(prompt, checked, repeat(pad, rest)).alias("input_ids"),
        F.concat(repeat(1, used), repeat(0, rest)).alias("attention_mask"),
        F.concat(
            repeat(fv.IGNORED_TOKEN, F.size(prompt)), checked, repeat(fv.IGNORED_TOKEN, rest)
        ).alias("labels"),
    )
