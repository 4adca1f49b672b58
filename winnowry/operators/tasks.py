"""Tasks as a table: their prompts, annotations and rules, read from its rows.

A task is a row (task_id, ordinal, name, description, positive_label, negative_label, reason_options). Whatever is done
for every task follows the table, in the order of ``ordinal``; a new task is a new row. The table is small by nature
and goes to every task of a job behind a check of its size. Ids must be unique.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv, schemas
from ..functions import annotations as an
from ..session import send_if_small


def default_tasks(spark) -> DataFrame:
    return spark.createDataFrame([tuple(t[c.split(" ")[0]] for c in schemas.TASKS.split(", ")) for t in fv.TASKS], schemas.TASKS)


def listed(tasks: DataFrame) -> DataFrame:
    """One row: ``tasks``, all of the table in order. As many entries as there are tasks."""
    columns = [c.split(" ")[0] for c in schemas.TASKS.split(", ")]
    return tasks.agg(F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in columns if c != "ordinal"]))).alias("tasks"))


def _filled(template: str, **parts: Column) -> Column:
    """A format text with columns in its places."""
    marks = {name: f"\0{name}\0" for name in parts}
    pieces = template.format(**marks).split("\0")
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def prompt_heads(tasks: DataFrame) -> DataFrame:
    """One row: ``head``, the constant start of the labeling prompt for all tasks of the table."""
    line = lambda t: _filled(fv.LABEL_TASK_LINE, task_id=t["task_id"], description=t["description"], reasons=F.array_join(t["reason_options"], "、"))
    entry = lambda t: _filled(fv.LABEL_SCHEMA_LINE, task_id=t["task_id"])
    lines, schema = F.array_join(F.transform("tasks", line), "\n"), F.array_join(F.transform("tasks", entry), ",\n")
    return listed(tasks).select(_filled(fv.LABEL_PROMPT_HEAD, tasks=lines, schema=schema).alias("head"))


def with_label_prompt(df: DataFrame, tasks: DataFrame, text: str, name: str = "prompt", n: int = fv.LABEL_CHARS) -> DataFrame:
    """Adds the prompt that asks a model for every task of the table."""
    heads = prompt_heads(tasks).withColumnRenamed("head", "_head")
    prompt = F.concat("_head", F.substring(F.col(text), 1, n), F.lit("\n"))
    return df.crossJoin(send_if_small(heads)).withColumn(name, prompt).drop("_head")


def with_empty_annotations(df: DataFrame, tasks: DataFrame, name: str = "task_annotations") -> DataFrame:
    """Adds an unlabeled, pending annotation for every task of the table."""
    empty = an.annotation(F.lit(None).cast("boolean"), source=F.lit("pending"))
    one = listed(tasks).select(F.map_from_entries(F.transform("tasks", lambda t: F.struct(t["task_id"], empty))).alias("_empty"))
    return df.crossJoin(send_if_small(one)).withColumn(name, F.col("_empty").cast(schemas.ANNOTATIONS)).drop("_empty")


def validate(df: DataFrame, tasks: DataFrame, field: str = "task_annotations", key: str = "sample_id") -> DataFrame:
    """(key, task_id, violations): one row per sample and task that breaks a rule, with the names of the broken rules.

    A positive label needs a reason of the task's own options; a task that is not in the table is unknown.
    """
    a = lambda name: F.col(f"annotation.{name}")
    status = F.when(a("label").isNull(), "unlabeled").when(a("label"), "labeled_positive").otherwise("labeled_negative")
    reason = F.coalesce(a("reason"), F.lit(""))
    own = tasks.select("task_id", F.coalesce("reason_options", F.array().cast("array<string>")).alias("_reasons"))
    rules = {
        "unknown_task": F.col("_reasons").isNull(),
        "status_mismatch": ~a("status").eqNullSafe(status),
        "unknown_status": ~F.coalesce(a("status").isin(fv.ANNOTATION_STATUSES), F.lit(False)),
        "unknown_source": ~F.coalesce(a("source").isin(fv.ANNOTATION_SOURCES), F.lit(False)),
        "confidence_range": F.coalesce(~a("confidence").between(0.0, 1.0), F.lit(False)),
        "positive_without_reason": F.coalesce(a("label"), F.lit(False)) & (reason == ""),
        "unknown_reason": (reason != "") & ~F.coalesce(F.array_contains("_reasons", reason), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    rows = df.select(key, F.explode(field).alias("task_id", "annotation"))
    return rows.join(send_if_small(own), "task_id", "left").withColumn("violations", broken).filter(F.size("violations") > 0).select(key, "task_id", "annotation", "violations")


def missing_tasks(df: DataFrame, tasks: DataFrame, field: str = "task_annotations", key: str = "sample_id") -> DataFrame:
    """(key, missing): samples that lack an annotation of some task of the table."""
    ids = listed(tasks).select(F.transform("tasks", lambda t: t["task_id"]).alias("_ids"))
    known = F.coalesce(F.map_keys(field), F.array().cast("array<string>"))
    lacking = df.crossJoin(send_if_small(ids)).select(key, F.array_except("_ids", known).alias("missing"))
    return lacking.filter(F.size("missing") > 0)


def example_flags(df: DataFrame, tasks: DataFrame, field: str = "task_annotations") -> DataFrame:
    """Adds ``flags``, a 0/1 value for every task of the table: 1 where the example is labeled positive."""
    flag = lambda t: F.coalesce(F.try_element_at(F.col(field), t["task_id"])["label"], F.lit(False)).cast("int")
    entries = F.transform("_tasks", lambda t: F.struct(t["task_id"], flag(t)))
    return df.crossJoin(send_if_small(listed(tasks).withColumnRenamed("tasks", "_tasks"))).withColumn("flags", F.map_from_entries(entries)).drop("_tasks")
