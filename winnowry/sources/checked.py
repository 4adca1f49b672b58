"""Data sets that are checked while they are written: no second pass, and nothing in place if a check fails."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..operators.training import both_classes_check
from ..session import delete_path, list_names, rename_path


def write_checked(
    df: DataFrame, path: str, metrics: dict[str, Column], check: Callable[[dict], None], write: Callable[[DataFrame, str], None] | None = None
) -> dict:
    """Write a frame beside ``path``, with ``metrics`` (aggregates) gathered on the way; put it in place if ``check`` raises nothing.

    An older data set at ``path`` is replaced then, and stays where it is if writing or checking fails. Returns the metrics.
    """
    spark, seen = df.sparkSession, Observation()
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    write = write or (lambda d, p: d.write.parquet(p))
    try:
        write(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), staged)
        check(seen.get)
        delete_path(spark, path)
        rename_path(spark, staged, path)
    finally:
        delete_path(spark, staged)
    return seen.get


def write_task_dataset(df: DataFrame, path: str, label: str = "task_label", write=None) -> dict:
    """Write a task's rows if both classes are there; returns rows, positive and negative."""
    metrics = {"rows": F.count(F.lit(1)), "positive": F.count_if(F.col(label)), "negative": F.count_if(~F.col(label))}
    return write_checked(df, path, metrics, lambda m: both_classes_check({True: m["positive"], False: m["negative"]}), write)


def write_split_files(df: DataFrame, path: str, files: int = 1) -> list[str]:
    """Write rows with ``task_id`` and ``split`` as JSON lines ``{task}_{split}.jsonl``; returns the names.

    With more than one file for each split they are numbered. All files are written beside first and renamed when every
    task has ended, so a failed task leaves nothing. A file of that name is replaced; an empty split has none.
    """
    from .jsonl import path_part

    spark = df.sparkSession
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    name = F.concat_ws("_", path_part(F.col("task_id")), path_part(F.col("split")))
    share = F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns))), F.lit(files)) if files > 1 else F.lit(0)
    dealt = df.withColumns({"_file": name, "_share": share.cast("int")}).repartition("_file", "_share")
    made = []
    try:
        dealt.write.option("ignoreNullFields", "false").partitionBy("_file", "_share").json(staged)
        for folder in [n for n in list_names(spark, staged) if n.startswith("_file=")]:
            for share in list_names(spark, f"{staged}/{folder}"):
                number = f"-{int(share.split('=')[1]):05d}" if files > 1 else ""
                target = f"{folder.split('=', 1)[1]}{number}.jsonl"
                # A share is one task's, so one file.
                (part,) = [n for n in list_names(spark, f"{staged}/{folder}/{share}") if n.startswith("part-")]
                delete_path(spark, f"{path.rstrip('/')}/{target}")
                rename_path(spark, f"{staged}/{folder}/{share}/{part}", f"{path.rstrip('/')}/{target}")
                made.append(target)
    finally:
        delete_path(spark, staged)
    return sorted(made)
