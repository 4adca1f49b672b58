"""Rules that stored annotations must follow."""

from pyspark.sql import DataFrame

from . import tasks as ts


def validate_annotations(df: DataFrame, field: str = "task_annotations", tasks: DataFrame | None = None) -> DataFrame:
    """One row per (sample, task) that breaks a rule, with the names of the broken rules; ``tasks``: see ``tasks.py``."""
    return ts.validate(df, ts.default_tasks(df.sparkSession) if tasks is None else tasks, field)
