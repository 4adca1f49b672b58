"""Keeping costly columns computed once, and filters on all others on their way to the scan."""

from pyspark.sql import Column, DataFrame, functions as F


def pinned(df: DataFrame) -> tuple[DataFrame, Column]:
    """The frame, and a condition that always holds but ties whatever uses it to this point of the plan.

    Catalyst merges projections and pushes filters below them, which spells a costly column out again in
    every place that looks at it. It does not do so across a random column that the later step reads.
    """
    return df.withColumn("_pin", F.rand(0)), F.col("_pin") >= 0


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The frame with costly columns that are computed once for each row.

    They come out of a generate step: a later filter on them stays above it, so nothing is spelled out twice, while one on
    the other columns goes below it, down to the scan.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def filter_computed(df: DataFrame, condition: Column, names: list[str]) -> DataFrame:
    """Filter by costly computed columns, those of ``names``, without computing them twice; others stay open to filters."""
    return computed(df, {n: F.col(n) for n in names}).filter(condition).select(*df.columns)
