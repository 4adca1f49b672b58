"""Connected components of a large graph, by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import few_tasks, forget


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label) for all nodes of edges (a, b) of longs: the label is the lowest node reachable.

    Each step sends, for every node, at most one value per task for its lowest neighbor; hubs are no groups
    that one task must hold. Edges are stored after each step. ``rows``: their number, about, where it is known.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e = materialize(e if rows is None else few_tasks(e, rows), "component-edges")
    mark = _mark(e)
    while mark[0]:
        # Large star: neighbors above a node go to the lowest node next to it.
        few = lambda df, n=2 * mark[0]: few_tasks(df, n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(_lowest(few(both)).withColumn("m", F.least("m", "u")))
        large = few(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v"))
        large = materialize(few(large.distinct()), "component-large")
        # Small star: a node and its neighbors below go to the lowest of them.
        low = few(_lowest(large))
        moved = few(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v"))
        before, e = e, materialize(few(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()), "component-small")
        forget(before, large)
        last, mark = mark, _mark(e)
        if mark == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
