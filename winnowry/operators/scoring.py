"""Scoring cascade: a confident model result stands, every other row is scored from examples and keywords."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv, schemas
from ..functions import annotations as an, detectors as dt
from ..functions.embedding import embed_text
from ..functions.prompts import build_service_prompt
from ..functions.replies import parse_service_results
from ..session import materialize
from .knn import SMALL_BASE_ROWS, collect_base, default_examples, example_rows, knn_join_cells, nearest_examples
from .labeling import model_replies
from .stages import pinned


NEIGHBOR_LIST = f"array<struct<id:string,distance:double,text:string,{fv.LOW_QUALITY}:int,{fv.AI_GENERATED}:int>>"


def response(results: Column, snippet: Column, method: str) -> Column:
    positive = lambda t: an.task_label(results, t).eqNullSafe(F.lit(True))
    return F.struct(
        results.alias("task_results"),
        positive(fv.LOW_QUALITY).alias(fv.LOW_QUALITY),
        positive(fv.AI_GENERATED).alias(fv.AI_GENERATED),
        an.primary_confidence(results).alias("confidence"),
        an.primary_label(results).alias("label"),
        an.primary_reason(results).alias("reason"),
        snippet.cast("string").alias("rag_example"),
        F.lit(method).alias("detect_method"),
    )


def with_example_response(
    df: DataFrame, neighbors: str, name: str, keywords=None, by_platform=None, ai_keywords=None
) -> DataFrame:
    """Adds the response from neighbors (nearest first, with one 0/1 flag per task) and keyword hits.

    Intermediate values get columns of their own, so that none is spelled out twice in the plan.
    """
    text, near = F.col("text"), F.coalesce(F.col(neighbors), F.array().cast(NEIGHBOR_LIST))
    hits = {
        fv.LOW_QUALITY: dt.keyword_hits_by_platform(text, F.col("platform"), keywords, by_platform),
        fv.AI_GENERATED: dt.keyword_hits(text, fv.AI_KEYWORDS if ai_keywords is None else ai_keywords),
    }
    staged = df.withColumns(
        {f"_hits_{t}": hits[t] for t in fv.TASK_IDS} | {f"_votes_{t}": dt.knn_votes(near, t) for t in fv.TASK_IDS}
    )
    results = an.task_map(lambda t: dt.hybrid_result(t, F.col(f"_votes_{t}"), F.col(f"_hits_{t}")))
    snippet = dt.example_snippet(F.try_element_at(F.col(neighbors), F.lit(1))["text"])
    return staged.withColumn("_by_examples", results).withColumn(
        name, response(F.col("_by_examples"), snippet, fv.METHOD_EXAMPLES)
    )


def classify(
    df: DataFrame, examples: DataFrame | None = None, example_order: str = "ordinal", predict_fn=None,
    threshold: float = fv.MODEL_CONFIDENCE, embed=embed_text, k: int = fv.NEIGHBORS,
    keywords=None, by_platform=None, ai_keywords=None, id_col: str | None = None, small: int = SMALL_BASE_ROWS,
    search=knn_join_cells,
) -> DataFrame:
    """Adds the response columns to score requests (text, platform, task_ids).

    A base of at most ``small`` rows travels with the job: one pass without a shuffle. A larger one is searched
    by ``search(queries, base, k)``: by cells, with the same results, unless another search is given, like
    ``ann.knn_join_lists``. The model is asked once per row. Rows it is sure about hand a null on to
    the embedder and the example search, which skip nulls, so those steps cost only what is needed.
    """
    base = example_rows(
        default_examples(df.sparkSession) if examples is None else examples, example_order, embed
    )
    fields = ["id", "text", *fv.TASK_IDS, "embedding"]
    local = collect_base(base, fields, small)
    scored, always = pinned(_with_model(df, predict_fn, threshold))
    vector = embed(F.when(F.col("_model").isNull() & always, F.col("text")))
    if local is not None:
        payload = {"text": "string", fv.LOW_QUALITY: "int", fv.AI_GENERATED: "int"}
        scored = scored.withColumn("_embedding", vector)
        scored = scored.withColumn("_neighbors", nearest_examples(F.col("_embedding"), local, payload, k))
    else:
        scored = _neighbors_from_cells(scored, vector, base, id_col, k, search)
    scored = with_example_response(scored, "_neighbors", "_fallback", keywords, by_platform, ai_keywords)
    return scored.withColumn("_response", F.coalesce("_model", "_fallback")).select(*df.columns, "_response.*")


def _neighbors_from_cells(scored: DataFrame, vector: Column, base: DataFrame, id_col: str | None, k: int, search) -> DataFrame:
    """Neighbors from a base that is too large to travel. Model results and the vectors are stored first, under
    ``id_col`` or an id of their own, as they are used twice; so is the base with its vectors."""
    numbered = scored.withColumns({"_ask": F.col(id_col) if id_col else F.monotonically_increasing_id(), "_embedding": vector})
    stored, base = materialize(numbered, "scored"), materialize(base, "example-base")
    asked = stored.filter(F.col("_embedding").isNotNull()).select(F.col("_ask").alias("query_id"), F.col("_embedding").alias("embedding"))
    found = search(asked, base.select("id", "embedding"), k)
    # A list has at most k entries.
    entry = F.struct("neighbor_rank", "id", "distance", "text", *fv.TASK_IDS)
    lists = (
        found.join(base.drop("embedding", "category"), "id")
        .groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_neighbors"))
        .withColumnRenamed("query_id", "_ask")
    )
    neighbors = F.transform("_neighbors", lambda n: F.struct(*[n[c].alias(c) for c in ("id", "distance", "text", *fv.TASK_IDS)]))
    return stored.join(lists.withColumn("_neighbors", neighbors), "_ask", "left")


def _with_model(df: DataFrame, predict_fn, threshold: float) -> DataFrame:
    """``_model``: the model's response if it is confident enough, else null."""
    if predict_fn is None:
        nothing = F.lit(None).cast(schemas.RESULTS)
        return df.withColumn("_model", F.when(F.lit(False), response(nothing, F.lit(None), fv.METHOD_MODEL)))
    prompt = build_service_prompt(F.col("text"), F.col("task_ids"))
    asked = df.withColumn("_reply", model_replies(prompt, predict_fn)["reply"])
    parsed = asked.withColumn("_results", parse_service_results(F.col("_reply")))
    sure = an.primary_confidence(F.col("_results")) >= threshold
    answer = response(F.col("_results"), F.lit(None), fv.METHOD_MODEL)
    return parsed.withColumn("_model", F.when(F.col("_results").isNotNull() & sure, answer)).drop("_reply", "_results")
