"""From posts and detections to actions, driven by three configuration tables.

The configuration tables are sent to every task, behind a check of their size, so that posts and detections
are not shuffled on the few values of a detector, platform or effect.
"""

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv, schemas
from ..functions.detectors import action_label, blur_strength
from ..session import send_if_small


def default_settings(spark) -> dict[str, DataFrame]:
    return {
        "platforms": spark.createDataFrame(fv.PLATFORMS, schemas.PLATFORMS),
        "detectors": spark.createDataFrame(fv.DETECTORS, schemas.DETECTORS),
        "effects": spark.createDataFrame(fv.EFFECTS, schemas.EFFECTS),
    }


def merge_settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Settings rows (section, value): a stored section replaces the whole default section."""
    return (
        defaults.select("section", F.col("value").alias("_default"))
        .join(stored.select("section", F.col("value").alias("_stored")), "section", "full")
        .select("section", F.coalesce("_stored", "_default").alias("value"))
    )


def over_threshold(detections: DataFrame, detectors: DataFrame) -> DataFrame:
    """Detections of enabled detectors that flag and reach their detector's threshold."""
    limits = detectors.filter("enabled").select(F.col("id").alias("detector_id"), "threshold")
    return (
        detections.join(send_if_small(limits), "detector_id")
        .filter(F.col("should_filter") & (F.col("confidence") >= F.col("threshold")))
        .drop("threshold")
    )


def configured_detectors(posts: DataFrame, platforms: DataFrame) -> DataFrame:
    """Posts of enabled platforms with their platform's detectors and effects."""
    enabled = platforms.filter("enabled").select(F.col("id").alias("platform"), "detectors", "effects")
    return posts.join(send_if_small(enabled), "platform")


def skip_scored(posts: DataFrame, results: DataFrame, platforms: DataFrame) -> DataFrame:
    """Posts for which some configured detector has no result yet."""
    # Distinct detector ids per post: as many as there are detectors.
    done = results.groupBy("post_id").agg(F.collect_set("detector_id").alias("_done"))
    missing = F.size(F.array_except("detectors", F.coalesce("_done", F.array().cast("array<string>")))) > 0
    return (
        configured_detectors(posts, platforms).join(done, "post_id", "left").filter(missing)
        .select(*posts.columns)
    )


def decide_actions(
    posts: DataFrame, detections: DataFrame, settings: dict[str, DataFrame],
    runnable_detectors=None, runnable_effects=None,
) -> DataFrame:
    """One row per post, detector and effect to apply.

    ``posts`` (post_id, platform), ``detections`` (post_id, detector_id, should_filter, confidence).
    Only detectors and effects that can run act; the others are configured in vain.
    """
    runnable_detectors = fv.RUNNABLE_DETECTORS if runnable_detectors is None else runnable_detectors
    runnable_effects = fv.RUNNABLE_EFFECTS if runnable_effects is None else runnable_effects
    wanted = (
        configured_detectors(posts.select("post_id", "platform"), settings["platforms"])
        .select("post_id", "platform", "effects", F.explode("detectors").alias("detector_id"))
        .filter(F.col("detector_id").isin(runnable_detectors))
    )
    flagged = over_threshold(detections, settings["detectors"]).join(wanted, ["post_id", "detector_id"])
    effects = settings["effects"].filter("enabled").select(F.col("id").alias("effect_id"), "options")
    text = action_label(F.col("detector_id"), F.col("confidence"))
    return (
        flagged.withColumn("effect_id", F.explode("effects"))
        .filter(F.col("effect_id").isin(runnable_effects))
        .join(send_if_small(effects), "effect_id")
        .select(
            "post_id", "platform", "detector_id", "confidence", "effect_id",
            F.when(F.col("effect_id") == "blur", blur_strength(F.col("options"))).alias("strength"),
            F.when(F.col("effect_id") == "label", text["label_text"]).alias("label_text"),
            F.when(F.col("effect_id") == "label", text["confidence_text"]).alias("confidence_text"),
        )
    )
