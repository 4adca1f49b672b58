"""Keyword, example and rule scores. Doubles are added in a fixed order, so flags at a cutoff agree."""

from functools import reduce
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from .annotations import result, task_entry
from .numeric import round2


def keyword_hits(c: Column, keywords) -> Column:
    return F.array_compact(F.array(*[F.when(c.contains(k), F.lit(k)) for k in keywords]))


def keyword_hits_by_platform(c: Column, platform: Column, keywords=None, by_platform=None) -> Column:
    """The dictionary of the row's platform replaces the default one."""
    keywords = fv.LOW_QUALITY_KEYWORDS if keywords is None else keywords
    by_platform = fv.LOW_QUALITY_KEYWORDS_BY_PLATFORM if by_platform is None else by_platform
    hits = keyword_hits(c, keywords)
    for name, words in by_platform.items():
        hits = F.when(platform == name, keyword_hits(c, words)).otherwise(hits)
    return hits


def knn_votes(neighbors: Column, flag: str) -> Column:
    """Share of the neighbors that carry a flag; no neighbors count as one."""
    positive = F.aggregate(
        neighbors, F.lit(0), lambda n, x: n + F.when(x[flag].cast("boolean"), 1).otherwise(0)
    )
    return positive.cast("double") / F.greatest(F.size(neighbors), F.lit(1)).cast("double")


def hybrid_score(task_id: str, votes: Column, hits: Column) -> Column:
    return votes * F.lit(fv.VOTE_WEIGHT) + F.least(
        F.lit(fv.HIT_CAP), F.size(hits).cast("double") * F.lit(fv.HIT_WEIGHT[task_id])
    )


def hybrid_result(task_id: str, votes: Column, hits: Column) -> Column:
    score = hybrid_score(task_id, votes, hits)
    positive = score > fv.SCORE_CUTOFF[task_id]
    confidence = round2(F.when(positive, score).otherwise(F.lit(1.0) - score))
    reason = F.when(
        F.size(hits) > 0, F.concat(F.lit(fv.HIT_REASON[task_id]), F.array_join(F.slice(hits, 1, 2), ", "))
    ).otherwise(F.lit(fv.VOTE_REASON))
    return result(positive, confidence, reason)


def example_snippet(text: Column) -> Column:
    return F.concat(F.substring(text, 1, 80), F.lit("..."))


# ---- rule score ----------------------------------------------------------------------------

_LINE_BREAKS = r"\n\r\x{2028}\x{2029}"
_LINE_START, _LINE_END = f"(?<![^{_LINE_BREAKS}])", f"(?![^{_LINE_BREAKS}])"
LIST_LINE = rf"(?=[0-9]){_LINE_START}[0-9]+[.、][{fv.PAGE_SPACE}]*[^\n]{{0,10}}{_LINE_END}"
# Runs, and characters without which a text has none.
RUN_PATTERNS = {"[!！]{2,}": "!！", "[?？]{2,}": "?？", "[a-zA-Z]{5,}": "", "[0-9]{8,}": ""}
SENTENCE_END = "[.!?。！？]"
SENTENCE = rf"[^{fv.PAGE_SPACE}。！？.!?][^。！？.!?]*"
PLAIN = rf"[\p{{L}}\p{{N}}{fv.PAGE_SPACE}]+"
# Spelled out, the commonest plain characters are one table look-up each.
COMMON = f"[{ascii_letters}{digits} ]+"


def _cased(word: str) -> bool:
    return word.upper() != word.lower()


def keyword_occurrences(c: Column, keywords) -> Column:
    """Occurrences of every keyword, each counted alone, upper and lower case alike.

    Words without case are counted by the bytes that go missing when they are taken out; those beyond ASCII
    only in texts with a character of their range.
    """
    size = F.octet_length
    count = lambda k: F.when(
        c.contains(k), ((size(c) - size(F.replace(c, k, F.lit("")))) / size(k)).cast("int")
    ).otherwise(F.lit(0))
    total = F.lit(0)
    for cased in (k for k in keywords if _cased(k)):
        total = total + F.regexp_count(c, F.lit(f"(?i){cased}"))
    for word in (k for k in keywords if k.isascii() and not _cased(k)):
        total = total + count(F.lit(word))
    wide = [k for k in keywords if not k.isascii() and not _cased(k)]
    if wide:
        telling = [max(k) for k in wide]
        each = F.aggregate(F.lit(wide), F.lit(0), lambda n, k: n + count(k))
        total = total + F.when(c.rlike(f"[{min(telling)}-{max(telling)}]"), each).otherwise(F.lit(0))
    return total


def pattern_occurrences(c: Column) -> Column:
    total = F.regexp_count(c, F.lit(LIST_LINE))
    for pattern, needed in RUN_PATTERNS.items():
        count = F.regexp_count(c, F.lit(pattern))
        if needed:
            count = F.when(reduce(lambda a, b: a | b, [c.contains(x) for x in needed]), count).otherwise(F.lit(0))
        total = total + count
    return total


def low_quality_parts(c: Column, keywords=None) -> dict[str, Column]:
    """The measurements behind the rule score.

    Sentences are counted only where they can be short on average: there are at most as many as sentence
    ends and one more. Elsewhere the count is given as 0, which is never short.
    """
    keywords = fv.RULE_SCORE_KEYWORDS if keywords is None else keywords
    ends = F.regexp_count(c, F.lit(SENTENCE_END)) + 1
    return {
        "n_chars": F.length(c),
        "n_keywords": keyword_occurrences(c, keywords),
        "n_patterns": pattern_occurrences(c),
        "n_sentences": F.when(F.length(c) < ends * 10, F.regexp_count(c, F.lit(SENTENCE))).otherwise(F.lit(0)),
        "n_special": F.length(F.regexp_replace(c, f"{COMMON}|{PLAIN}", "")),
    }


def low_quality_from_parts(parts: dict[str, Column]) -> Column:
    chars, words, patterns = parts["n_chars"], parts["n_keywords"], parts["n_patterns"]
    sentences, special = parts["n_sentences"], parts["n_special"]
    double = lambda x: x.cast("double")
    short = chars < 30
    choppy = (sentences > 0) & (double(chars) / double(F.greatest(sentences, F.lit(1))) < 10)
    symbols = (chars > 0) & (double(special) / double(F.greatest(chars, F.lit(1))) > 0.3)
    zero = F.lit(0.0)
    score = (
        F.when(short, 0.3).when(chars > 2000, -0.1).otherwise(0.0)
        + F.least(double(words) * 0.1, F.lit(0.4))
        + F.least(double(patterns) * 0.05, F.lit(0.3))
        + F.when(choppy, 0.2).otherwise(0.0)
        + F.when(symbols, 0.2).otherwise(0.0)
    )
    confidence = F.greatest(zero, F.least(F.lit(1.0), score))
    reasons = F.array_compact(
        F.array(
            F.when(short, fv.REASON_SHORT),
            F.when(words > 0, F.format_string(fv.REASON_KEYWORDS, words)),
            F.when(patterns > 0, F.format_string(fv.REASON_PATTERNS, patterns)),
            F.when(choppy, fv.REASON_SENTENCES),
            F.when(symbols, fv.REASON_SPECIAL),
        )
    )
    return F.struct(
        (confidence > 0.5).alias("should_filter"), confidence.alias("confidence"), reasons.alias("reasons")
    )


def with_low_quality_score(df: DataFrame, text: str, name: str, keywords=None) -> DataFrame:
    """Adds the rule score. Its parts are columns of their own first, so that each is measured once."""
    parts = low_quality_parts(F.col(text), keywords)
    measured = df.withColumns({f"_{n}": c for n, c in parts.items()})
    score = low_quality_from_parts({n: F.col(f"_{n}") for n in parts})
    return measured.withColumn(name, score).drop(*[f"_{n}" for n in parts])


def fallback_rule_score(c: Column, task_id: str, keywords=None) -> Column:
    n = F.size(keyword_hits(c, fv.RULE_KEYWORDS[task_id] if keywords is None else keywords))
    confidence = F.least(F.lit(0.9), F.lit(0.5) + n.cast("double") * F.lit(fv.RULE_STEP[task_id]))
    return F.struct((n > 0).alias("should_filter"), confidence.alias("confidence"))


def to_detection(response: Column, task_id: str) -> Column:
    """A scoring response as a flag and a confidence for one task."""
    entry = task_entry(response["task_results"], task_id)
    flag = F.coalesce(response[task_id], F.lit(False))
    legacy = F.when(flag, response["confidence"]).otherwise(F.lit(1.0) - response["confidence"])
    return F.struct(
        F.when(entry.isNotNull(), entry["label"].eqNullSafe(F.lit(True))).otherwise(flag).alias("should_filter"),
        F.when(entry.isNotNull(), entry["confidence"]).otherwise(legacy).alias("confidence"),
        F.coalesce(F.nullif(entry["reason"], F.lit("")), response["reason"]).alias("reason"),
    )


def two_class_detection(ai_score: Column, human_score: Column) -> Column:
    ai, human = F.coalesce(ai_score, F.lit(0.0)), F.coalesce(human_score, F.lit(0.0))
    return F.struct((ai > human).alias("should_filter"), ai.alias("confidence"))


def action_label(detector_id: Column, confidence: Column) -> Column:
    name = F.lit(fv.OTHER_LABEL)
    for detector, text in fv.DETECTOR_LABELS.items():
        name = F.when(detector_id == detector, F.lit(text)).otherwise(name)
    return F.struct(
        name.alias("label_text"),
        F.format_string(fv.CONFIDENCE_LABEL + "%.1f%%", confidence * 100.0).alias("confidence_text"),
    )


def blur_strength(options: Column) -> Column:
    given = F.try_element_at(options, F.lit("intensity"))
    return F.when(given != 0, given).otherwise(F.lit(fv.BLUR_STRENGTH))
