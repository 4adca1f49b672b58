"""Cleaning and derived text."""

import html
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .pieces import arrow_type, by_pieces

_HIDDEN_BLOCKS = "(?is)" + "|".join(
    [r"<!--.*?(?:-->|\z)"]
    + [rf"<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "svg", "noscript")]
)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def decode_entities(c: Column) -> Column:
    """HTML entities decoded in one pass. Only rows with an ampersand carry text to Python."""

    text = arrow_type("string")

    @F.arrow_udf("string")
    def decode(texts: pa.Array) -> pa.Array:
        return by_pieces(texts, lambda some: [t if t is None else html.unescape(t) for t in some.to_pylist()], text)

    return F.coalesce(decode(F.when(c.contains("&"), c)), c)


class TextStages(NamedTuple):
    source: Column
    decoded: Column
    without_tags: Column
    visible: Column
    clean: Column


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def strip_zero_width(c: Column) -> Column:
    return F.regexp_replace(c, f"[{fv.ZERO_WIDTH}]", "")


def _single_blanks(c: Column, narrow: str, wide: str) -> Column:
    """White-space runs to one blank, ends stripped. A single blank is no match: it stays as it is.

    Most texts hold narrow white space only; a class of those characters is one table look-up per character.
    """
    runs = lambda chars: rf"[{chars}][\x20{chars}]*|\x20[\x20{chars}]+"
    has_wide = c.rlike(f"[{wide}]")
    collapsed = F.when(has_wide, F.regexp_replace(c, runs(narrow + wide), " ")).otherwise(
        F.regexp_replace(c, runs(narrow), " ")
    )
    return F.trim(collapsed)


def collapse_space(c: Column) -> Column:
    return _single_blanks(c, fv.TEXT_NARROW, fv.WIDE_SPACE)


def text_stages(c: Column, entities: bool = True) -> TextStages:
    source = text_or_empty(c)
    decoded = decode_entities(source) if entities else source
    without_tags = strip_tags(decoded)
    visible = strip_zero_width(without_tags)
    clean = collapse_space(visible)
    return TextStages(source, decoded, without_tags, visible, clean)


def normalize_text(c: Column, entities: bool = True) -> Column:
    """Entities, then tags, then zero-width characters, then white space."""
    return text_stages(c, entities).clean


def clean_flags(c: Column, entities: bool = True) -> dict[str, Column]:
    s = text_stages(c, entities)
    return {
        "had_html": s.without_tags != s.decoded,
        "whitespace_normalized": s.clean != s.visible,
        "chars_before": F.length(s.source),
        "chars_after": F.length(s.clean),
    }


def has_contact_hint(c: Column, phrases=None) -> Column:
    """Any of the phrases, upper and lower case alike. Phrases in scripts without case are plain byte searches."""
    phrases = fv.CONTACT_PHRASES if phrases is None else phrases
    cased = [p for p in phrases if p.upper() != p.lower()]
    found = [c.contains(p) for p in phrases if p not in cased]
    if cased:
        found.append(c.rlike("(?iu)" + "|".join(cased)))
    return reduce(lambda a, b: a | b, found)


def is_cut(c: Column, n: int = fv.PREVIEW_CHARS) -> Column:
    return F.length(c) > n


def build_preview(c: Column, n: int = fv.PREVIEW_CHARS) -> Column:
    head = F.regexp_replace(F.substring(c, 1, n), rf"[{fv.TEXT_SPACE}]+\z", "")
    return F.when(is_cut(c, n), F.concat(head, F.lit("..."))).otherwise(c)


def truncate_legacy(c: Column, n: int = fv.PREVIEW_CHARS) -> Column:
    return F.when(is_cut(c, n), F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def build_model_input(question: Column, preview: Column) -> Column:
    question, preview = text_or_empty(question), text_or_empty(preview)
    asked = F.concat(F.lit(fv.QUESTION_PREFIX), question)
    return (
        F.when(question == "", preview)
        .when(preview == "", asked)
        .otherwise(F.concat(asked, F.lit("\n" + fv.PREVIEW_PREFIX), preview))
    )


def build_sample_id(
    platform: Column, url: Column, author: Column, question: Column, answer: Column, include_answer: bool = False
) -> Column:
    """Stable id. The answer takes part only if url, author and question are empty (or on request)."""
    url, author, question = text_or_empty(url), text_or_empty(author), text_or_empty(question)
    base = F.concat_ws("||", F.coalesce(platform, F.lit(fv.DEFAULT_PLATFORM)), url, author, question)
    whole = F.concat_ws("||", base, text_or_empty(answer))
    anonymous = (url == "") & (author == "") & (question == "")
    key = whole if include_answer else F.when(anonymous, whole).otherwise(base)
    return F.substring(F.sha1(key), 1, 16)


def truncate_for_model(c: Column, n: int = fv.LABEL_CHARS) -> Column:
    return F.substring(c, 1, n)


def html_to_text(c: Column, entities: bool = True) -> Column:
    """Visible text of markup: hidden blocks and tags out, then entities, then white space."""
    bare = F.regexp_replace(F.regexp_replace(text_or_empty(c), _HIDDEN_BLOCKS, " "), "<[^>]*>", " ")
    decoded = decode_entities(bare) if entities else bare
    return page_space(decoded)


def page_space(c: Column) -> Column:
    return _single_blanks(text_or_empty(c), fv.PAGE_NARROW, fv.PAGE_WIDE)


def parse_count(c: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(text_or_empty(c), r"[\d,]+", 0), ",", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))


def parse_comment_count(c: Column) -> Column:
    return F.coalesce(
        F.regexp_extract(text_or_empty(c), r"(\d+)\s*条?评论", 1).try_cast("bigint"), F.lit(0)
    )


def platform_of(url: Column, hosts=None) -> Column:
    found = F.lit(None).cast("string")
    for name, host in reversed(fv.PLATFORM_HOSTS if hosts is None else hosts):
        found = F.when(url.contains(host), F.lit(name)).otherwise(found)
    return found
