"""Query registry and SQL fragments shared by the comparison texts."""

from .. import fixed_values as fv

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


SPACE = f"[{fv.TEXT_SPACE}]"
PAGE_SPACE = f"[{fv.PAGE_SPACE}]"


def entities(x: str) -> str:
    """The entities that occur in the stored pages, also without their semicolon, the ampersand last."""
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def no_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def visible(x: str) -> str:
    return f"regexp_replace({no_tags(x)}, '[{fv.ZERO_WIDTH}]', '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({visible(x)}, '{SPACE}+', ' ', 'g'), ' ')"


def preview(x: str, n: int = fv.PREVIEW_CHARS) -> str:
    return (
        f"CASE WHEN length({x}) > {n} THEN regexp_replace(substring({x}, 1, {n}), '{SPACE}+$', '') || '...' ELSE {x} END"
    )


def legacy(x: str, n: int = fv.PREVIEW_CHARS) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END"


def model_input(q: str, p: str) -> str:
    return (
        f"CASE WHEN {q} = '' THEN {p} WHEN {p} = '' THEN '{fv.QUESTION_PREFIX}' || {q} "
        f"ELSE '{fv.QUESTION_PREFIX}' || {q} || chr(10) || '{fv.PREVIEW_PREFIX}' || {p} END"
    )


def round2(x: str) -> str:
    """Two-decimal rounding on the exact binary value."""
    y = f"(({x}) * 100.0::DOUBLE)"
    high = f"((({x}) * 134217729.0::DOUBLE) - ((({x}) * 134217729.0::DOUBLE) - ({x})))"
    error = f"(({high} * 100.0::DOUBLE - {y}) + (({x}) - {high}) * 100.0::DOUBLE)"
    f = f"floor({y})"
    up = (
        f"(({y} - {f}) > 0.5::DOUBLE OR (({y} - {f}) = 0.5::DOUBLE AND ({error} > 0 OR ({error} = 0 AND {f} % 2 = 1))))"
    )
    return f"((CASE WHEN {up} THEN {f} + 1 ELSE {f} END) / 100.0::DOUBLE)"


def key60(text: str) -> str:
    return f"('0x' || md5({text})[1:15])::BIGINT"


RAW = f"""raw AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS question, text AS answer_full, {legacy('text')} AS answer_truncated,
         source AS author, n_chars AS votes, 'zhihu' AS platform, 'doc://' || doc_id AS url FROM documents)"""

CLEAN = f"""{RAW}, c0 AS (
  SELECT *, {clean('question')} AS q, {clean('answer_full')} AS a, {clean('answer_truncated')} AS old,
         {no_tags('answer_full')} <> answer_full AS had_html,
         {clean('answer_full')} <> {visible('answer_full')} AS spaced FROM raw),
c1 AS (SELECT *, {preview('a')} AS p, length(a) > {fv.PREVIEW_CHARS} AS cut,
         regexp_matches(a, '(?i){"|".join(fv.CONTACT_PHRASES)}') AS contact FROM c0)"""

QA = """qa AS (
  SELECT conv_id, turn, text AS question, answer_full FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer_full, lead(turn) OVER w AS next_turn
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1)"""

LOW_REASON, AI_REASON = (t["reason_options"][0] for t in fv.TASKS)
GOLD = f"""gold AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS sample_id, quality = 0 AS low, toxic = 1 AS ai,
         CASE WHEN quality = 0 THEN '{LOW_REASON}' ELSE '' END AS low_reason,
         CASE WHEN toxic = 1 THEN '{AI_REASON}' ELSE '' END AS ai_reason FROM labels)"""
