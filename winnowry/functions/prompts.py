"""Prompts: a constant head, the capped text, a constant tail."""

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv


def label_prompt_head(tasks=None) -> str:
    tasks = fv.TASKS if tasks is None else tasks
    lines = [
        fv.LABEL_TASK_LINE.format(
            task_id=t["task_id"], description=t["description"], reasons="、".join(t["reason_options"])
        )
        for t in tasks
    ]
    schema = [fv.LABEL_SCHEMA_LINE.format(task_id=t["task_id"]) for t in tasks]
    return fv.LABEL_PROMPT_HEAD.format(tasks="\n".join(lines), schema=",\n".join(schema))


def scoring_prompt_head(task_ids) -> str:
    lines = [fv.SCORING_TASK_LINE.format(task_id=t, description=fv.SCORING_DESCRIPTIONS[t]) for t in task_ids]
    schema = [fv.SCORING_SCHEMA_LINE.format(task_id=t) for t in task_ids]
    return fv.SCORING_PROMPT_HEAD.format(tasks="\n".join(lines), schema=",\n".join(schema))


def build_label_prompt(text: Column, tasks=None, n: int = fv.LABEL_CHARS) -> Column:
    return F.concat(F.lit(label_prompt_head(tasks)), F.substring(text, 1, n), F.lit("\n"))


def effective_task_ids(task_ids: Column) -> Column:
    """A missing or empty request means every task."""
    every = F.array(*[F.lit(t) for t in fv.TASK_IDS])
    return F.when(F.coalesce(F.size(task_ids), F.lit(0)) > 0, task_ids).otherwise(every)


def build_service_prompt(text: Column, task_ids: Column, n: int = fv.LABEL_CHARS) -> Column:
    """The prompt for the requested tasks, in the requested order. Unknown tasks give null."""
    asked = effective_task_ids(task_ids)
    line, schema = (
        F.create_map(*[x for t in fv.TASK_IDS for x in (F.lit(t), F.lit(make(t)))])
        for make in (
            lambda t: fv.SCORING_TASK_LINE.format(task_id=t, description=fv.SCORING_DESCRIPTIONS[t]),
            lambda t: fv.SCORING_SCHEMA_LINE.format(task_id=t),
        )
    )
    before, between, after = fv.SCORING_PROMPT_HEAD.format(tasks="\0", schema="\0").split("\0")
    known = F.forall(asked, lambda t: t.isin(fv.TASK_IDS))
    lookup = lambda m: F.transform(asked, lambda t: F.try_element_at(m, t))
    return F.when(
        known,
        F.concat(
            F.lit(before), F.array_join(lookup(line), "\n"),
            F.lit(between), F.array_join(lookup(schema), ",\n"),
            F.lit(after), F.substring(text, 1, n), F.lit("\n"),
        ),
    )


def build_inference_prompt(text: Column, task_id: str, n: int = fv.LABEL_CHARS) -> Column:
    return F.concat(
        F.lit(fv.SINGLE_PROMPT_HEAD.format(task_id=task_id)), F.substring(text, 1, n), F.lit(fv.PROMPT_TAIL)
    )


def build_sft_prompt(text: Column, task_id: str, n: int = fv.TUNING_CHARS) -> Column:
    description = next(t["description"] for t in fv.TASKS if t["task_id"] == task_id)
    head = fv.TUNING_PROMPT_HEAD.format(task_id=task_id, description=description)
    return F.concat(F.lit(head), F.substring(text, 1, n), F.lit(fv.PROMPT_TAIL))


def sft_answer(label: Column, end_token: str) -> Column:
    return F.when(label, fv.TUNING_ANSWERS[True] + end_token).otherwise(fv.TUNING_ANSWERS[False] + end_token)
