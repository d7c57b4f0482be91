"""Prompt columns of typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscale.functions.templates import ANSWER_TEMPLATE, JUDGE_TEMPLATE, render


def or_none(value: Column) -> Column:
    """What a missing value looks like inside an answer prompt."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def answer_prompt(text: Column, question: Column, template: str = ANSWER_TEMPLATE) -> Column:
    return render(template, {"text": or_none(text), "problem": or_none(question)})


def judge_prompt(
    question: Column, prediction: Column, reference: Column, template: str = JUDGE_TEMPLATE
) -> Column:
    return render(
        template,
        {
            "question": or_empty(question),
            "prediction": or_empty(prediction),
            "reference": or_empty(reference),
        },
    )


def with_prompt(
    df: DataFrame,
    template: str = ANSWER_TEMPLATE,
    *,
    text_col: str = "text",
    question_col: str = "question",
    target_col: str = "input",
    drop_source_cols: bool = True,
) -> DataFrame:
    """Typed form of the prompt step: NULL text or question renders as nothing."""
    prompt = render(
        template, {"text": or_empty(F.col(text_col)), "problem": or_empty(F.col(question_col))}
    )
    out = df.withColumn(target_col, prompt)
    if drop_source_cols:
        out = out.drop(*(name for name in (text_col, question_col) if name != target_col))
    return out
