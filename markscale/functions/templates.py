"""Prompt templates compiled into Column expressions, and chat messages."""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER_TEMPLATE = (
    "Answer the question using only the source text that is given. "
    "Write the answer in the language of the question.\n\n"
    "Source text:\n{text}\n\nQuestion:\n{problem}\n\nAnswer:"
)

JUDGE_TEMPLATE = (
    "Mark an exam paper. You see a question, the answer of a candidate, and the answer key. Write [Correct] if "
    "somebody who knows only the key would give the candidate full credit, else [Incorrect]; write nothing else. "
    "Wording, length and language of the answer do not matter. An answer that contradicts the key, or that adds "
    "what the key gives no ground for, gets no credit.\n\n"
    "Example\nQuestion: When does the scheme start?\nAnswer: It starts in March.\n"
    "Reference: The scheme starts on 1 March.\nVerdict: [Correct]\n\n"
    "Example\nQuestion: Who may apply?\nAnswer: Anyone may apply.\n"
    "Reference: Only registered firms may apply.\nVerdict: [Incorrect]\n\n"
    "Question: {question}\nAnswer: {prediction}\nReference: {reference}\nVerdict:"
)


def render(template: str, slots: Mapping[str, Column]) -> Column:
    """One concatenation of the template's literals and the slot columns.

    The template is taken apart here, so a slot value that contains braces is never expanded.
    Slots without a column, format specifications and attribute access raise ``ValueError``.
    """
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError(f"slot {{{name}}} has a format specification or conversion")
        if name not in slots:
            raise ValueError(f"no column for slot {{{name}}}; known slots: {sorted(slots)}")
        parts.append(slots[name])
    return F.concat(*parts) if parts else F.lit("")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(prompt: Column, system_prompt: str | Column | None = None) -> Column:
    """``array<struct<role, content>>``: the system message if there is one, then the user's.

    ``system_prompt`` is one text for all rows, or a column; rows where that is NULL or empty have no system message.
    """
    user = F.array(_message("user", prompt))
    if isinstance(system_prompt, Column):
        own = F.array(_message("system", system_prompt), _message("user", prompt))
        return F.when(F.coalesce(system_prompt, F.lit("")) != "", own).otherwise(user)
    return F.array(_message("system", F.lit(system_prompt)), _message("user", prompt)) if system_prompt else user
