"""Clean-up of open-schema rows: ``DataFrame`` with a ``record`` column in, the same out.

Everything here is a narrow projection or filter on one row, so a scan, these steps and a sink run
as a single stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscale.functions import records as R
from markscale.functions.fields import canonical_language
from markscale.functions.templates import ANSWER_TEMPLATE, render
from markscale.functions.text import strip

# Field names of the rows.
GENERATION_FIELDS = ("model", "answer")
LANGUAGE = "language"
LEGACY_LANGUAGE = ",language"
ID = "id"


def drop_generation_fields(df: DataFrame, fields: tuple[str, ...] = GENERATION_FIELDS) -> DataFrame:
    """Remove what an earlier generation run added; rows without the fields stay as they are."""
    return df.withColumn("record", R.drop_keys(F.col("record"), *fields))


def drop_missing_language(df: DataFrame) -> DataFrame:
    """Keep rows whose language tag, under its present or legacy key, is a string."""
    record = F.col("record")
    current = R.is_text(record, LANGUAGE)
    legacy = R.is_text(record, LEGACY_LANGUAGE)
    return df.filter(F.when(R.has_key(record, LANGUAGE), current).otherwise(legacy))


def rename_legacy_language(df: DataFrame) -> DataFrame:
    """Move ``,language`` to ``language`` in rows that have only the former."""
    record = F.col("record")
    moved = R.move_key(record, LEGACY_LANGUAGE, LANGUAGE)
    only_legacy = R.has_key(record, LEGACY_LANGUAGE) & ~R.has_key(record, LANGUAGE)
    return df.withColumn("record", F.when(only_legacy, moved).otherwise(record))


def canonicalise_language(df: DataFrame, *, lowercase: bool = True) -> DataFrame:
    """Rewrite string tags in their canonical spelling; other values stay untouched."""
    record = F.col("record")
    tag = canonical_language(R.text_value(record, LANGUAGE), lowercase)
    return df.withColumn(
        "record",
        F.when(R.is_text(record, LANGUAGE), R.set_key(record, LANGUAGE, tag)).otherwise(record),
    )


def stringify_id(df: DataFrame, *, null_id: str = "None") -> DataFrame:
    """Turn scalar ids into stripped strings; lists, objects and absent ids stay untouched.

    A JSON null becomes the text ``None``, or stays null under ``null_id="keep"``.
    """
    if null_id not in ("None", "keep"):
        raise ValueError("null_id is 'None' or 'keep'")
    record = F.col("record")
    skipped = ~R.has_key(record, ID) | R.is_nested(record[ID])
    if null_id == "keep":
        skipped = skipped | (record[ID] == "null")
    text = strip(R.spelled(record, ID, absent=None, null="None", nested=False))
    return df.withColumn("record", F.when(skipped, record).otherwise(R.set_key(record, ID, text)))


def normalize(
    df: DataFrame,
    *,
    drop_missing: bool = False,
    lowercase_language: bool = True,
    null_id: str = "None",
) -> DataFrame:
    """Legacy key, language tag and id of every row in their standard form."""
    if drop_missing:
        df = drop_missing_language(df)
    df = rename_legacy_language(df)
    df = canonicalise_language(df, lowercase=lowercase_language)
    return stringify_id(df, null_id=null_id)


def normalize_columns(df: DataFrame, *, drop_missing: bool = False, lowercase_language: bool = True) -> DataFrame:
    """The same clean-up for staged rows with typed string columns.

    A column cannot tell an absent key from a null, so a null tag takes the legacy value, and a
    null id stays null.
    """
    tag = F.col(LANGUAGE) if LANGUAGE in df.columns else F.lit(None).cast("string")
    if LEGACY_LANGUAGE in df.columns:
        tag = F.coalesce(tag, F.col(f"`{LEGACY_LANGUAGE}`"))
    if drop_missing:
        df = df.filter(tag.isNotNull())
    out = df.withColumn(LANGUAGE, canonical_language(tag, lowercase_language)).drop(LEGACY_LANGUAGE)
    return out.withColumn(ID, strip(F.col(ID).cast("string"))) if ID in df.columns else out


def render_prompt(
    df: DataFrame,
    template: str = ANSWER_TEMPLATE,
    *,
    text_field: str = "text",
    question_field: str = "question",
    target_field: str = "input",
    drop_source_fields: bool = True,
    printed: Column | None = None,
) -> DataFrame:
    """Set ``target_field`` to the rendered prompt and drop the fields it was made from.

    An absent field renders as nothing, a JSON null as ``None``. ``printed`` as in ``records.spelled``, for both fields.
    """
    record = F.col("record")
    prompt = render(
        template,
        {
            "text": R.spelled(record, text_field, absent="", null="None", printed=printed),
            "problem": R.spelled(record, question_field, absent="", null="None", printed=printed),
        },
    )
    edited = R.set_key(record, target_field, prompt)
    dropped = [f for f in (text_field, question_field) if f != target_field]
    if drop_source_fields and dropped:
        edited = R.drop_keys(edited, *dropped)
    return df.withColumn("record", edited)


def extend_records(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Add or overwrite ``fields`` in every record and keep all its other keys."""
    record = F.col("record")
    for key, value in fields.items():
        record = R.set_key(record, key, value)
    return df.withColumn("record", record)
