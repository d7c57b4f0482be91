"""Column expressions that clean tags and read verdicts, ids and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscale.functions.text import strip

UNKNOWN = "unknown"

# Spellings of the two language tags, and the tags an id may start with.
CHINESE_TAGS = ("zh", "zh-cn")
ENGLISH_TAGS = ("en-us", "en-gb")
ID_LANGUAGES = ("en", "cn")

# The two digits of any script that end an id, and the spellings of a number.
_TASK = r"(?U)^\d{2}\z"
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
_INFINITE = r"(?i)inf"


def canonical_language(tag: Column, lowercase: bool = True) -> Column:
    """Map regional spellings to ``cn`` and ``en``; keep any other tag as stripped."""
    clean = strip(tag)
    if lowercase:
        clean = F.lower(clean)
    return (
        F.when(clean.isin(*CHINESE_TAGS), F.lit("cn"))
        .when(clean.isin(*ENGLISH_TAGS), F.lit("en"))
        .otherwise(clean)
    )


def verdict_label(verdict: Column) -> Column:
    """The last bracketed word if it ends the verdict, else ``unknown``."""
    text = strip(verdict)
    tail = F.substring_index(text, "[", -1)
    word = F.substring(tail, F.lit(1), F.length(tail) - 1)
    bracketed = text.endswith("]") & text.contains("[") & (word != "") & ~word.contains("]")
    return F.when(bracketed, F.lower(strip(word))).otherwise(F.lit(UNKNOWN))


def is_correct(label: Column) -> Column:
    return F.coalesce(label == "correct", F.lit(False))


def language_from_id(item_id: Column) -> Column:
    head = F.substring(F.lower(strip(item_id)), 1, 2)
    return F.when(head.isin(*ID_LANGUAGES), head).otherwise(F.lit(UNKNOWN))


def task_from_id(item_id: Column) -> Column:
    tail = F.substring(strip(item_id), -2, 2)
    return F.when(tail.rlike(_TASK), tail).otherwise(F.lit(UNKNOWN))


def score_from_text(text: Column) -> Column:
    """A number written as text, or NULL; the word ``nan`` and overflows are NULL too."""
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    overflow = (F.abs(number) == F.lit(float("inf"))) & ~text.rlike(_INFINITE)
    return F.when(~overflow, F.nanvl(number, F.lit(None).cast("double")))


def score_from_variant(value: Column) -> Column:
    """A JSON value as a number: booleans count 1 or 0, lists and objects are NULL."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(kind == "STRING", score_from_text(F.try_variant_get(value, "$", "string")))
        .when(
            ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT") & (kind != "VOID"),
            F.nanvl(F.try_variant_get(value, "$", "double"), F.lit(None).cast("double")),
        )
    )


def coerce_score(value: Column, data_type: T.DataType) -> Column:
    """Numeric coercion of a score column of any type that a scan may give it."""
    if isinstance(data_type, T.VariantType):
        return score_from_variant(value)
    if isinstance(data_type, T.StringType):
        return score_from_text(value)
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.lit(None).cast("double")
