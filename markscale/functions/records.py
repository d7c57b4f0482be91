"""Open-schema rows: a JSON object held as ``map<string, string>`` of the JSON text of every value.

The map keeps unknown keys, their order, and the difference between an absent key and a JSON
null. A value that is not edited keeps its worth: ``1.0`` and ``-0.0`` stay floats, and whole numbers keep
all of their digits. Edits rely on ``spark.sql.mapKeyDedupPolicy = LAST_WIN`` (see ``session.configure``).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscale.functions.text import python_float_text

RECORD_TYPE = T.MapType(T.StringType(), T.StringType())
PRINTED_TYPE = T.StructType([T.StructField("record", RECORD_TYPE), T.StructField("printed", RECORD_TYPE)])

#: Texts that are Python objects at once, and their bytes; a longer text is alone.
PIECE_ROWS, PIECE_BYTES = 512, 1 << 20

_encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_encode_ascii = json.JSONEncoder(separators=(",", ":")).encode


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    return F.to_json(text.cast("variant"))


def _value_text(value) -> str:
    if isinstance(value, float) and value in (float("inf"), float("-inf")):
        return "1e999" if value > 0 else "-1e999"
    text = _encode(value)
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a surrogate pair has no UTF-8
        text = _encode_ascii(value)
    return text


def pieces(texts: pa.Array, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """A string array in slices of at most ``rows`` texts and ``size`` bytes, or of one longer text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(texts):
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield texts.slice(at, end - at)
        at, before = end, ends[end - 1]


def _items(line: str | None) -> list[tuple[str, object]] | None:
    record = json.loads(line.strip()) if line else None
    if isinstance(record, dict):
        return [(key.encode("utf-8", "replace").decode(), value) for key, value in record.items()]
    return None


def _pairs(line: str | None) -> list[tuple[str, str]] | None:
    try:
        items = _items(line)
        return None if items is None else [(key, _value_text(value)) for key, value in items]
    except (ValueError, RecursionError):
        return None


def _printed_pairs(line: str | None, names: tuple[str, ...]) -> dict | None:
    try:
        items = _items(line)
        if items is None:
            return None
        printed = [(key, str(value)) for key, value in items if key in names and isinstance(value, (list, dict))]
        return {"record": [(key, _value_text(value)) for key, value in items], "printed": printed}
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(RECORD_TYPE)
def record_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A line that is one JSON object as a record, anything else as NULL. Every line is parsed once.

    Values keep their kind and worth: a quoted number stays a string, ``1.0`` a float, a whole number has all of its digits and the
    token ``NaN`` stays what it is. A repeated key has its last value.
    """
    sys.set_int_max_str_digits(0)
    for batch in batches:
        for lines in pieces(batch):
            yield pa.array([_pairs(line) for line in lines.to_pylist()], pa.map_(pa.string(), pa.string()))


def record_and_printed(*names: str):
    """Like :func:`record_of`, with the lists and objects under ``names`` as Python prints them beside the record.

    A function of its own for these texts would be one more Python worker per field on every busy core.
    """
    texts = pa.map_(pa.string(), pa.string())

    def record_with_printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sys.set_int_max_str_digits(0)
        for batch in batches:
            for lines in pieces(batch):
                rows = [_printed_pairs(line, names) for line in lines.to_pylist()]
                yield pa.array(rows, pa.struct([("record", texts), ("printed", texts)]))

    return F.arrow_udf(record_with_printed, PRINTED_TYPE)


def object_text(record: Column) -> Column:
    """The row as one JSON object."""
    pairs = F.transform(F.map_entries(record), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def has_key(record: Column, key: str) -> Column:
    return F.map_contains_key(record, key)


def is_text(record: Column, key: str) -> Column:
    return F.coalesce(record[key].startswith('"'), F.lit(False))


def string_of(value: Column) -> Column:
    """The string that a JSON string stands for."""
    return F.try_variant_get(F.try_parse_json(value), "$", "string")


def text_value(record: Column, key: str) -> Column:
    """The value of ``key`` when it is a JSON string, else NULL."""
    return F.when(is_text(record, key), string_of(record[key]))


def drop_keys(record: Column, *keys: str) -> Column:
    return F.map_filter(record, lambda k, _: ~k.isin(*keys))


def set_key(record: Column, key: str, value: Column) -> Column:
    """Overwrite ``key`` where it stands, or append it; NULL is written as a JSON null."""
    text = F.coalesce(F.to_json(value.cast("variant")), F.lit("null"))
    return F.map_concat(record, F.create_map(F.lit(key), text))


def move_key(record: Column, old: str, new: str) -> Column:
    """The value of ``old`` as it stands under ``new``, at the end."""
    return F.map_concat(drop_keys(record, old), F.create_map(F.lit(new), record[old]))


@F.arrow_udf(T.StringType())
def python_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Lists and objects as Python prints them."""
    for batch in batches:
        for values in pieces(batch):
            yield pa.array([None if v is None else str(json.loads(v)) for v in values.to_pylist()], pa.string())


def spelled(
    record: Column, key: str, *, absent: str | None, null: str | None, nested: bool = True, printed: Column | None = None
) -> Column:
    """A value as Python's ``str`` spells it. ``nested=False`` leaves lists and objects NULL.

    ``printed`` is what :func:`record_and_printed` gave beside the record for this key; without it, lists and objects are read once more.
    """
    value = record[key]
    whole = F.when(value == "-0", F.lit("0")).otherwise(value)
    number = F.when(value.rlike(r"^-?\d+$"), whole).otherwise(python_float_text(value.try_cast("double")))
    text = (
        F.when(value.isNull(), F.lit(absent).cast("string"))
        .when(value == "null", F.lit(null).cast("string"))
        .when(value.startswith('"'), string_of(value))
        .when(value == "true", F.lit("True"))
        .when(value == "false", F.lit("False"))
        .when(~is_nested(value), number)
    )
    if not nested:
        return text
    return F.coalesce(text, python_text(F.when(is_nested(value), value)) if printed is None else printed[key])


def is_nested(value: Column) -> Column:
    return value.startswith("[") | value.startswith("{")
