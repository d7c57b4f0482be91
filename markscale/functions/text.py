"""Unicode-aware string expressions with the spellings of Python's ``str``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's ``str.strip`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """``text`` without leading and trailing whitespace of any script."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_visible(text: Column) -> Column:
    """True when ``text`` holds any character other than whitespace."""
    return strip(text) != ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def python_float_text(value: Column) -> Column:
    """Spell a double as Python prints a float: ``0.5``, ``1e-05``, ``10000000.0``."""
    plain = F.abs(value).cast("string")
    pattern = r"^(\d+)\.(\d+)(?:E(-?\d+))?$"
    whole = F.regexp_extract(plain, pattern, 1)
    padded = F.concat(whole, F.regexp_extract(plain, pattern, 2))
    power = F.coalesce(F.regexp_extract(plain, pattern, 3).try_cast("int"), F.lit(0))
    parts = F.struct(
        F.regexp_replace(padded, r"^0+|0+$", "").alias("digits"),
        # How many digits stand before the decimal point; negative means zeros after it.
        (F.length(whole) + power - F.length(F.regexp_extract(padded, r"^(0*)", 1))).alias("point"),
    )

    def spell(number: Column) -> Column:
        digits, point = number["digits"], number["point"]
        count, exponent = F.length(digits), point - 1
        rest = F.substring(digits, F.lit(2), count)
        scientific = F.concat(
            F.substring(digits, 1, 1),
            F.when(count > 1, F.concat(F.lit("."), rest)).otherwise(F.lit("")),
            F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")),
            F.abs(exponent).cast("string"),
        )
        return (
            F.when(digits == "", F.lit("0.0"))
            .when((exponent < -4) | (exponent >= 16), scientific)
            .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= count, F.concat(digits, F.repeat(F.lit("0"), point - count), F.lit(".0")))
            .otherwise(
                F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, count))
            )
        )

    sign = F.when(value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(plain == "Infinity", F.concat(sign, F.lit("inf")))
        .when(value.isNotNull(), F.concat(sign, let(parts, spell)))
    )
