"""When do two cells differ?  Equal values in different clothes do not.

A cell is read as a number (currency signs, thousands separators and accounting
parentheses aside), else as a date in one of several formats, else as a yes/no
word, else as trimmed lower-case text without quotes around it.  Two cells are
compared by the first reading that both allow.

Cells whose texts are equal are settled first; only the others are parsed, and
each parse has a pattern before it, as failed parses are dear.  Columns that
are numbers already are never parsed as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, NumericType, StringType, TimestampNTZType, TimestampType

# What the readings accept.
CURRENCY_SIGNS = "$£€¥₪₹¢"
# Month and day come before the year, month first where both readings are dates; a time may follow slashes.
DAY_BEFORE_YEAR = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})((?<=/\d{4}) \d{1,2}:\d{1,2})?$"
YEAR_FIRST = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
YES_WORDS, NO_WORDS = ("true", "t", "yes"), ("false", "f", "no")


def is_number(kind: DataType) -> bool:
    return isinstance(kind, NumericType)


def is_time(kind: DataType) -> bool:
    return isinstance(kind, (TimestampType, TimestampNTZType, DateType))


def shown(c: Column, kind: DataType) -> Column:
    """The cell as report text; doubles without an exponent."""
    text = c.cast("string")
    if isinstance(kind, NumericType) and not isinstance(kind, DecimalType) and kind.typeName() in ("double", "float"):
        plain = F.regexp_replace(c.cast("decimal(38,17)").cast("string"), r"(\.\d*?[1-9])0+$|\.0+$", "$1")
        return F.when(text.contains("E") & (F.abs(c) < 1e20), F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".0")))).otherwise(text)
    return text


def as_number(c: Column, kind: DataType) -> Column:
    if is_number(kind):
        return c.cast("double")
    if not isinstance(kind, StringType):
        return F.lit(None).cast("double")
    t = F.regexp_replace(c, rf"\s*[{CURRENCY_SIGNS}]\s*", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(F.translate(t, ",", ""), r"^\(", "-"), r"\)$", ""))
    t = F.regexp_replace(t, r"(?<=\d)_(?=\d)", "")
    fits = t.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(nan|inf|infinity)$")
    return F.when(fits, t.try_cast("double"))


def as_time(c: Column, kind: DataType) -> Column:
    if is_time(kind):
        return c.cast("timestamp_ntz")
    if not isinstance(kind, StringType):
        return F.lit(None).cast("timestamp_ntz")
    # one canonical spelling and one parse for each order of month and day
    plain = F.regexp_replace(F.regexp_replace(c, DAY_BEFORE_YEAR, "$4-$1-$3$5"), YEAR_FIRST, "$1-$2-$3")
    month_first = F.when(plain.rlike(r"^\s*\d{1,4}-\d{1,2}-\d{1,2}"), F.trim(plain).try_cast("timestamp_ntz"))
    day_first = F.when(c.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$"), F.regexp_replace(c, DAY_BEFORE_YEAR, "$4-$3-$1").try_cast("timestamp_ntz"))
    return F.coalesce(month_first, day_first)


def as_yes_no(c: Column, kind: DataType) -> Column:
    """True or False for yes/no words; null for others, digits among them."""
    if is_number(kind) or is_time(kind):
        return F.lit(None).cast("boolean")
    word = F.lower(c.cast("string"))
    return F.when(word.isin(*YES_WORDS), True).when(word.isin(*NO_WORDS), False)


@dataclass(frozen=True)
class TextRules:
    ignore_case: bool = True
    ignore_spaces: bool = True


def as_text(c: Column, rules: TextRules = TextRules()) -> Column:
    t = c.cast("string")
    t = F.trim(t) if rules.ignore_spaces else t
    t = F.lower(t) if rules.ignore_case else t
    return F.btrim(t, F.lit("'\""))


#: Bits of a cell's state: it differs exactly; it differs beyond the tolerance.
UNEQUAL, APART = 1, 2


def cell_state(left: Column, left_kind: DataType, right: Column, right_kind: DataType, tolerance: float = 0.0, rules: TextRules = TextRules()) -> Column:
    """``UNEQUAL`` and ``APART`` added up, 0 where the cells agree; never null.  Null equals only null."""

    def numbers(a: Column, b: Column) -> Column:
        if tolerance <= 0:
            return (a != b).cast("int") * (UNEQUAL + APART)
        return (a != b).cast("int") * UNEQUAL + (F.abs(a - b) > F.lit(float(tolerance))).cast("int") * APART

    both = F.lit(UNEQUAL + APART)
    apart = lambda a, b: (a != b).cast("int") * both
    out = F.when(left.isNull() & right.isNull(), 0).when(left.isNull() | right.isNull(), both)
    if is_number(left_kind) and is_number(right_kind):
        return out.otherwise(numbers(left.cast("double"), right.cast("double")))
    if left_kind == right_kind or isinstance(left_kind, StringType) and isinstance(right_kind, StringType):
        out = out.when(left == right, 0)
    # a reading that either cell lacks gives null, so each is named once and the next one is tried
    return out.otherwise(
        F.coalesce(
            numbers(as_number(left, left_kind), as_number(right, right_kind)),
            apart(as_time(left, left_kind), as_time(right, right_kind)),
            apart(as_yes_no(left, left_kind), as_yes_no(right, right_kind)),
            apart(as_text(left, rules), as_text(right, rules)),
        )
    )


def cells_differ(left: Column, left_kind: DataType, right: Column, right_kind: DataType, tolerance: float = 0.0, rules: TextRules = TextRules()) -> Column:
    """True where the cells differ (beyond the tolerance); never null."""
    return cell_state(left, left_kind, right, right_kind, tolerance, rules).bitwiseAND(APART) > 0


__all__ = ["APART", "BooleanType", "TextRules", "UNEQUAL", "as_number", "as_text", "as_time", "as_yes_no", "cell_state", "cells_differ", "is_number", "is_time", "shown"]
