"""Normalisers and converters as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that normalisation replaces or drops.
WIDE_SPACES = "\u00a0\u202f\u2009\u200a"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
DASHES = "\u2013\u2014\u2010"
SINGLE_QUOTES = "`\u00b4\u2018\u2019"
DOUBLE_QUOTES = "\u201c\u201d"
# UTF-8 text that was read as Latin-1, and what was meant.
MOJIBAKE = {
    "Ã¢": "â",
    "Ã©": "é",
    "Ã¨": "è",
    "Ã´": "ô",
    "Ã ": "à",
    "Ã§": "ç",
    "Ã±": "ñ",
    "â€™": "'",
    'â€"': "—",
    "â€œ": '"',
    "â€\x9d": '"',
}
TRUE_WORDS, FALSE_WORDS = ("t", "true", "1", "yes"), ("f", "false", "0", "no")

_SPACES = r"(?U)\s+"


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    def plain(x):
        return x if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(plain)


def _outside_ascii(c: Column, udf: Callable[[Column], Column]) -> Column:
    """``udf`` sees only texts that hold a character beyond ASCII; the others are null to it."""
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, udf(F.when(other, c))).otherwise(c)


def strip_hierarchy(c) -> Column:
    """What follows the last colon, trimmed; a text without a colon stays as it is."""
    t = _text(c)
    return F.when(F.instr(t, ":") == 0, t).otherwise(F.trim(F.element_at(F.split(t, ":"), -1)))


def collapse_spaces(c) -> Column:
    return F.trim(F.regexp_replace(_text(c), _SPACES, " "))


def unicode_clean(c) -> Column:
    """Without accents and zero-width characters, quotes and dashes plain, spaces collapsed."""
    t = _outside_ascii(_text(c), _without_marks)
    t = F.regexp_replace(t, "[\u200b-\u200d\u2060\ufeff]", "")
    return collapse_spaces(F.translate(t, "\u201c\u201d\u2018\u2019\u2013\u2014", "\"\"''--"))


def currency_to_decimal(c) -> Column:
    """DECIMAL(18,2) of a dollar amount; parentheses mean less than zero; null if it is none."""
    t = F.trim(F.translate(_text(c), "$,", ""))
    return F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_extract(t, r"^\((.*)\)$", 1))).otherwise(t).try_cast("decimal(18,2)")


def currency_to_float(c) -> Column:
    t = F.trim(_text(c))
    bare = F.translate(F.regexp_replace(t, r"^[() ]+|[() ]+$", ""), "$,", "")
    number = F.when(~bare.rlike("(?i)[0-9.][df]$"), bare).try_cast("double")
    return F.when(t.rlike(r"^\(.*\)$"), -number).otherwise(number)


def boolean_t_f(c, extra: bool = False, trimmed: bool = False, keep_yes_no: bool = False) -> Column:
    """``t`` or ``f``, else null.  ``extra`` also takes y and n, ``trimmed`` ignores
    spaces around, ``keep_yes_no`` lets yes and no through as they are."""
    t = F.lower(_text(c))
    t = F.trim(t) if trimmed else t
    yes, no = [*TRUE_WORDS, *(["y"] if extra else [])], [*FALSE_WORDS, *(["n"] if extra else [])]
    out = F.when(t.isin("yes", "no"), t) if keep_yes_no else F.when(F.lit(False), t)
    return out.when(t.isin(yes), "t").when(t.isin(no), "f")


def normalize_boolean(c) -> Column:
    return boolean_t_f(c, extra=True, trimmed=True)


def safe_cast(c, kind: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast(kind)


def normalize_text(c, fold_curly_quotes: bool = True) -> Column:
    """Composed, with plain spaces, quotes and dashes, nothing invisible, spaces collapsed; empty is null."""
    t = _outside_ascii(_text(c), _nfc)
    drop = "\u00ad" + ZERO_WIDTH
    change = WIDE_SPACES + SINGLE_QUOTES[:2] + DASHES
    to = " " * len(WIDE_SPACES) + "''" + "-" * len(DASHES)
    if fold_curly_quotes:
        change, to = change + SINGLE_QUOTES[2:] + DOUBLE_QUOTES, to + "''" + '""'
    t = F.translate(t, change + drop, to)
    return F.nullif(collapse_spaces(t), F.lit(""))


def normalize_for_display(c) -> Column:
    """Composed and with broken encodings mended; null is the empty text."""
    t = _outside_ascii(F.translate(F.coalesce(_text(c), F.lit("")), "\u00a0", " "), _nfc)
    for bad, good in MOJIBAKE.items():
        t = F.replace(t, F.lit(bad), F.lit(good))
    return t


def normalized_equal(a, b) -> Column:
    """Equality after non-breaking spaces, curly quotes and runs of spaces are made plain."""

    def plain(c):
        return F.trim(F.regexp_replace(F.translate(_text(c), "\u00a0\u2019\u201c\u201d", " '\"\""), r"\s+", " "))

    return plain(a) == plain(b)


def normalize_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every string column (or those named) through :func:`normalize_text`."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    return df.withColumns({n: normalize_text(F.col(f"`{n}`")) for n in names if n in df.columns}) if names else df


#: Functions that configurations name.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "strip_hierarchy": strip_hierarchy,
    "unicode_clean": unicode_clean,
    "collapse_spaces": collapse_spaces,
    "upper": lambda c: F.upper(_text(c)),
    "lower": lambda c: F.lower(_text(c)),
    "trim": lambda c: F.trim(_text(c)),
    "numeric_round": lambda c: F.round(c.try_cast("double"), 2),
    "text": normalize_text,
}
CONVERTERS: dict[str, Callable[[Column], Column]] = {
    "currency_usd": currency_to_decimal,
    "currency_to_float": currency_to_float,
    "boolean_t_f": boolean_t_f,
    "boolean": normalize_boolean,
}
