"""Pure functions on names: columns, tables, datasets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

#: Endings that a dataset's file name may carry.
FILE_ENDINGS = (".csv", ".xlsx", ".xls", ".parquet")


def normal_name(column: str) -> str:
    """snake_case form of a column name: what isn't a word character becomes one underscore."""
    return re.sub(r"[\W_]+", "_", column.lower()).strip("_")


def normal_names(columns: Sequence[str]) -> list[str]:
    """Normal forms in order; a repeated one gets _2, _3, and so on."""
    taken: set[str] = set()
    out = []
    for column in columns:
        stem = name = normal_name(column) or "column"
        n = 1
        while name in taken:
            n += 1
            name = f"{stem}_{n}"
        taken.add(name)
        out.append(name)
    return out


def rename_all(df):
    """The frame under normal names."""
    return df.toDF(*normal_names(df.columns))


def rename_report(columns: Sequence[str]) -> dict:
    """How many names change, and which share a normal form."""
    plain = [normal_name(c) for c in columns]
    return {
        "total": len(columns),
        "changed": sum(a != b for a, b in zip(columns, plain)),
        "mapping": dict(zip(columns, normal_names(columns))),
        "conflicts": sorted({p for p in plain if plain.count(p) > 1}),
    }


def is_normal(columns: Iterable[str]) -> bool:
    return all(c == normal_name(c) for c in columns)


def common_names(left: Iterable[str], right: Iterable[str]) -> list[str]:
    """Normal names that both sides have, sorted."""
    return sorted({normal_name(c) for c in left} & {normal_name(c) for c in right})


def find_column(wanted: str, columns: Sequence[str]) -> str:
    """The column meant by ``wanted``: spelt so, spelt normally, or with an equal normal form."""
    if wanted in columns:
        return wanted
    plain = normal_name(wanted)
    if plain in columns:
        return plain
    for column in columns:
        if normal_name(column) == plain:
            return column
    raise KeyError(f"no column {wanted!r}; there are {', '.join(columns)}")


def table_name(stem: str) -> str:
    """A file's stem as an SQL table name."""
    name = re.sub(r"_+", "_", re.sub(r"[ \-().\/\\]", "_", stem)).strip("_")
    if not name:
        return "table_unnamed"
    return name if name[0].isalpha() else f"t_{name}"


def friendly_name(name: str) -> str:
    """A title for people: ``sales_2024_q1`` is ``Sales 2024 Q1``; acronyms stay."""
    for ending in FILE_ENDINGS:
        name = name.replace(ending, "")

    def title(word: str) -> str:
        if len(word) > 1 and word.isupper():
            return word
        if any(c.isdigit() for c in word):
            return word[0].upper() + word[1:]
        return word.capitalize()

    return " ".join(map(title, re.split(r"[_\-\s]+", name.strip("_- ")))) if name.strip("_- ") else ""


def pandas_spelling(columns: Sequence[str]) -> list[str]:
    """Repeated headers as ``a``, ``a.1``, ``a.2``."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        n = seen.get(c, 0)
        seen[c] = n + 1
        out.append(f"{c}.{n}" if n else c)
    return out
