"""Which left column goes with which right column, and which are keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from ..functions.names import find_column, normal_name

# Parts of a name that hint at a key.
KEY_HINTS = ("id", "key", "code", "number")


@dataclass(frozen=True)
class Alignment:
    keys: tuple[tuple[str, str], ...]
    values: tuple[tuple[str, str], ...]


def pairs(left: Sequence[str], right: Sequence[str], column_map: Mapping[str, str] | None = None) -> dict[str, str]:
    """Left column -> right column, in left order.  ``column_map`` goes from right names to left names."""
    mapped = {normal_name(new): old for old, new in (column_map or {}).items()}
    out = {}
    for column in left:
        wanted = mapped.get(normal_name(column), column)
        try:
            out[column] = find_column(wanted, right)
        except KeyError:
            continue
    return out


def choose_keys(matched: Mapping[str, str], configured: Sequence[str] = ()) -> list[str]:
    """Configured keys; else up to three matched columns that look like keys; else the first matched one."""
    if configured:
        return [find_column(k, list(matched)) for k in configured]
    hinted = [c for c in matched if any(h in c.lower() for h in KEY_HINTS)]
    return hinted[:3] or list(matched)[:1]


def align(
    left: Sequence[str],
    right: Sequence[str],
    keys: Sequence[str] = (),
    values: Sequence[str] = (),
    column_map: Mapping[str, str] | None = None,
    exclude: Sequence[str] = (),
) -> Alignment:
    """Resolve keys and value columns once; value columns follow the left schema's order."""
    matched = pairs(left, right, column_map)
    chosen = choose_keys(matched, keys)
    if not chosen:
        raise KeyError("no column of the left side has a partner on the right")
    dropped = {normal_name(e) for e in exclude}
    wanted = [find_column(v, left) for v in values] if values else [c for c in matched if c not in chosen]
    return Alignment(
        tuple((k, matched[k]) for k in chosen),
        tuple((v, matched[v]) for v in wanted if v in matched and v not in chosen and normal_name(v) not in dropped),
    )
