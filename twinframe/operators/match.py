"""Matching columns of two tables and turning the matches into a configuration.

The matchers work on names and small statistics, on the driver; the statistics are aggregated in the executors.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import common_names, normal_name, normal_names
from .keys import KeyCheck, KeyValidationError, check_key
from .profile import inferred_types, patterns, profile

# Names that mean the same, squeezed to letters and digits.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "from": ("author",),
    "fromemail": ("authoremail",),
    "emailaddress": ("authoremail", "recipientemail"),
    "hasattachments": ("isattachmentincluded",),
    "internalid": ("messageid", "transactionid"),
    "isincoming": ("incoming",),
    "modificationdate": ("lastmodifieddate",),
    "datecreated": ("messagedate", "createdat"),
    "subject": ("emailsubject",),
    "recipient": ("recipientemail",),
}
# Parts of a confidence.
EQUAL_NAME, PART_OF_NAME, SYNONYM, SAME_TYPE, LEAST_CONFIDENCE = 0.95, 0.8, 0.85, 0.2, 0.3


@dataclass(frozen=True)
class Match:
    left_column: str
    right_column: str
    confidence: float
    reason: str


def _squeezed(name: str) -> str:
    return name.lower().replace(" ", "").replace("_", "")


def _synonyms(a: str, b: str) -> int:
    """How many groups of synonyms tie the two names."""
    ties = 0
    for word, others in SYNONYMS.items():
        here, there = (a, b) if word in a else (b, a)
        ties += word in here and any(o in there for o in others)
    return ties


def confidence(left: str, right: str, left_type: str | None = None, right_type: str | None = None) -> float:
    a, b = _squeezed(left), _squeezed(right)
    score = EQUAL_NAME if a == b else PART_OF_NAME if a in b or b in a else 0.0
    score += SYNONYM * _synonyms(a, b)
    score += SAME_TYPE if left_type == right_type else 0.0
    return min(1.0, score)


def reason(score: float) -> str:
    return "exact_name_match" if score >= 0.9 else "partial_name_match + data_type" if score >= 0.7 else "data_type_similarity"


def match_columns(left: Mapping[str, str], right: Mapping[str, str]) -> list[Match]:
    """The best partner of every left column (``name -> type``), best first; ties go to the first right column."""
    out = []
    for a, a_type in left.items():
        scored = [(confidence(a, b, a_type, b_type), -i, b) for i, (b, b_type) in enumerate(right.items())]
        if scored and (best := max(scored))[0] > LEAST_CONFIDENCE:
            out.append(Match(a, best[2], best[0], reason(best[0])))
    return sorted(out, key=lambda m: -m.confidence)


def resolve(matches: Sequence[Match], keys: Sequence[str] = ()) -> list[Match]:
    """One left column for each right column: keys before others, then confidence, then the earlier one."""
    chosen: dict[str, Match] = {}
    for m in matches:
        old = chosen.get(m.right_column)
        if old is None:
            chosen[m.right_column] = m
            continue
        new_key, old_key = m.left_column in keys, old.left_column in keys
        better = new_key if new_key != old_key else m.confidence >= old.confidence if new_key else m.confidence > old.confidence
        if better:
            chosen[m.right_column] = m
    return [m for m in matches if chosen.get(m.right_column) is m]


@dataclass(frozen=True)
class ColumnFacts:
    """What the richer matcher knows of a column."""

    data_type: str
    pattern: str | None = None
    unique_share: float | None = None
    null_percent: float | None = None
    values: frozenset[str] = frozenset()


def smart_match(left: Mapping[str, ColumnFacts], right: Mapping[str, ColumnFacts], least: float = 0.5) -> dict:
    """Each left column's best partner by name, pattern, statistics, shared values or similar spelling.

    Equal names score 1.  The result lists matches and what is left over on
    either side, is the same on every run, and survives JSON.
    """
    matches, used = [], set()
    for a, x in left.items():
        best: tuple[float, str, str] | None = None
        for b, y in right.items():
            if b in used:
                continue
            if normal_name(a) == normal_name(b):
                scores = {"exact": 1.0}
            else:
                scores = {"fuzzy": 0.9 * SequenceMatcher(None, normal_name(a), normal_name(b)).ratio()}
                if x.pattern and x.pattern == y.pattern:
                    scores["pattern"] = 0.8
                if x.values and y.values:
                    scores["value_overlap"] = 0.95 * len(x.values & y.values) / min(len(x.values), len(y.values))
                if x.data_type == y.data_type and None not in (x.unique_share, y.unique_share, x.null_percent, y.null_percent):
                    scores["statistical"] = 0.6 * (1 - min(1.0, abs(x.unique_share - y.unique_share) + abs(x.null_percent - y.null_percent) / 100))
            kind = max(scores, key=lambda k: (scores[k], k))
            if best is None or scores[kind] > best[0]:
                best = (scores[kind], b, kind)
        if best and best[0] >= least:
            used.add(best[1])
            matches.append(Match(a, best[1], round(best[0], 4), best[2]))
    matched = {m.left_column for m in matches}
    return {
        "matches": [asdict(m) for m in sorted(matches, key=lambda m: -m.confidence)],
        "unmatched_left": [c for c in left if c not in matched],
        "unmatched_right": [c for c in right if c not in used],
    }


def column_facts(df: DataFrame, values: int = 100) -> dict[str, ColumnFacts]:
    """What :func:`smart_match` needs of every column of a table: one aggregation a question, at most ``values`` values a column (the most frequent, ties by value)."""
    types = inferred_types(df)
    shapes = {r["column_name"]: r["pattern"] for r in patterns(df, [c for c, t in df.dtypes if t == "string"]).collect()} if any(t == "string" for _, t in df.dtypes) else {}
    out = {}
    for r in profile(df, exact=False).collect():
        c = r["column_name"]
        counts = df.select(F.col(f"`{c}`").cast("string").alias("value")).where("value is not null").groupBy("value").count()
        top = frozenset(x["value"] for x in counts.orderBy(F.col("count").desc(), "value").limit(values).collect())
        out[c] = ColumnFacts(types[c], shapes.get(c), min(1.0, r["cardinality"]), r["null_percent"], top)
    return out


def match_tables(left: DataFrame, right: DataFrame, least: float = 0.5) -> dict:
    """:func:`smart_match` of two tables, with both sides' types and patterns for :func:`generate_config`."""
    a, b = column_facts(left), column_facts(right)
    found = smart_match(a, b, least)
    kinds = {f"{side}_{what}": {c: getattr(x, name) for c, x in facts.items()} for side, facts in (("left", a), ("right", b)) for what, name in (("types", "data_type"), ("patterns", "pattern"))}
    return found | kinds


def key_options(left: DataFrame, right: DataFrame, column_map: Mapping[str, str] | None = None) -> list[str]:
    """Columns that both sides have, sorted, right ones by their mapped names; an error if there are none."""
    renamed = [(column_map or {}).get(c, c) for c in right.columns]
    found = common_names(left.columns, renamed)
    if not found:
        raise KeyValidationError(f"no column is on both sides: left has {', '.join(left.columns)}; right has {', '.join(renamed)}")
    return found


def choose_key(left: DataFrame, right: DataFrame, choose, column_map: Mapping[str, str] | None = None) -> tuple[list[str], KeyCheck, KeyCheck]:
    """Ask ``choose(options, problem)`` for key columns until they identify the rows of both sides.

    ``problem`` is None at first, then says why the last choice was refused;
    ``choose`` returns a list of names, or None to give up, which raises.
    """
    options = key_options(left, right, column_map)
    back = {normal_name(v): k for k, v in (column_map or {}).items()}
    problem = None
    while True:
        keys = choose(options, problem)
        if keys is None:
            raise KeyValidationError("no key was chosen")
        unknown = [k for k in keys if k not in options]
        if unknown or not keys:
            problem = f"not among the options: {', '.join(unknown)}" if unknown else "a key needs a column"
            continue
        checks, problem = [], None
        for side, df in (("left", left), ("right", right)):
            names = {normal_name(c): c for c in df.columns}
            if side == "right":
                names |= {n: c for n, c in back.items() if c in df.columns}
            checks.append(check_key(df, [names[k] for k in keys]))
            if not checks[-1].is_valid:
                problem = f"{', '.join(keys)} repeats on the {side}: {checks[-1].duplicate_rows} rows in {checks[-1].duplicate_groups} groups"
                break
        if problem is None:
            return list(keys), checks[0], checks[1]


def schema_report(left: DataFrame, right: DataFrame) -> dict:
    """Both sides' columns and types, and the pairs of equal normal form."""
    by = [{normal_name(c): c for c in reversed(df.columns)} for df in (left, right)]
    both = common_names(left.columns, right.columns)
    return {
        "left": dict(left.dtypes),
        "right": dict(right.dtypes),
        "common": [{"name": n, "left": by[0][n], "right": by[1][n]} for n in both],
        "only_left": [c for c in left.columns if normal_name(c) not in both],
        "only_right": [c for c in right.columns if normal_name(c) not in both],
    }


def save_json(result: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(result, f, indent=2, ensure_ascii=False, default=str)


#: Normaliser for each text pattern, by configuration name.
NORMALIZER_OF = {"currency": "currency_usd", "email": "lower", "identifier": "upper"}


# Names of types in configurations, and the sheet that is read.
DTYPE_OF = {"integer": "int64", "float": "float64", "string": "string", "date": "date", "boolean": "boolean", "null": "string"}
FIRST_SHEET = "Sheet1"


def _file(path: str, keys: list[str], types: Mapping[str, str], names: Mapping[str, str]) -> dict:
    """The part of a data set's entry that both sides have."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else "csv"
    out = {"path": path, "type": "excel" if kind in ("xlsx", "xls") else kind, "key_columns": keys}
    if out["type"] == "excel":
        out["sheet"] = FIRST_SHEET
    if types:
        out["dtypes"] = {names.get(c, normal_name(c)): DTYPE_OF.get(t, t) for c, t in types.items()}
    return out


def generate_config(
    left_path: str,
    right_path: str,
    matches: Sequence[Match],
    keys: Sequence[str],
    left_name: str = "left",
    right_name: str = "right",
    patterns: Mapping[str, str] | None = None,
    left_types: Mapping[str, str] | None = None,
    right_types: Mapping[str, str] | None = None,
) -> dict:
    """Configuration of one comparison: right columns mapped to left names, keys, types, sheets, normalisers by pattern."""
    kept = resolve(matches, keys)
    names = dict(zip([m.left_column for m in kept], normal_names([m.left_column for m in kept])))
    theirs = {m.right_column: names[m.left_column] for m in kept}
    by_pattern = {names[c]: NORMALIZER_OF[p] for c, p in (patterns or {}).items() if c in names and p in NORMALIZER_OF}
    key_names = [names.get(k, normal_name(k)) for k in keys]
    left = _file(left_path, key_names, left_types or {}, names)
    left["normalizers"] = {c: n for c, n in by_pattern.items() if n != "currency_usd"}
    left["converters"] = {c: n for c, n in by_pattern.items() if n == "currency_usd"}
    right = _file(right_path, key_names, right_types or {}, theirs)
    right["column_map"] = {normal_name(c): n for c, n in theirs.items() if normal_name(c) != n}
    values = [names[m.left_column] for m in kept if m.left_column not in keys]
    return {
        "datasets": {left_name: left, right_name: right},
        "comparisons": [{"name": f"{left_name}_vs_{right_name}", "left_dataset": left_name, "right_dataset": right_name, "comparison_keys": key_names, "value_columns": values}],
    }
