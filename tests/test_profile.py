import json
import logging
import random

import pytest

from twinframe.operators import match, profile
from twinframe.operators.keys import KeyValidationError
from twinframe.runs import JsonLines


def brute(values, share):
    x = sorted(v for v in values if v is not None)
    at = share * (len(x) - 1)
    low, high = x[int(at)], x[min(int(at) + 1, len(x) - 1)]
    return low + (at - int(at)) * (high - low)


@pytest.mark.parametrize("bracket_rows", [1, 7, 100, 10**6])
def test_quantiles_by_brackets(spark, bracket_rows):
    draw = random.Random(3)
    rows = [(draw.gauss(0, 9), draw.choice([0.0, 1.0]), draw.choice([None, 1.0, 2.0, 2.5]), None, 7.0) for _ in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").cache()
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = profile.quantiles(df, ["a", "b", "c", "d", "e"], shares, bracket_rows)
    assert found["d"] == [None] * 5
    for i, c in ((0, "a"), (1, "b"), (2, "c"), (4, "e")):
        assert found[c] == pytest.approx([brute([r[i] for r in rows], q) for q in shares])


def test_profiles(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x")], "id int, k string, v string")
    found = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert [found[c]["unique_count"] for c in ("id", "k", "v")] == [3, 1, 1]
    assert {r["columns"]: r["unique_count"] for r in profile.composite_candidates(df, ["id", "k", "v"]).collect()} == {"id+k": 3, "id+v": 3, "k+v": 3}
    saved = profile.save_profile(df, tmp_path / "p.json")
    assert saved["row_count"] == 3 and saved["columns"]["k"]["sample_values"] == ["a", "a"]
    assert json.loads((tmp_path / "p.json").read_text()).keys() == saved.keys()
    assert [r["unique_count"] for r in profile.profile(df.limit(0)).collect()] == [0, 0, 0]


def test_matching_of_tables(spark):
    left = spark.createDataFrame([(i, f"u{i}@x.org", f"${i}.50", "red") for i in range(20)], "`Customer ID` int, `E-Mail` string, amount string, hue string")
    right = spark.createDataFrame([(i, f"u{i}@x.org", f"${i}.50", "red") for i in range(20)], "customer_id int, contact string, total string, colour string")
    found = match.match_tables(left, right)
    pairs = {m["left_column"]: m["right_column"] for m in found["matches"]}
    assert pairs == {"Customer ID": "customer_id", "E-Mail": "contact", "amount": "total", "hue": "colour"}
    assert found["left_patterns"]["E-Mail"] == "email" and found["left_types"]["Customer ID"] == "integer"
    matches = [match.Match(**m) for m in found["matches"]]
    config = match.generate_config("a.xlsx", "b.csv", matches, ["Customer ID"], patterns=found["left_patterns"], left_types=found["left_types"], right_types=found["right_types"])
    left_set, right_set = config["datasets"]["left"], config["datasets"]["right"]
    assert left_set["sheet"] == "Sheet1" and "sheet" not in right_set and left_set["dtypes"]["customer_id"] == "int64"
    assert right_set["column_map"]["contact"] == "e_mail" and config["comparisons"][0]["name"] == "left_vs_right"


def test_choosing_keys(spark):
    left = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "id int, grp int, `Full Name` string")
    right = spark.createDataFrame([(1, 5, "a"), (3, 5, "b")], "number int, grp int, full_name string")
    asked = []

    def choose(options, problem):
        asked.append(problem)
        return [["nothing"], ["grp"], ["id"]][len(asked) - 1]

    keys, a, b = match.choose_key(left, right, choose, {"number": "id"})
    assert keys == ["id"] and a.is_valid and b.is_valid
    assert asked[0] is None and "nothing" in asked[1] and "grp repeats on the left" in asked[2]
    assert match.key_options(left, right, {"number": "id"}) == ["full_name", "grp", "id"]
    with pytest.raises(KeyValidationError):
        match.choose_key(left, right, lambda options, problem: None)
    with pytest.raises(KeyValidationError):
        match.key_options(left, right.select("number"))
    report = match.schema_report(left, right)
    assert [c["name"] for c in report["common"]] == ["full_name", "grp"] and report["only_right"] == ["number"]


def test_log_lines(tmp_path):
    log = logging.getLogger("twinframe.test")
    handler = JsonLines(tmp_path / "logs" / "run.jsonl")
    log.addHandler(handler)
    try:
        log.warning("rows %d", 3, extra={"context": {"side": "left"}})
    finally:
        log.removeHandler(handler)
    entry = json.loads((tmp_path / "logs" / "run.jsonl").read_text())
    assert entry["message"] == "rows 3" and entry["level"] == "WARNING" and entry["context"] == {"side": "left"}
