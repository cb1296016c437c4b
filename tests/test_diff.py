import csv

import pytest

from twinframe.operators.diff import Comparison
from twinframe.operators.keys import KeyValidationError, check_key, duplicate_examples
from twinframe.operators.match import Match, generate_config, match_columns, resolve
from twinframe.operators.profile import composite_candidates, inferred_types, outliers, patterns
from twinframe.operators.validate import validate
from twinframe.plans.config import ComparisonConfig, RunConfig
from twinframe.sources.reports import export


@pytest.fixture(scope="module")
def demo(spark):
    left = spark.createDataFrame([(1, "Ann", "a@x", "100.00", "true"), (2, "Bob", "b@x", "200", "yes"), (3, "Cy", "c@x", "$300", "t"), (4, "Di", "d@x", "4", "f"), (5, "Ed", "e@x", "5", "no")], "id int, name string, email string, amount string, active string")
    right = spark.createDataFrame([(1, "ANN", "a@x", "100", "TRUE"), (2, "Rob", "r@x", "250", "t"), (3, " cy ", "c@x", "300.0", "yes"), (5, "Ed", "e@x", "6", "true"), (6, "Flo", "f@x", "6", "f")], "id long, name string, email string, amount string, active string")
    return left, right


def test_demo_counts(demo):
    s = Comparison(*demo, keys=["id"]).summary().first().asDict()
    assert (s["matched_rows"], s["only_in_left"], s["only_in_right"], s["value_differences"], s["match_rate"]) == (4, 1, 1, 2, 66.67)
    cells = {(r["Key"], r["Differing Column"]) for r in Comparison(*demo, keys=["id"]).cells().collect()}
    assert cells == {(2, "name"), (2, "email"), (2, "amount"), (5, "amount"), (5, "active")}


def test_self_and_mirror(demo):
    left, right = demo
    assert Comparison(left, left, keys=["id"]).cells().count() == 0
    a = {(r["Key"], r["Differing Column"], r["Left Value"], r["Right Value"]) for r in Comparison(left, right, keys=["id"]).cells().collect()}
    b = {(r["Key"], r["Differing Column"], r["Right Value"], r["Left Value"]) for r in Comparison(right, left, keys=["id"]).cells().collect()}
    assert a == b


def test_one_join_and_pruned_columns(demo):
    plan = Comparison(*demo, keys=["id"], values=["name"]).summary()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "struct(l0, " in plan and ", l2, " not in plan


def test_null_and_composite_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3)], "x int, y string, v int")
    s = Comparison(df, df, keys=["x", "y"]).counts().first().asDict()
    assert s == {"total_left": 3, "total_right": 3, "matched_rows": 2, "only_in_left": 1, "only_in_right": 1}
    assert check_key(df, ["x", "y"]).is_valid and not check_key(df, ["x"]).is_valid
    assert check_key(df, ["x"]).null_rows == 1
    assert duplicate_examples(df, ["x"]).collect()[0].asDict() == {"x": 1, "duplicate_count": 2}
    with pytest.raises(KeyValidationError):
        Comparison(df, df, keys=["x"], check_keys=True)


def test_export_files(demo, tmp_path):
    config = ComparisonConfig("demo_left", "demo_right", zip_large_exports=True, export_rowlevel_audit_full=True)
    files = export(Comparison(*demo, keys=["id"]), config, tmp_path)
    with open(files["value_differences_full"], encoding="utf-8") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["Key", "Differing Column", "Left Value", "Right Value", "Difference Type", "Entire Column Different"] and len(rows) == 6
    with open(files["value_differences"], encoding="utf-8") as f:
        assert next(csv.reader(f)) == ["Differing Column", "Key", "Left Value", "Right Value", "Difference Type", "entire_column", "sample"]
    assert files["archive"].exists() and files["manifest"].exists() and "Matched rows: 4" in files["summary"].read_text()


def test_validation(spark, demo):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "7")], "id int, v string")
    found = validate(df, ["id"])
    assert not found.is_valid and {(i.severity, i.category) for i in found.issues} == {("WARNING", "schema"), ("ERROR", "key"), ("WARNING", "key"), ("WARNING", "duplicates")}
    assert not validate(df.limit(0)).is_valid and validate(demo[0], ["id"]).is_valid


def test_profiles(spark):
    df = spark.createDataFrame([(i, f"u{i}@x.org", "$1,000.00", 10 + i % 4 if i else 1000, None) for i in range(20)], "id int, mail string, money string, v int, n string")
    assert {r["column_name"]: r["pattern"] for r in patterns(df, ["mail", "money"]).collect()} == {"mail": "email", "money": "currency"}
    assert [r["value"] for r in outliers(df, "v", "id").collect()] == [1000.0]
    assert inferred_types(df) == {"id": "integer", "mail": "string", "money": "integer", "v": "integer", "n": "null"}
    assert {r["columns"]: r["is_unique"] for r in composite_candidates(df, ["v", "id"]).collect()} == {"v+id": True}


def test_matching_and_config(tmp_path):
    found = match_columns({"From": "object", "Internal ID": "int64"}, {"author": "object", "internal_id": "int64"})
    assert {(m.left_column, m.right_column) for m in found} == {("From", "author"), ("Internal ID", "internal_id")}
    both = [Match("From", "author", 0.5, ""), Match("From Email Address", "author", 0.9, "")]
    assert [m.left_column for m in resolve(both)] == ["From Email Address"]
    assert [m.left_column for m in resolve(both, ["From"])] == ["From"]
    config = RunConfig.from_dict(generate_config("a.csv", "b.csv", found, ["Internal ID"]))
    config.save(tmp_path / "c.yaml")
    assert RunConfig.load(tmp_path / "c.yaml").to_dict() == config.to_dict()
    with pytest.raises(KeyError):
        config.dataset("x")
