import os
import time

import pytest

from twinframe.cli import run
from twinframe.plans.config import RunConfig
from twinframe.runs import Lineage, Metrics, Recovery, RunState
from twinframe.sources import readers, synthetic


def test_csv_encodings_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,name\n1, Zoë ,x\n2,,y\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("id,name\n1,Zoë\n".encode("latin-1"))
    a = readers.read(spark, tmp_path / "a.csv")
    assert a.columns == ["id", "name", "name.1"] and [tuple(r) for r in a.orderBy("id").collect()] == [("1", "Zoë", "x"), ("2", None, "y")]
    assert readers.read(spark, tmp_path / "b.csv").first()["name"] == "Zoë"
    with pytest.raises(FileNotFoundError):
        readers.read(spark, tmp_path / "none.csv")
    (tmp_path / "c.txt").write_text("x")
    with pytest.raises(ValueError):
        readers.read(spark, tmp_path / "c.txt")
    assert [n for n, _ in readers.data_files(tmp_path)] == ["a.csv", "b.csv"]
    assert readers.chunk_rows(tmp_path / "a.csv") == 50_000 and readers.chunk_rows(tmp_path / "a.csv", 150) == 25_000
    assert [len(c) for c in readers.chunks(a, 1)] == [1, 1]


def test_run_from_configuration(spark, tmp_path):
    (tmp_path / "l.csv").write_text("ID,Full Name,Amount\n1,Root : Ann,$5.00\n2,Bob,6\n3,Cy,7\n")
    (tmp_path / "r.csv").write_text("key,name,amt\n1,Ann,5\n2,Bob,9\n4,Di,1\n")
    config = RunConfig.from_dict(
        {
            "datasets": {
                "l": {"path": str(tmp_path / "l.csv"), "key_columns": ["ID"], "normalizers": {"full_name": "strip_hierarchy"}, "converters": {"Amount": "currency_usd"}},
                "r": {"path": str(tmp_path / "r.csv"), "column_map": {"key": "id", "name": "full_name", "amt": "amount"}},
            },
            "comparisons": [{"left_dataset": "l", "right_dataset": "r", "comparison_keys": ["id"]}],
        }
    )
    stager = readers.Stager(spark, tmp_path / "staging")
    assert stager.is_stale(config.dataset("l"))
    result = run(spark, config, tmp_path / "reports", tmp_path / "staging", states=tmp_path / "states")[0]
    assert not list((tmp_path / "states").glob("*.json"))
    n = result["numbers"]
    assert (n["matched_rows"], n["only_in_left"], n["only_in_right"], n["value_differences"]) == (2, 1, 1, 1)
    assert all(p.exists() for p in result["files"].values())
    assert not stager.is_stale(config.dataset("l"))
    os.utime(tmp_path / "l.csv", (time.time() + 9, time.time() + 9))
    assert stager.is_stale(config.dataset("l"))


def test_synthetic_pair(spark):
    from twinframe.operators.diff import Comparison

    base = synthetic.base_table(spark, 400, 2)
    s = Comparison(base, synthetic.altered(base), keys=["id"]).summary().first().asDict()
    assert s["matched_rows"] + s["only_in_left"] == 400 and s["only_in_right"] > 0 and 0 < s["value_differences"] < 100


def test_records(tmp_path):
    lineage = Lineage()
    lineage.source("a", "a.csv")
    lineage.source("b", "b.csv")
    lineage.statistics("a", rows=3)
    lineage.comparison("a", "b", matched=1)
    assert lineage.report()["comparisons"] == 1 and len(lineage.edges) == 2
    metrics = Metrics()
    with metrics.operation("x", rows=10):
        pass
    assert metrics.summary()["rows"] == 10 and metrics.summary()["failed"] == 0
    store = Recovery(tmp_path)
    store.save(RunState("r", ["load_config"]))
    assert store.resume_point(store.load("r")) == "validate_config" and store.load("zz") is None


def test_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from twinframe import cli

    (tmp_path / "l.csv").write_text("id,day,v\n1,1/5/2024,a\n2,2024-06-01,b\n3,12/30/2025,c\n4,,d\n")
    (tmp_path / "r.csv").write_text("id,v\n1,a\n2,x\n3,c\n")
    sets = {n: {"path": str(tmp_path / f"{n}.csv"), "key_columns": ["id"]} for n in ("l", "r")}
    sets["l"]["date_filter"] = {"Day": "2024-12-31"}
    config = RunConfig.from_dict({"datasets": sets, "comparisons": [{"left_dataset": "l", "right_dataset": "r"}, {"left_dataset": "r", "right_dataset": "l"}]})
    places = {"reports": tmp_path / "reports", "staging": tmp_path / "staging", "states": tmp_path / "states"}
    plain, calls = cli.export, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("disk full")
        return plain(*args)

    monkeypatch.setattr(cli, "export", breaks)
    with pytest.raises(RuntimeError):
        run(spark, config, **places)
    name = next((tmp_path / "states").glob("*.json")).stem
    state = Recovery(tmp_path / "states").load(name)
    assert state.failed_step == "run_comparisons" and "disk full" in state.error
    again = run(spark, config, resume=name, **places)
    assert len(again) == 1 and len(calls) == 3 and not list((tmp_path / "states").glob("*.json"))
    # of the left rows two are left by the date filter
    assert again[0]["numbers"]["total_right"] == 2 and again[0]["numbers"]["matched_rows"] == 2
    with pytest.raises(ValueError):
        run(spark, config, resume="none", **places)


def test_csv_quotes_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"one\ntwo"\n2,"he said ""no"""\n', encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text('id,v\n1,one\n2,"he said ""no"""\n', encoding="utf-8-sig")
    (tmp_path / "c.csv").write_text("")
    assert readers.csv_facts(spark, tmp_path / "a.csv") == (True, True)
    assert readers.csv_facts(spark, tmp_path / "b.csv") == (True, False)
    assert readers.csv_facts(spark, tmp_path / "c.csv") == (True, False)
    assert [tuple(r) for r in readers.read_csv(spark, tmp_path / "a.csv", clean=False).collect()] == [("1", "one\ntwo"), ("2", 'he said "no"')]
    b = readers.read_csv(spark, tmp_path / "b.csv", clean=False)
    assert b.columns == ["id", "v"] and [tuple(r) for r in b.collect()] == [("1", "one"), ("2", 'he said "no"')]


def test_report_parts(spark, tmp_path):
    import csv

    from twinframe.sources import reports

    df = spark.range(95).selectExpr("id as `a \"b\"`", "concat('x,', id) as v").orderBy("v")
    want = sorted(f"x,{i}" for i in range(95))
    path = reports.write_csv(df, tmp_path / "one.csv", rows=4)
    rows = list(csv.reader(path.open()))
    assert rows[0] == ['a "b"', "v"] and [r[1] for r in rows[1:]] == want
    parts = reports.write_csv_parts(df, tmp_path / "many.csv", rows=30)
    assert parts[0].name == "many_part001.csv" and len(parts) >= 4
    read = [list(csv.reader(p.open())) for p in parts]
    assert all(r[0] == ['a "b"', "v"] and len(r) <= 31 for r in read) and [r[1] for p in read for r in p[1:]] == want
    none = reports.write_csv_parts(df.where("v is null"), tmp_path / "none.csv")
    assert len(none) == 1 and none[0].read_text() == '"a ""b""","v"\n'
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["one.csv", "none_part001.csv", *[p.name for p in parts]])
