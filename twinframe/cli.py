"""Command line: run every comparison of a YAML configuration."""

from __future__ import annotations

import argparse
import logging
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.coerce import TextRules
from .functions.names import normal_name
from .operators.diff import Comparison
from .operators.validate import validate
from .plans.config import RunConfig
from .runs import JsonLines, Lineage, Metrics, Recovery, RunState
from .sources.readers import Stager, headers
from .sources.reports import export, run_folder

VERSION = "0.1.0"
SAMPLE = """datasets:
  left: {path: data/left.csv, key_columns: [id]}
  right: {path: data/right.csv, key_columns: [id], column_map: {full_name: name}}
comparisons:
  - {left_dataset: left, right_dataset: right, comparison_keys: [id], tolerance: 0.01}
"""


def run(spark: SparkSession, config: RunConfig, reports: str | Path = "data/reports", staging: str | Path = "data/staging", strict: bool = False, resume: str | None = None, states: str | Path = "data/checkpoints") -> list[dict]:
    """Stage, validate, compare and report; one result a comparison.

    The state is kept under ``resume`` or a new name until the run ends well;
    a run that goes on skips the comparisons it has reported.
    """
    log, metrics, lineage, stager = logging.getLogger("twinframe"), Metrics(), Lineage(), Stager(spark, staging)
    staged, results = {}, []
    store = Recovery(states)
    state = store.load(resume) if resume else None
    if resume and state is None:
        raise ValueError(f"no state of a run {resume!r} in {states}")
    state = state or RunState(f"run_{uuid.uuid4().hex[:12]}", ["load_config", "validate_config"])
    state.failed_step = state.error = None
    try:
        _run(spark, config, reports, staging, strict, log, metrics, lineage, stager, staged, results, store, state)
    except Exception as e:
        state.failed_step, state.error = store.resume_point(state), str(e)[:500]
        store.save(state)
        log.error("run %s stopped; go on with --resume %s", state.run_id, state.run_id)
        raise
    store.finish(state.run_id)
    return results


def _run(spark, config, reports, staging, strict, log, metrics, lineage, stager, staged, results, store, state) -> None:
    Path(staging).mkdir(parents=True, exist_ok=True)
    for name, dataset in config.datasets.items():
        with metrics.operation(f"stage {name}"):
            staged[name] = stager.stage(dataset)
        lineage.source(name, dataset.path)
        report = validate(staged[name], [c for c in dataset.key_columns if c in staged[name].columns])
        for issue in report.issues:
            log.warning("%s: %s: %s", name, issue.severity, issue.message)
        if strict and not report.is_valid:
            raise ValueError(f"data set {name} is not valid")
    state.completed_steps += [s for s in ("stage_datasets", "normalize_columns") if s not in state.completed_steps]
    store.save(state)
    for c in config.comparisons:
        pair = f"{c.left_dataset}_vs_{c.right_dataset}"
        if pair in state.reported:
            log.info("%s was reported before the run stopped", pair)
            continue
        left, right = config.dataset(c.left_dataset), config.dataset(c.right_dataset)
        with metrics.operation(f"compare {c.left_dataset} and {c.right_dataset}") as entry:
            found = Comparison(
                staged[c.left_dataset], staged[c.right_dataset], c.comparison_keys or left.key_columns, c.value_columns, right.column_map,
                left.exclude_columns, c.tolerance, TextRules(c.ignore_case, c.ignore_spaces), check_keys=True,
            )
            numbers = found.summary().first().asDict()
            entry["rows"] = numbers["total_left"] + numbers["total_right"]
        folder = run_folder(c.left_dataset, c.right_dataset, reports)
        files = export(found, c, folder, numbers)
        lineage.comparison(c.left_dataset, c.right_dataset, **numbers)
        lineage.save(folder / "lineage.json")
        metrics.save(folder / "metrics.json")
        log.info("%s is reported in %s", pair, folder, extra={"context": numbers})
        results.append({"numbers": numbers, "files": files})
        state.reported.append(pair)
        store.save(state)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="twinframe", description=__doc__)
    parser.add_argument("config", nargs="?", type=Path)
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("--strict", action="store_true", help="stop on errors of validation")
    parser.add_argument("--cutoff", metavar="COLUMN=DATE", help="leave out rows of every data set that has the column and a later date in it")
    parser.add_argument("--resume", metavar="RUN", help="go on with a run that stopped")
    parser.add_argument("--log", metavar="FILE", help="add records to this file, a line of JSON each")
    parser.add_argument("--create-sample", action="store_true", help="write sample_config.yaml and stop")
    parser.add_argument("--version", action="version", version=VERSION)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    if args.log:
        logging.getLogger("twinframe").addHandler(JsonLines(args.log))
    if args.create_sample:
        Path("sample_config.yaml").write_text(SAMPLE, encoding="utf-8")
        return 0
    if args.config is None or not args.config.exists():
        parser.error("a configuration file is needed")
    spark = SparkSession.builder.appName("twinframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = RunConfig.load(args.config)
    if args.cutoff:
        column, _, day = args.cutoff.partition("=")
        for dataset in config.datasets.values():
            if normal_name(column) in map(normal_name, headers(spark, dataset.path)):
                dataset.date_filter[column] = day
    for r in run(spark, config, strict=args.strict, resume=args.resume):
        n = r["numbers"]
        print(f"matched {n['matched_rows']}, only left {n['only_in_left']}, only right {n['only_in_right']}, differing {n['value_differences']}, match rate {n['match_rate']}%")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
