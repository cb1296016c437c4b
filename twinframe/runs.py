"""Lineage, metrics and recovery of runs: small driver-side records kept as JSON."""

from __future__ import annotations

import json
import logging
import resource
import time
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Steps of a run, in order.
STEPS = ("load_config", "validate_config", "stage_datasets", "normalize_columns", "run_comparisons", "generate_reports")
# Targets that a run is held against.
TARGET_ROWS, TARGET_SECONDS, TARGET_MB = 300_000, 300.0, 2048.0


def _write(path: str | Path, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


class JsonLines(logging.Handler):
    """Log records as lines of JSON: timestamp, level, logger, message, and ``context`` if a record brings one (``extra={"context": {...}}``)."""

    def __init__(self, path: str | Path):
        super().__init__()
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def emit(self, record: logging.LogRecord) -> None:
        at = time.strftime("%Y-%m-%dT%H:%M:%S", time.localtime(record.created))
        entry = {"timestamp": f"{at}.{int(record.msecs):03d}", "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if context := getattr(record, "context", None):
            entry["context"] = context
        try:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps(entry, ensure_ascii=False, default=str) + "\n")
        except OSError:
            self.handleError(record)


@dataclass
class Lineage:
    """Data sets and comparisons as a graph."""

    nodes: dict[str, dict] = field(default_factory=dict)
    edges: list[tuple[str, str, str]] = field(default_factory=list)

    def source(self, name: str, path: str, **facts) -> None:
        self.nodes[name] = {"kind": "dataset", "path": path, "transformations": [], "statistics": {}} | facts

    def transformation(self, name: str, what: str, **facts) -> None:
        self.nodes[name]["transformations"].append({"what": what, "at": time.time()} | facts)

    def statistics(self, name: str, **numbers) -> None:
        self.nodes[name]["statistics"] |= numbers

    def comparison(self, left: str, right: str, **result) -> str:
        name = f"{left}_vs_{right}"
        self.nodes[name] = {"kind": "comparison", "result": result}
        self.edges += [(left, name, "left"), (right, name, "right")]
        return name

    def report(self) -> dict:
        of = lambda kind: [n for n in self.nodes.values() if n["kind"] == kind]
        return {
            "datasets": len(of("dataset")),
            "comparisons": len(of("comparison")),
            "transformations": sum(len(n["transformations"]) for n in of("dataset")),
            "rows": sum(n["statistics"].get("rows", 0) for n in of("dataset")),
            "nodes": self.nodes,
            "edges": self.edges,
        }

    def save(self, path: str | Path) -> None:
        _write(path, self.report())


@dataclass
class Metrics:
    """Timed operations with rows and the driver's peak memory."""

    operations: list[dict] = field(default_factory=list)

    @contextmanager
    def operation(self, name: str, rows: int = 0):
        entry = {"name": name, "rows": rows, "started": time.time(), "ok": False}
        self.operations.append(entry)
        try:
            yield entry
            entry["ok"] = True
        finally:
            entry["seconds"] = time.time() - entry["started"]
            entry["peak_mb"] = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            entry["rows_per_second"] = entry["rows"] / entry["seconds"] if entry["seconds"] > 0 else 0.0

    def summary(self) -> dict:
        done = [o for o in self.operations if "seconds" in o]
        seconds, rows = sum(o["seconds"] for o in done), sum(o["rows"] for o in done)
        peak = max((o["peak_mb"] for o in done), default=0.0)
        allowed = TARGET_SECONDS * max(1.0, rows / TARGET_ROWS)
        return {
            "operations": len(done),
            "failed": sum(not o["ok"] for o in done),
            "seconds": seconds,
            "rows": rows,
            "rows_per_second": rows / seconds if seconds else 0.0,
            "peak_mb": peak,
            "slowest": [o["name"] for o in sorted(done, key=lambda o: -o["seconds"])[:5]],
            "most_memory": [o["name"] for o in sorted(done, key=lambda o: -o["peak_mb"])[:5]],
            "meets_time_target": seconds <= allowed,
            "meets_memory_target": peak < TARGET_MB,
        }

    def save(self, path: str | Path) -> None:
        _write(path, {"summary": self.summary(), "operations": self.operations})


@dataclass
class RunState:
    run_id: str
    completed_steps: list[str] = field(default_factory=list)
    failed_step: str | None = None
    error: str | None = None
    staged: list[str] = field(default_factory=list)
    reported: list[str] = field(default_factory=list)
    updated: float = field(default_factory=time.time)


class Recovery:
    """The state of a run on disk, so that it can go on where it stopped."""

    def __init__(self, folder: str | Path = "data/checkpoints"):
        self.folder = Path(folder)

    def _path(self, run_id: str) -> Path:
        return self.folder / f"{run_id}.json"

    def save(self, state: RunState) -> None:
        state.updated = time.time()
        _write(self._path(state.run_id), asdict(state))

    def load(self, run_id: str) -> RunState | None:
        try:
            return RunState(**json.loads(self._path(run_id).read_text(encoding="utf-8")))
        except (OSError, ValueError, TypeError):
            return None

    def next_steps(self, state: RunState) -> list[str]:
        return [s for s in STEPS if s not in state.completed_steps]

    def resume_point(self, state: RunState) -> str | None:
        return next(iter(self.next_steps(state)), None)

    def finish(self, run_id: str) -> None:
        self._path(run_id).unlink(missing_ok=True)

    def expire(self, days: float) -> list[str]:
        old = [p for p in sorted(self.folder.glob("*.json")) if p.stat().st_mtime < time.time() - days * 86400]
        for p in old:
            p.unlink()
        return [p.stem for p in old]
