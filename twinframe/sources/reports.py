"""Report files of a comparison."""

from __future__ import annotations

import datetime as dt
import json
import re
import shutil
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.names import friendly_name
from ..operators.diff import Comparison
from ..plans.config import ComparisonConfig

#: Outputs over this size go into the archive, whatever their kind.
ZIP_BYTES = 10 << 20


#: Rows of a part that one task writes, unless the configuration says otherwise.
PART_ROWS = 50_000


def _header(df: DataFrame) -> bytes:
    return (",".join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\n").encode()


def _parts(df: DataFrame, work: Path, rows: int) -> list[Path]:
    """Parts without headers, written by all tasks, in the order of the rows."""
    df.write.options(header=False, quoteAll=True, escape='"', emptyValue="", nullValue="", maxRecordsPerFile=rows).csv(str(work))
    found = [(re.match(r"part-(\d+)-.*-c(\d+)", p.name), p) for p in work.glob("part-*.csv")]
    return [p for m, p in sorted(found, key=lambda x: (int(x[0][1]), int(x[0][2]))) if p.stat().st_size]


def write_csv(df: DataFrame, path: Path, rows: int = PART_ROWS) -> Path:
    """One CSV file with a header and every field quoted.

    All tasks write; their parts are then strung together.  The folder must be
    one that the executors share.
    """
    work = path.parent / f".{path.stem}_{uuid.uuid4().hex[:8]}"
    with open(path, "wb") as out:
        out.write(_header(df))
        for part in _parts(df, work, rows):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
    shutil.rmtree(work)
    return path


def write_csv_parts(df: DataFrame, path: Path, rows: int = PART_ROWS) -> list[Path]:
    """Files ``<stem>_part001.csv`` and on, of at most ``rows`` rows, each with a header; one at least."""
    work = path.parent / f".{path.stem}_{uuid.uuid4().hex[:8]}"
    out = []
    for part in _parts(df, work, rows) or [None]:
        out.append(path.with_name(f"{path.stem}_part{len(out) + 1:03d}{path.suffix}"))
        with open(out[-1], "wb") as target:
            target.write(_header(df))
            if part is not None:
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, target, 1 << 20)
    shutil.rmtree(work)
    return out


def run_folder(left: str, right: str, base: str | Path = "data/reports", now: dt.datetime | None = None) -> Path:
    return Path(base) / f"{left}_vs_{right}_{(now or dt.datetime.now()):%Y%m%d_%H%M%S}"


def summary_text(numbers: dict, comparison: Comparison, config: ComparisonConfig, files: dict[str, Path]) -> str:
    left, right = friendly_name(config.left_dataset), friendly_name(config.right_dataset)
    keys = ", ".join(a if a == b else f"{a} = {b}" for a, b in comparison.plan.keys)
    sections = {
        "DATASETS": [f"Left: {left}", f"Right: {right}"],
        "KEY COLUMNS": [keys],
        "STATISTICS": [
            f"Rows in {left}: {numbers['total_left']:,}",
            f"Rows in {right}: {numbers['total_right']:,}",
            f"Matched rows: {numbers['matched_rows']:,}",
            f"Only in {left}: {numbers['only_in_left']:,}",
            f"Only in {right}: {numbers['only_in_right']:,}",
            f"Rows with differences (tolerance {config.tolerance:g}): {numbers['value_differences']:,}",
            f"Rows with differences (exact): {numbers['value_differences_exact']:,}",
        ],
        "RATES": [f"{name.replace('_', ' ').capitalize()}: {numbers[name]:.2f}%" for name in ("match_rate", "left_coverage", "right_coverage", "difference_rate")],
        "CONFIGURATION": [f"Value columns: {', '.join(a for a, _ in comparison.plan.values) or 'none'}", f"Ignore case: {config.ignore_case}", f"Ignore spaces: {config.ignore_spaces}"],
        "FILES": [f"{kind}: {path.name}" for kind, path in files.items()],
        "NOTES": ["Exports compare exactly; the tolerance applies to the first count of differing rows only.", "Differing rows are counted here, differing cells in value_differences."],
    }
    return "\n\n".join(f"{title}\n{'-' * len(title)}\n" + "\n".join(lines) for title, lines in sections.items()) + "\n"


def archive(files: dict[str, Path], folder: Path) -> dict[str, Path]:
    """Full exports and large files in one archive, and an inventory of all files."""
    chosen = {k: p for k, p in files.items() if "full" in k or p.stat().st_size > ZIP_BYTES}
    out = {}
    if chosen:
        out["archive"] = folder / "data_comparison_exports.zip"
        with zipfile.ZipFile(out["archive"], "w", zipfile.ZIP_DEFLATED) as z:
            for p in chosen.values():
                z.write(p, p.name)
    out["manifest"] = folder / "report_manifest.json"
    entries = [{"type": k, "file": p.name, "bytes": p.stat().st_size, "archived": k in chosen} for k, p in files.items()]
    out["manifest"].write_text(json.dumps({"created_at": dt.datetime.now().isoformat(timespec="seconds"), "files": entries}, indent=2), encoding="utf-8")
    return out


def export(comparison: Comparison, config: ComparisonConfig, folder: str | Path, numbers: dict | None = None) -> dict[str, Path]:
    """All files of one comparison; the long form is computed once and kept on disk meanwhile."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    numbers = numbers or comparison.summary().first().asDict()
    files: dict[str, Path] = {}
    for side, name in (("left", config.left_dataset), ("right", config.right_dataset)):
        lone = comparison.only_in(side)
        if not config.export_full:
            keys = [p[0 if side == "left" else 1] for p in comparison.plan.keys]
            lone = lone.orderBy(*[f"`{k}`" for k in keys]).limit(config.max_differences)
        files[f"only_in_{side}"] = write_csv(lone, folder / f"only_in_{name}.csv", config.chunk_export_size)
    if comparison.plan.values:
        preview = folder / "value_differences.csv"
        if config.annotate_entire_column:
            rows = comparison.annotated().persist(StorageLevel.DISK_ONLY)
            try:
                if config.export_full:
                    full = comparison.full_export(rows).orderBy("Differing Column", "Key")
                    files["value_differences_full"] = write_csv(full, folder / "value_differences_full.csv", config.chunk_export_size)
                    if config.export_rowlevel_audit_full:
                        audit = comparison.audit_export(rows).orderBy("Key", "Differing Column")
                        for i, part in enumerate(write_csv_parts(audit, folder / "value_differences_full_audit.csv", config.chunk_export_size)):
                            files["value_differences_full_audit" + (f"_{i + 1}" if i else "")] = part
                if config.enable_smart_preview:
                    shown = comparison.smart_preview(config.csv_preview_limit, config.entire_column_sample_size, config.preview_order, rows)
                else:
                    shown = comparison.simple_preview(config.csv_preview_limit, rows)
                files["value_differences"] = write_csv(shown, preview)
            finally:
                rows.unpersist()
        else:
            files["value_differences"] = write_csv(comparison.plain_preview(config.max_differences), preview)
    text = folder / "comparison_summary.txt"
    text.write_text(summary_text(numbers, comparison, config, files), encoding="utf-8")
    files["summary"] = text
    if config.zip_large_exports:
        files |= archive(dict(files), folder)
    return files


def excel_report(comparison: Comparison, path: str | Path, limit: int = 1000) -> Path:
    """Bounded previews as sheets of one workbook; needs openpyxl or xlsxwriter."""
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        comparison.summary().toPandas().to_excel(book, sheet_name="Summary", index=False)
        for side in ("left", "right"):
            comparison.only_in(side).limit(limit).toPandas().to_excel(book, sheet_name=f"Only in {side.capitalize()}", index=False)
        comparison.simple_preview(limit).toPandas().to_excel(book, sheet_name="Value Differences", index=False)
        pd.DataFrame([{"left": a, "right": b} for a, b in comparison.plan.keys + comparison.plan.values]).to_excel(book, sheet_name="Data_Lineage", index=False)
    return Path(path)


def old_runs(base: str | Path, days: int, now: dt.datetime | None = None, archive_to: str | Path | None = None) -> list[Path]:
    """Comparison folders older than ``days`` are deleted, or moved if a folder is given."""
    edge = ((now or dt.datetime.now()) - dt.timedelta(days=days)).timestamp()
    gone = [p for p in sorted(Path(base).glob("*_vs_*")) if p.is_dir() and p.stat().st_mtime < edge]
    for p in gone:
        if archive_to:
            Path(archive_to).mkdir(parents=True, exist_ok=True)
            shutil.move(str(p), str(Path(archive_to) / p.name))
        else:
            shutil.rmtree(p)
    return gone
