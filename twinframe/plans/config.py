"""Dataset and comparison settings, and their YAML form."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class DatasetConfig:
    path: str
    name: str
    type: str = "csv"
    key_columns: list[str] = field(default_factory=list)
    exclude_columns: list[str] = field(default_factory=list)
    normalizers: dict[str, str] = field(default_factory=dict)
    converters: dict[str, str] = field(default_factory=dict)
    column_map: dict[str, str] = field(default_factory=dict)
    custom_sql: str | None = None
    date_filter: dict[str, str] = field(default_factory=dict)
    sheet: str | int = 0
    chunk_size: int = 10000

    def __post_init__(self):
        for what in ("path", "name"):
            if not getattr(self, what):
                raise ValueError(f"a data set needs a {what}")


@dataclass
class ComparisonConfig:
    left_dataset: str
    right_dataset: str
    comparison_keys: list[str] = field(default_factory=list)
    value_columns: list[str] = field(default_factory=list)
    tolerance: float = 0.01
    ignore_case: bool = True
    ignore_spaces: bool = True
    output_format: str = "excel"
    max_differences: int = 1000
    csv_preview_limit: int = 1000
    entire_column_sample_size: int = 10
    collapse_entire_column_in_preview: bool = False
    export_rowlevel_audit_full: bool = False
    zip_large_exports: bool = False
    preview_order: list[str] = field(default_factory=lambda: ["Differing Column", "Key"])
    export_full: bool = True
    annotate_entire_column: bool = True
    chunk_export_size: int = 50000
    enable_smart_preview: bool = True


#: Settings of old files that no longer do anything.
DEPRECATED = {"collapse_entire_column_in_full": "full exports always collapse entire columns"}


def _make(kind, values: dict):
    known = {f.name for f in fields(kind)}
    for name in values:
        if name in DEPRECATED:
            warnings.warn(f"{name} is deprecated: {DEPRECATED[name]}", DeprecationWarning, stacklevel=3)
    return kind(**{k: v for k, v in values.items() if k in known and v is not None})


@dataclass
class RunConfig:
    datasets: dict[str, DatasetConfig] = field(default_factory=dict)
    comparisons: list[ComparisonConfig] = field(default_factory=list)

    def dataset(self, name: str) -> DatasetConfig:
        if name not in self.datasets:
            raise KeyError(f"no dataset {name!r}; there are {', '.join(self.datasets) or 'none'}")
        return self.datasets[name]

    @classmethod
    def from_dict(cls, raw: dict) -> RunConfig:
        datasets = {name: _make(DatasetConfig, {"name": name} | dict(values)) for name, values in (raw.get("datasets") or {}).items()}
        comparisons = []
        for values in raw.get("comparisons") or []:
            values = dict(values)
            values.setdefault("left_dataset", values.pop("left", None))
            values.setdefault("right_dataset", values.pop("right", None))
            values.setdefault("comparison_keys", values.pop("keys", None))
            comparisons.append(_make(ComparisonConfig, values))
        return cls(datasets, comparisons)

    @classmethod
    def load(cls, path: str | Path) -> RunConfig:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f) or {})

    def to_dict(self) -> dict:
        return {"datasets": {n: asdict(d) for n, d in self.datasets.items()}, "comparisons": [asdict(c) for c in self.comparisons]}

    def save(self, path: str | Path) -> None:
        import yaml

        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(self.to_dict(), f, sort_keys=False, allow_unicode=True)
