"""Files to data frames, and the staged Parquet copy of each data set."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import find_column, normal_name, normal_names, pandas_spelling, rename_all, table_name
from ..functions.text import CONVERTERS, NORMALIZERS, normalize_frame
from ..operators.validate import on_or_before
from ..plans.config import DatasetConfig

# Rows in a chunk by kind of file.
CHUNK_ROWS = {"csv": 50_000, "excel": 10_000, "parquet": 100_000, "default": 25_000}
LEAST_CHUNK, LARGE_FILE, MANY_COLUMNS = 1000, 1 << 30, 100
READABLE = (".csv", ".xlsx", ".xls", ".parquet")


def csv_facts(spark: SparkSession, path: str | Path) -> tuple[bool, bool]:
    """(every line is UTF-8, some line leaves a quote open): one distributed pass over the lines."""
    line = F.col("value")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    row = spark.read.text(str(path)).agg(F.bool_and(F.is_valid_utf8(line)).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open")).first()
    return row["utf8"] is not False, bool(row["open"])


def read_csv(
    spark: SparkSession, path: str | Path, infer: bool = False, clean: bool = True, encoding: str | None = None, sampling: float = 1.0, multiline: bool | None = None
) -> DataFrame:
    """A CSV with a header; UTF-8, else ISO-8859-1.  Columns are text unless ``infer``; malformed lines go; repeated headers become ``a``, ``a.1``.

    Files are split among tasks unless quoted fields hold line ends; unless
    ``multiline`` says so, a line with an odd number of quotes tells.
    """
    if encoding is None or multiline is None:
        utf8, open_quotes = csv_facts(spark, path)
        encoding = encoding or ("utf-8" if utf8 else "iso-8859-1")
        multiline = open_quotes if multiline is None else multiline
    options = {"header": True, "encoding": encoding, "mode": "DROPMALFORMED", "multiLine": multiline, "quote": '"', "escape": '"', "inferSchema": infer, "samplingRatio": sampling}
    df = spark.read.options(**options).csv(str(path))
    local = Path(str(path).removeprefix("file://"))
    if local.is_file():
        import csv

        with open(local, encoding=encoding, errors="replace", newline="") as f:
            header = [h.removeprefix("\ufeff") for h in next(csv.reader(f), [])]
        if len(header) == len(df.columns):
            df = df.toDF(*pandas_spelling(header))
    return normalize_frame(df) if clean else df


def read_excel(spark: SparkSession, path: str | Path, sheet: str | int = 0) -> DataFrame:
    """A worksheet, through pandas on the driver; needs openpyxl."""
    try:
        frame = pd.read_excel(path, sheet_name=sheet, dtype=object)
    except ImportError as e:
        raise ImportError("reading Excel files needs the optional package openpyxl") from e
    frame = frame.map(lambda x: None if pd.isna(x) else str(x))
    return normalize_frame(spark.createDataFrame(frame, schema=", ".join(f"`{c}` string" for c in frame.columns)))


def read(spark: SparkSession, path: str | Path, **options) -> DataFrame:
    """By the file's ending."""
    text = str(path)
    local = Path(text.removeprefix("file://"))
    if "://" not in text and not local.exists():
        raise FileNotFoundError(text)
    ending = local.suffix.lower()
    if ending == ".csv":
        return read_csv(spark, text, **options)
    if ending in (".xlsx", ".xls"):
        return read_excel(spark, text, **options)
    if ending == ".parquet":
        return spark.read.parquet(text)
    raise ValueError(f"cannot read {ending or 'a file without an ending'}; known are {', '.join(READABLE)}")


def read_as_view(spark: SparkSession, path: str | Path, **options) -> str:
    """Read and register under the file's name; returns the view's name."""
    name = table_name(Path(str(path)).stem)
    read(spark, path, **options).createOrReplaceTempView(name)
    return name


def custom_sql(spark: SparkSession, raw: DataFrame, sql: str, name: str = "source") -> DataFrame:
    """``sql`` over the raw table, which it calls ``{table}``."""
    view = f"raw_{table_name(name)}"
    raw.createOrReplaceTempView(view)
    return spark.sql(sql.strip().rstrip(";").replace("{table}", view))


def chunk_rows(path: str | Path, columns: int = 50, chosen: int | None = None) -> int:
    """Rows in a chunk: by kind of file, halved for large files and for many columns."""
    if chosen:
        return chosen
    p = Path(path)
    n = CHUNK_ROWS.get(p.suffix.lower().lstrip("."), CHUNK_ROWS["default"])
    n //= 2 if p.stat().st_size > LARGE_FILE else 1
    n //= 2 if columns > MANY_COLUMNS else 1
    return max(LEAST_CHUNK, n)


def chunks(df: DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    """Pandas frames of at most ``rows`` rows, one partition at a time on the driver."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def map_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``fn`` on batches of rows in the executors."""

    def work(frames):
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(work, schema)


def fingerprint(path: str | Path, first: int | None = None) -> str:
    """Sixteen hex digits of the content's SHA-256, of its first bytes if ``first``."""
    h, left = hashlib.sha256(), first
    with open(path, "rb") as f:
        while block := f.read(min(1 << 20, left) if left is not None else 1 << 20):
            h.update(block)
            if left is not None:
                left -= len(block)
    return h.hexdigest()[:16]


def headers(spark: SparkSession, path: str | Path) -> list[str]:
    """Column names only; none if the file can't be read."""
    try:
        return read(spark, path, **({"clean": False} if str(path).lower().endswith(".csv") else {})).columns
    except Exception:
        return []


def apply_functions(df: DataFrame, config: DatasetConfig) -> DataFrame:
    """The configuration's normalisers and converters, on columns found by any spelling."""
    for table, chosen in ((NORMALIZERS, config.normalizers), (CONVERTERS, config.converters)):
        for column, name in chosen.items():
            if name not in table:
                raise KeyError(f"unknown function {name!r}; there are {', '.join(table)}")
            found = find_column(column, df.columns)
            df = df.withColumn(found, table[name](F.col(f"`{found}`")))
    return df


class Stager:
    """Data sets as Parquet under normal names, reused while their source is unchanged."""

    def __init__(self, spark: SparkSession, folder: str | Path = "data/staging"):
        self.spark, self.folder = spark, Path(folder)

    def _paths(self, config: DatasetConfig) -> tuple[Path, Path]:
        return self.folder / f"{config.name}.parquet", self.folder / f"{config.name}.meta"

    def is_stale(self, config: DatasetConfig) -> bool:
        """No staged copy, no or unreadable notes, a newer source, or other columns in it."""
        staged, notes = self._paths(config)
        try:
            old = json.loads(notes.read_text(encoding="utf-8"))
            newer = Path(config.path).stat().st_mtime > old["source_mtime"]
            return not staged.exists() or newer or set(old["source_columns"]) != set(headers(self.spark, config.path))
        except (OSError, ValueError, KeyError):
            return True

    def stage(self, config: DatasetConfig, force: bool = False) -> DataFrame:
        staged, notes = self._paths(config)
        if force or self.is_stale(config):
            options = {"sheet": config.sheet} if Path(config.path).suffix.lower() in (".xlsx", ".xls") else {}
            df = read(self.spark, config.path, **options)
            columns = df.columns
            if config.custom_sql:
                df = custom_sql(self.spark, df, config.custom_sql, config.name)
            df = apply_functions(rename_all(df), config)
            df.write.mode("overwrite").option("compression", "snappy").parquet(str(staged))
            notes.write_text(json.dumps({"source_columns": columns, "source_mtime": Path(config.path).stat().st_mtime, "dataset_name": config.name, "created_at": time.time()}), encoding="utf-8")
        df = self.spark.read.parquet(str(staged))
        dropped = {normal_name(c) for c in config.exclude_columns}
        for column, cutoff in config.date_filter.items():
            df = on_or_before(df, find_column(column, df.columns), str(cutoff))
        df = df.drop(*[c for c in df.columns if c in dropped])
        df.createOrReplaceTempView(table_name(config.name))
        return df


def data_files(folder: str | Path) -> list[tuple[str, str]]:
    """(name, size for people) of the readable files in a folder, by lower-case name."""

    def size(n: float) -> str:
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024 or unit == "GB":
                return f"{n:.1f} {unit}"
            n /= 1024
        return ""

    found = [p for p in Path(folder).iterdir() if p.is_file() and p.suffix.lower() in READABLE]
    return [(p.name, size(p.stat().st_size)) for p in sorted(found, key=lambda p: p.name.lower())]


__all__ = ["Stager", "apply_functions", "chunk_rows", "chunks", "csv_facts", "custom_sql", "data_files", "fingerprint", "headers", "map_chunks", "normal_names", "read", "read_as_view", "read_csv", "read_excel"]
