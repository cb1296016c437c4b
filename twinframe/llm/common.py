"""Helpers shared by the operators: reading, lineage cuts, hashes and words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Largest small side, in bytes of its values, that is broadcast; larger ones are joined by key.
BROADCAST_BYTES = 8 << 20

#: A word is a run of characters other than these six.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    Reliable checkpoints survive lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a thin cut that one task reads.
THIN_BYTES = 1 << 20


def cut_thin(df: DataFrame) -> DataFrame:
    """:func:`cut`, and read by few tasks where few bytes lie in many partitions.

    Partitions are read together, ``THIN_BYTES`` of files each and two for each
    core at least, if that leaves a quarter of them at most.
    """
    done = cut(df)
    rdd = done._jdf.queryExecution().analyzed().rdd()
    parts = rdd.getNumPartitions()
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    if parts < 4 * least:
        return done
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    files = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    few = max(least, -(-files.getContentSummary(path).getLength() // THIN_BYTES))
    return done.coalesce(few) if parts >= 4 * few else done


def release(spark: SparkSession) -> None:
    """Ask for the shuffle files of plans that are no longer referenced.

    Spark drops them once the driver collects garbage; long jobs call this after
    a large step, or every old shuffle would stay on disk meanwhile.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values of ``df``: 16 for each of fixed width, else what they hold."""

    def width(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.lit(16) + F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, StructType):
            return reduce(add, [width(c[f.name], f.dataType) for f in kind], F.lit(16))
        if isinstance(kind, (ArrayType, MapType)):
            return F.lit(16) + F.lit(32) * F.greatest(F.size(c), F.lit(0))
        return F.lit(16)

    each = reduce(add, [width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema], F.lit(16))
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a side that is broadcast only if its measured bytes show it to be small.

    ``small`` should be cheap to read (a cut).  Past the bound it is an
    ordinary shuffled join, whose skewed partitions AQE splits.
    """
    if value_bytes(small) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def shared_model(spark: SparkSession, model):
    """A broadcast of a fitted model by value: workers need not have this package.  Read it with ``received``.

    Models are fixed in size by their parameters.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(shared):
    return cloudpickle.loads(shared.value)


def give_back() -> None:
    """Hand what earlier tasks left in a reused Python worker back to the system; called as a task begins."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def null_safe_key(column: str | Column) -> Column:
    """A string that is never null and distinguishes null from every value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """Uniform double in [0, 1) from a seeded 64-bit hash."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftright(h, 11).cast("double") + F.lit(2.0**52)) / F.lit(2.0**53)


def drawn(seed, *cols: Column) -> Column:
    """Uniform integer in [0, 2**48) from MD5, which other engines have too; nulls count as empty."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


#: Values of :func:`drawn`.
DRAWS = float(1 << 48)


def word_count(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unique_name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- numpy words

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def scramble(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hashes of all words of a text at once.

    A prefix sum of a polynomial modulo 2**64 gives every word's hash by one
    subtraction; the inverse power makes it independent of the position.
    """

    def __init__(self, lower: bool = True):
        self.lower = lower
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the words in UTF-8 ``data``."""
        b = np.frombuffer(data, dtype=np.uint8)
        if not len(b):
            none = np.zeros(0, dtype=np.int64)
            return np.zeros(0, dtype=np.uint64), none, none
        if len(self.up) < len(b) + 1:
            n = max(1 << 16, 2 * len(b))
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        word = np.zeros(len(b) + 2, dtype=np.int8)
        np.logical_not(_IS_SPACE[b], out=word[1:-1].view(bool))
        edge = np.diff(word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if self.lower:
            b = _ASCII_LOWER[b]
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], out=total[1:])
        return scramble((total[ends] - total[starts]) * self.down[starts]), starts, ends
