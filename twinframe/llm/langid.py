"""Language identification by rank-order profiles.

A language's profile is its most frequent n-grams (one to three characters of
lower-cased words, with word edges) in order of frequency.  A document's own
most frequent n-grams are compared with each profile by the out-of-place
distance: the sum of differences of rank, with the largest one for n-grams that
the profile lacks.  The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, join_small, unit_hash

#: n-grams in a language's profile, and of a document that are compared with it.
PROFILE = 400
#: Characters of a long text that are counted at a time.
CHUNK = 1 << 20
#: n-grams that a task holds before it sums them or hands them on.
HELD = 1 << 19
#: Bins in which scores are counted to find the middle.
BINS = 4096
UNKNOWN = "und"


class GramCounter:
    """n-grams as 63-bit integers, three code points of 21 bits, counted by sorting."""

    def __init__(self):
        self.letter: np.ndarray | None = None

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        if self.letter is None:
            self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        return self.letter[codes]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the whole text and how often they occur; chunks go on from the two characters before them."""
        text = text.lower()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        tail = np.array([32], dtype=np.int64)
        for at in range(0, len(text), CHUNK):
            codes = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            end = [] if at + CHUNK < len(text) else [32]
            joined = np.concatenate([tail, np.where(self._letters(codes), codes, 32), end]).astype(np.int64)
            # runs of other characters become one space, which marks the edge of a word
            keep = np.concatenate([[True], (joined[1:] != 32) | (joined[:-1] != 32)])
            keep[: len(tail)] = True
            joined = joined[keep]
            found.append(self._count(joined, len(tail)))
            tail = joined[-2:]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(found) == 1:
            return found[0]
        return summed(found)

    def _count(self, codes: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams that end in ``codes[new:]``."""
        one = codes[new:]
        two = (codes[new - 1 : -1] << 21) | one
        at = max(new, 2)
        three = (codes[at - 2 : len(codes) - 2] << 42) | (codes[at - 1 : len(codes) - 1] << 21) | codes[at:]
        three = three[codes[at - 1 : len(codes) - 1] != 32]
        return np.unique(np.concatenate([one[one != 32], two, three]), return_counts=True)

    def ranked(self, text: str, n: int = PROFILE) -> np.ndarray:
        keys, counts = self.grams(text)
        return top_ranked(keys, counts, n)


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts and the sums of their counts."""
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)


def top_ranked(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent, most frequent first; ties by n-gram."""
    if len(keys) > 4 * n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:n]


class Profiles:
    """Profiles of all languages in one sorted table of n-grams by language ranks."""

    def __init__(self, ranked: dict[str, np.ndarray], size: int = PROFILE):
        self.size = size
        self.languages = sorted(ranked)
        self.keys = np.unique(np.concatenate([ranked[x] for x in self.languages])) if ranked else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), -1, dtype=np.int64)
        for j, x in enumerate(self.languages):
            self.ranks[np.searchsorted(self.keys, ranked[x]), j] = np.arange(len(ranked[x]))

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        """Nearest language and 1 - distance / largest possible distance."""
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, grams)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != grams)] = len(self.keys)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.languages[best], float(1.0 - apart[best] / (self.size * len(grams)))


def fit_profiles(
    labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", fit_rows: int | None = None, size: int = PROFILE, seed: int = 5, id_col: str = "doc_id"
) -> Profiles:
    """Profiles from all labelled rows; null labels and null texts teach nothing.

    n-grams are counted in the executors and only the top ``size`` of each
    language come to the driver.  On request about ``fit_rows`` rows of each
    language are used (all, if there are fewer), chosen by a hash of id and
    text, so that many copies of one text are not taken all at once.
    """
    text = F.col(text_col).cast("string")
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), unit_hash(F.col(id_col), text, seed=seed).alias("draw"))
    if fit_rows is not None:
        rows = join_small(rows, cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))), "lang").where(F.col("draw") * F.col("rows") < fit_rows)
    limit = HELD

    def handed(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            keys, n = summed(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        counter = GramCounter()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                found = counter.grams(text.as_py())
                held.setdefault(lang.as_py(), []).append(found)
                n += len(found[0])
                if n > limit:
                    held = {x: [summed(parts)] for x, parts in held.items()}
                    n = sum(len(parts[0][0]) for parts in held.values())
                    if 2 * n > limit:
                        yield from handed(held)
                        held, n = {}, 0
        yield from handed(held)

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).where(F.col("rank") <= size)
    ranked: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "rank", "gram").collect():
        ranked.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles({lang: np.array([g for _, g in sorted(x)], dtype=np.int64) for lang, x in ranked.items()}, size)


def predict_language(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with ``lang_pred`` and ``score`` (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0; very long
    texts are counted whole, a chunk at a time; equal distances go to the first
    language by name; repeated rows and empty tables are as they come.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        counter = GramCounter()
        for batch in batches:
            out = [profiles.predict(counter.ranked(t.as_py() or "", profiles.size)) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=[*keep, "lang_pred", "score"]
            )

    return rows.mapInArrow(work, schema)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves ``remainder``; null ids don't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; profiles are learnt from rows not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col, modulus, remainder).alias("held_out"))
    profiles = fit_profiles(rows.where(~F.col("held_out")))
    return predict_language(rows, profiles, keep=("doc_id", "held_out"))


def medians(scores: DataFrame) -> dict[str, float]:
    """Of ``lang, score``, scores from 0 to 1: the exact median of each language over all its rows.

    Equal scores are counted once; counts by bin tell where the middle is, and
    only the distinct scores of its one or two bins come to the driver.
    """
    tally = cut(scores.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))).withColumn("bin", F.floor(F.col("score") * BINS))
    bins: dict[str, list[tuple[int, int]]] = {}
    for r in tally.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        bins.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    if not bins:
        return {}
    middle: dict[str, tuple[int, int]] = {}
    wanted: set[tuple[str, int]] = set()
    for lang, found in bins.items():
        found.sort()
        upto = np.cumsum([n for _, n in found])
        low, high = (int(np.searchsorted(upto, rank, side="right")) for rank in ((upto[-1] - 1) // 2, upto[-1] // 2))
        below = int(upto[low]) - found[low][1]
        middle[lang] = (int(upto[-1] - 1) // 2 - below, int(upto[-1]) // 2 - below)
        wanted |= {(lang, found[low][0]), (lang, found[high][0])}
    near: dict[str, list[tuple[float, int]]] = {}
    rows = scores.sparkSession.createDataFrame(sorted(wanted), "lang string, bin bigint")
    for r in join_small(tally, rows, ["lang", "bin"]).select("lang", "score", "n").collect():
        near.setdefault(r["lang"], []).append((r["score"], r["n"]))
    out: dict[str, float] = {}
    for lang, found in near.items():
        found.sort()
        upto = np.cumsum([n for _, n in found])
        out[lang] = sum(found[int(np.searchsorted(upto, rank, side="right"))][0] for rank in middle[lang]) / 2
    return out


def score_floor(labelled: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang") -> float:
    """The least score that counts as a language: half the median of labelled rows, of the language where that is least.

    All labelled rows are scored.  A median holds with some noise among them;
    text that is no language scores a third of it at most, unless very short.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    scores = predict_language(rows, profiles, keep=("lang",)).where(F.col("lang_pred") != UNKNOWN).select("lang", "score")
    return min(medians(scores).values(), default=0.0) / 2


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns.

    Rejected are documents without a letter and those that are nearer to no
    profile than ``min_score`` (:func:`score_floor` of the labelled rows, if
    not given): encoded data, random letters, scripts without a profile.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).cast("string").alias("text"))
    profiles = fit_profiles(docs, lang_col, text_col, id_col=id_col)
    floor = score_floor(docs, profiles, text_col, lang_col) if min_score is None else min_score
    found = predict_language(rows, profiles, keep=("doc",))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= floor)).select("doc.*")
