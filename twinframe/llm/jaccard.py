"""Exact n-gram Jaccard join with prefix filters under several token orders.

A document is the set of its distinct word shingles.  If two sets are similar
enough, then under *any* global order of tokens they share one of their first
``n - ceil(t n) + 1`` tokens.  So candidates are asked to share such a token
under several orders, and only pairs that pass all of them are verified on the
whole sets.

Each order ranks a hash-chosen part of all tokens by document frequency, rarest
first, and the remaining tokens after them by hash; another hash gives another
order.  Only that part (and, for small sets, the few tokens beyond it that the
prefix reaches) is ever counted and shuffled, not all shingles.  At the first
token that two sets share, the number of tokens from there on bounds what they
can share at all; that bound and the other orders are part of the join.

Groups of copies are handled without all their pairs: equal word sequences are
one class with one representative; in each posting list members are first
compared with a few pivots a round; and only pairs that are then still in
different components are compared in full.  That loses no link that could join
two components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, give_back, join_small, release, scramble
from .common import cut_thin as cut

_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D]


class ShingleSets:
    """Hashes of a text's distinct k-word shingles, sorted, and a key of its word sequence."""

    def __init__(self, k: int):
        self.k = k
        self.words = WordHasher(lower=True)
        self.factors = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(k)]

    def __call__(self, text: str | None) -> tuple[np.ndarray, int, int]:
        hashes, _, _ = self.words((text or "").encode("utf-8", "surrogatepass"))
        digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
        k1, k2 = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
        n = len(hashes)
        if not n:
            return np.zeros(0, dtype=np.uint64), k1, k2
        if n < self.k:  # the whole sequence as one shingle, apart from those of k words
            total = n
            for f, h in zip(self.factors, hashes):
                total = (total * 31 + int(f) * int(h)) % (1 << 64)
            return scramble(np.array([total], dtype=np.uint64)), k1, k2
        mixed = self.factors[0] * hashes[: n - self.k + 1]
        for i in range(1, self.k):
            mixed = mixed + self.factors[i] * hashes[i : n - self.k + 1 + i]
        return np.unique(scramble(mixed)), k1, k2


def needed(n, percent: int):
    """ceil(percent/100 * n): least overlap of a set of ``n`` with a similar one."""
    return (percent * n + 99) // 100


def ordered_tokens(tokens: np.ndarray, order: int, share: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The set's tokens in the counted part of an order, and those that its prefix needs beyond."""
    keyed = np.sort((scramble(tokens ^ np.uint64(_MULTIPLIERS[order])) if order else tokens).view(np.int64))
    inside = int(np.searchsorted(keyed, counted_below(share)))
    prefix = len(tokens) - needed(len(tokens), percent) + 1 if len(tokens) else 0
    return keyed[:inside], keyed[inside : max(inside, prefix)]


def counted_below(share: float) -> int:
    return min(2**63 - 1, int(-(2.0**63) + share * 2.0**64))


def _list(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def shingle_rows(docs: DataFrame, k: int, percent: int, orders: list[tuple[int, float]], carry: tuple[str, ...] = ("doc",)) -> DataFrame:
    """From bigints ``carry`` and ``text``: ``carry, n, k1, k2`` and two token lists an order."""
    schema = ", ".join(f"{c} bigint" for c in (*carry, "n", "k1", "k2")) + "".join(f", in{o} array<bigint>, out{o} array<bigint>" for o, _ in orders)
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        sets = ShingleSets(k)
        for large in batches:
            for batch in _slices(large, 1000):
                n, k1, k2, lists = [], [], [], [[] for _ in range(2 * len(orders))]
                for text in batch.column(len(carry)):
                    tokens, a, b = sets(text.as_py())
                    n.append(len(tokens))
                    k1.append(a)
                    k2.append(b)
                    for i, (o, share) in enumerate(orders):
                        inside, outside = ordered_tokens(tokens, o, share, percent)
                        lists[2 * i].append(inside)
                        lists[2 * i + 1].append(outside)
                columns = [*batch.columns[: len(carry)], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), *map(_list, lists)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*carry, "text").mapInArrow(work, schema)


def prefixes(rows: DataFrame, order: int, share: float, percent: int) -> DataFrame:
    """Nodes with the shared tokens of their prefix: ``node, n, alone, common, prefix``.

    ``rows`` has ``node, n, in<order>, out<order>``, one row a node.  Tokens that
    no other node has cannot match; they come first in the order and are only
    counted (``alone``), so the first token of ``prefix`` stands at that place
    of the whole order, the next one behind it, and so on (those beyond the
    counted part may stand later).  ``common`` is the share of counted tokens that others
    have too; of a group of altered copies, the original has the largest.
    """
    below = counted_below(share)
    tokens = rows.select("node", F.explode(F.concat(f"in{order}", f"out{order}")).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(counts.hint("shuffle_hash"), "token")
    ranked = shared.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct((F.col("token") >= below).alias("beyond"), "df", "token"))).alias("ranked"),
        F.count(F.when(F.col("token") < below, 1)).alias("shared_in"),
    )
    room = F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100) + 1 - F.col("alone")
    return (
        rows.select("node", "n", F.size(f"in{order}").alias("size_in"))
        .join(ranked, "node")
        .withColumn("alone", F.col("size_in") - F.col("shared_in"))
        .withColumn("room", room.cast("int"))
        .where("room > 0")
        .select(
            "node",
            "n",
            "alone",
            (F.col("shared_in") / F.greatest(F.col("size_in"), F.lit(1))).alias("common"),
            F.transform(
                F.concat(
                    F.slice(F.filter("ranked", lambda x: ~x["beyond"]), F.lit(1), F.greatest(F.col("room"), F.lit(0))),
                    F.filter("ranked", lambda x: x["beyond"]),
                ),
                lambda x: x["token"],
            ).alias("prefix"),
        )
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest id reachable) for every node of ``edges(a, b)``.

    Alternating stars: every node ties its larger neighbours to its smallest
    one, then its smaller neighbours and itself to the smallest of them, until
    each component is one star: every node has one smaller neighbour, which has
    none.  Rounds grow with the logarithm of the longest
    path; each is one cut.  Minima are aggregated before the shuffle, and the
    joins back are such that AQE can split a hub's neighbours.
    """
    low, high = F.least("a", "b").cast("long"), F.greatest("a", "b").cast("long")
    left = cut(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    while True:
        both = left.union(left.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(nearest, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        tied = large.join(least, "a").select("a", "b", "least")
        small = tied.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(tied.select("a", F.col("least").alias("b")))
        left = cut(small.distinct())
        ends = left.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(left.select("b", F.lit(0), F.lit(1)))
        chained = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if not chained.agg(F.count(F.lit(1))).first()[0]:
            break
    return cut(left.select(F.col("a").alias("node"), F.col("b").alias("component")).union(left.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


class JaccardJoin:
    """The join over one table; see :func:`near_duplicates` for the parts it leaves.

    A node is a class of equal word sequences, named by the row of its member
    with the smallest id, so one id may carry several texts.
    """

    #: Longest prefix that posting lists carry along.
    CARRIED = 48
    #: Members from which a posting list is joined by steps of size.
    LONG_LIST = 64
    #: Pivots of a posting list in one round.
    PIVOTS = 3

    def __init__(self, docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", shares: tuple[float | None, ...] = (1.3, None, 1.5)):
        self.k, self.percent = k, percent
        #: Parts of the tokens that the orders count, from multiples of the prefix's share (None: all; one order at least, not the first).
        self.orders = [(o, 1.0 if s is None else min(1.0, s * (100 - percent) / 100)) for o, s in enumerate(shares)]
        release(docs.sparkSession)
        self.full = next(o for o, share in self.orders[1:] if share >= 1.0)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
        self._classes()

    def _classes(self) -> None:
        rows = cut(shingle_rows(self.docs, self.k, self.percent, self.orders[:1]).withColumn("row", F.monotonically_increasing_id()))
        # a thin copy, so that the token lists can be let go of early
        self.members = cut(rows.select("doc", "n", "k1", "k2"))
        filled = rows.where("n > 0 and doc is not null")
        classes = filled.groupBy("k1", "k2").agg(F.min(F.struct("doc", "row")).alias("least"), F.count(F.lit(1)).alias("size"))
        self.classes = cut(classes.select("k1", "k2", F.col("least.doc").alias("rep"), F.col("least.row").alias("node"), "size"))
        copies = cut(
            filled.select("row", "k1", "k2").join(self.classes.where("size > 1").select("k1", "k2", "node"), ["k1", "k2"]).where("row <> node").select("row")
        )
        self.reps = join_small(filled, copies, "row", "left_anti").select(F.col("row").alias("node"), "doc", "n", "in0", "out0")

    def _same_ids(self) -> DataFrame | None:
        """Links between classes that one id belongs to, ``a, b``; None if no id has two texts."""
        own = self.members.where("n > 0 and doc is not null")
        several = cut(own.groupBy("doc").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")).where("low <> high").select("doc"))
        if not several.take(1):
            return None
        nodes = join_small(own, several, "doc", "left_semi").join(self.classes, ["k1", "k2"]).select("doc", "node").distinct()
        least = nodes.groupBy("doc").agg(F.min("node").alias("a"))
        return cut(nodes.join(least, "doc").select("a", F.col("node").alias("b")).where("a <> b").distinct())

    def _candidates_ready(self) -> bool:
        """Filters of every order for the nodes that have a candidate under the first; False if none has."""
        o, share = self.orders[0]
        first = cut(prefixes(self.reps, o, share, self.percent).select("node", F.col("prefix").alias("p0")))
        self.reps = None
        release(self.docs.sparkSession)
        tokens = first.select("node", F.explode("p0").alias("token"))
        met = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("token")
        near = cut(tokens.join(met, "token", "left_semi").select("node").distinct().join(self.classes, "node").select("node", F.col("rep").alias("doc"), "k1", "k2"))
        if not near.take(1):
            return False
        wanted = near.select("doc", "node", F.col("k1").alias("want1"), F.col("k2").alias("want2"))
        again = shingle_rows(join_small(self.docs, wanted, "doc"), self.k, self.percent, self.orders[1:], carry=("node", "want1", "want2"))
        sets = cut(again.where("k1 = want1 and k2 = want2").drop("k1", "k2", "want1", "want2"))
        if sets.count() != near.count():  # repeated rows
            sets = cut(sets.dropDuplicates(["node"]))
        release(self.docs.sparkSession)
        # the order that counts all tokens has the whole set
        self.sets = sets.select("node", "n", F.col(f"in{self.full}").alias("whole"))
        filters = first
        for o, share in self.orders[1:]:
            found = cut(prefixes(sets, o, share, self.percent))
            filters = filters.join(found.select("node", *(["n", "common", "alone"] if o == 1 else []), F.col("prefix").alias(f"p{o}")), "node")
            release(self.docs.sparkSession)
        self.filters = cut(filters)
        release(self.docs.sparkSession)
        #: The second order counts all tokens, so its posting lists are the shortest.
        places = F.posexplode("p1").alias("at", "token")
        self.postings = cut(self.filters.select("node", "n", "common", (F.col("n") - F.col("alone")).alias("shared"), places).withColumn("left", F.col("shared") - F.col("at")).drop("at"))
        return True

    def _enough(self, a: str, b: str, n_a: str, n_b: str):
        """Whether sets of ``n_a`` and ``n_b`` tokens can be similar if no more than ``a``, ``b`` of them can be met."""
        return F.lit(100 + self.percent) * F.least(a, b) >= F.lit(self.percent) * (F.col(n_a) + F.col(n_b))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs ``a, b`` that are similar, on the whole sets."""
        for side in ("a", "b"):
            pairs = pairs.join(self.sets.select(F.col("node").alias(side), F.col("whole").alias(f"set_{side}")), side)
        both = F.size(F.array_intersect("set_a", "set_b"))
        release(self.docs.sparkSession)
        return cut(
            pairs.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either")).where(F.lit(100) * F.col("both") >= F.lit(self.percent) * F.col("either"))
        )

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that share prefix tokens under every order."""
        names = [f"p{o}" for o, _ in self.orders]
        for side in ("a", "b"):
            pairs = pairs.join(self.filters.select(F.col("node").alias(side), *[F.col(p).alias(f"{side}_{p}") for p in names]), side)
        for p in names:
            pairs = pairs.where(F.arrays_overlap(f"a_{p}", f"b_{p}"))
        return cut(pairs.select("a", "b"))

    def _pairs(self, postings: DataFrame, *unlike: str) -> DataFrame:
        """Pairs of members of one posting list (as of :meth:`_mixed`) that every order lets pass, each pair once.

        At the first token that two sets share, neither can share more than the
        tokens from there on (``left``); a similar pair has enough of them at
        that token, so the bound is part of the join.  Members with short
        prefixes carry those of all orders, so that the orders are intersected
        inside the join too and a pair is made only at the first token that
        both have; what others repeat is made distinct.  In lists of over
        ``LONG_LIST`` members the larger set of a pair meets only the steps of
        size in which that bound leaves it a partner.
        """
        names = [f"p{o}" for o, _ in self.orders]
        short = [F.when(F.size(p) <= self.CARRIED, F.col(p)).alias(p) for p in names]
        t = self.percent / 100
        step = lambda x: F.floor(F.log(F.greatest(x, F.lit(1)).cast("double")) * F.lit(-4 / np.log(t) if t < 1 else 1e3)).cast("int")
        rows = (
            postings.select("token", "node", "left", (F.col("rows") > self.LONG_LIST).alias("long"), *unlike)
            .join(self.filters.select("node", "n", *short), "node")
            # the largest set that this one can be similar to from here on
            .withColumn("most", F.floor(F.lit(100 + self.percent) * F.col("left") / F.lit(self.percent)) - F.col("n"))
        )
        low, high = step(F.floor(F.lit(t) * F.col("n"))), step(F.least("n", "most"))
        larger = rows.withColumn("step", F.explode(F.when(F.col("long"), F.when(F.col("most") > 0, F.sequence(F.least(low, high), high))).otherwise(F.array(F.lit(-1)))))
        smaller = rows.withColumn("step", F.when(F.col("long"), step(F.col("n"))).otherwise(-1))
        left, right = (side.select("token", "step", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "left", *names, *unlike)]) for s, side in (("a", larger), ("b", smaller)))
        condition = (left["token"] == right["token"]) & (left["step"] == right["step"])
        condition = condition & (F.struct("n_b", "node_b") < F.struct("n_a", "node_a")) & self._enough("left_a", "left_b", "n_a", "n_b")
        for c in unlike:
            condition = condition & (F.col(f"{c}_a") != F.col(f"{c}_b"))
        for p in names:
            condition = condition & F.coalesce(F.arrays_overlap(f"{p}_a", f"{p}_b"), F.lit(True))
        condition = condition & F.coalesce(F.get(F.array_intersect("p1_a", "p1_b"), F.lit(0)) == left["token"], F.lit(True))
        return self._filtered(cut(left.join(right, condition).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()))

    def links(self) -> DataFrame:
        """All links between class representatives: ``a, b, both, either`` (ids, sizes of intersection and union)."""
        if not self._candidates_ready():
            return self.docs.sparkSession.createDataFrame([], "a bigint, b bigint, both int, either int")
        found = self._verified(self._pairs(self._mixed(self.postings, None)[0]))
        for side in ("a", "b"):
            found = found.join(self.classes.select(F.col("node").alias(side), F.col("rep").alias(f"{side}_doc")), side)
        return found.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"), "both", "either")

    def _mixed(self, postings: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, int, int]:
        """Postings of tokens whose members have different labels, with ``rows`` of their list,
        their number, and how many pairs of members with different labels they hold."""
        rows = postings.drop("label", "rows")
        if labels is None:
            rows = rows.withColumn("label", F.col("node"))
        else:
            rows = join_small(rows, labels.select("node", "component"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
            rows = cut(rows)
        groups = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
        split = cut(
            groups.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares")).where("labels > 1")
        )
        total = split.agg(F.sum("rows").alias("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("squares")) / 2).alias("pairs")).first()
        return cut(join_small(rows, split.select("token", "rows"), "token")), total["rows"] or 0, int(total["pairs"] or 0)

    def representative_components(self, least_rounds: int = 1, rounds: int = 24, partners: int = 10) -> DataFrame | None:
        """``node, component`` of nodes that have a link, or None if none has.

        The members of a posting list meet ``PIVOTS`` pivots a round: the member that
        shares the largest part of its tokens at first, others by a hash.  After
        ``least_rounds`` this goes on while lists hold more than ``partners`` pairs
        a row and a round still takes away a tenth of the pairs.  Rounds only save work, so their bounds
        decide no result: the last step compares all that is left.
        """
        links = self._same_ids()
        labels = None if links is None else components(links)
        if not self._candidates_ready():
            return labels

        def joined(found: DataFrame) -> bool:
            nonlocal links, labels
            if not found.take(1):
                return False
            links = found if links is None else cut(links.union(found))
            labels = components(links)
            return True

        rows, size, pairs = self._mixed(self.postings, labels)
        for r in range(rounds):
            if not size or r >= least_rounds and pairs <= partners * size:
                break
            ranks = [F.xxhash64(F.lit(r * self.PIVOTS + i), "node").cast("double") for i in range(self.PIVOTS)]
            if r == 0:
                ranks[0] = F.col("common")
            tops = rows.groupBy("token").agg(*[F.max(F.struct(x.alias("rank"), (-F.col("node")).alias("back"), "n", "shared", "label")).alias(f"top{i}") for i, x in enumerate(ranks)])
            each = F.array_distinct(F.array(*[F.struct((-F.col(f"top{i}.back")).alias("pivot"), *[F.col(f"top{i}.{c}").alias(f"{c}_p") for c in ("n", "shared", "label")]) for i in range(self.PIVOTS)]))
            pivots = cut(tops.select("token", F.inline(each)))
            stars = join_small(rows, pivots, "token").where((F.col("label") != F.col("label_p")) & self._enough("shared", "shared_p", "n", "n_p"))
            stars = cut(stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
            before = pairs
            if joined(self._verified(self._filtered(stars)).select("a", "b")):
                release(self.docs.sparkSession)
                # labels only ever grow together, so what is left out stays so
                rows, size, pairs = self._mixed(rows, labels)
            if r >= least_rounds and pairs > 0.9 * before:
                break
        if size:
            joined(self._verified(self._pairs(rows, "label")).select("a", "b"))
        return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two documents link when ``100 * intersection >= percent * union`` of their
    k-word shingle sets (A-Z lower-cased); ``component_id`` is the smallest id
    that links reach.  Null texts and texts without words have no shingles and
    are alone.  Rows with a null id have a null component.  Rows of one id are
    one document, whose texts are linked with one another, equal or not.  Texts
    of any length are taken whole; ties decide nothing; an empty table gives an
    empty result; extra columns are ignored, whatever their names.
    """
    join = JaccardJoin(docs, k, percent, id_col, text_col)
    found = join.representative_components()
    classes = join.classes.select("k1", "k2", "node", "rep")
    if found is not None:
        named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("rep").alias("least"))
        classes = cut(named.join(least, "component").select("k1", "k2", F.col("least").alias("rep")))
    named = (
        join.members.withColumn("linked", F.col("n") > 0)
        .join(classes.select("k1", "k2", "rep").withColumn("linked", F.lit(True)), ["k1", "k2", "linked"], "left")
        .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")).alias("component_id"))
    )
    # an id with a text and without one
    blank = cut(join.members.where("doc is not null").groupBy("doc").agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low = 0 and high > 0").select(F.col("doc").alias("doc_id")))
    if blank.take(1):
        least = cut(join_small(named, blank, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least")))
        named = join_small(named, least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return named


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, with all columns of ``docs``: the row whose id names it.

    Where several rows have that id, the one with the smallest hash of its
    values stays, whatever the order of rows.  Rows with a null id all stay.  Nulls, empty and long texts,
    empty tables and clashing column names are as in :func:`near_duplicates`.
    """
    found = near_duplicates(docs, k, percent, id_col, text_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("key"))
    gone = cut(found.where("component_id <> doc_id").select(F.col("doc_id").alias("key")).distinct())
    kept = join_small(whole, gone, "key", "left_anti")
    several = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("key")))
    if several.take(1):
        alike = F.struct(F.xxhash64(f"doc.{text_col}").alias("t"), F.xxhash64("doc").alias("h"))
        one = join_small(kept, several, "key", "left_semi").groupBy("key").agg(F.min_by("doc", alike).alias("doc")).select("doc", "key")
        kept = join_small(kept, several, "key", "left_anti").unionByName(one)
    return kept.select("doc.*")
