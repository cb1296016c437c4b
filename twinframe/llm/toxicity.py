"""Toxicity scores from a bidirectional gated recurrent network in numpy.

Each word enters as a word embedding and a pooled embedding of its
characters (runs of four bytes with word edges).  A GRU reads windows of words in both
directions, attention pools its states, and a logistic unit gives the window's
logit.  All overlapping windows of a text are scored; the largest logit,
calibrated, is the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, cut, join_small, received, shared_model, unit_hash
from .langid import held_out

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS = 15, 16
WORD_DIM, CHAR_DIM, HIDDEN = 16, 16, 12
#: Parts of the labelled documents: the last one calibrates, the others train.
FOLDS = 10
#: Bounds on labelled documents of either class for fitting: their number, and the bytes of their texts, on average.
FIT_ROWS, FIT_BYTES = 4000, 8 << 20
#: Labelled documents met in all epochs together, and bounds on the number of epochs.
MEETINGS, EPOCHS = 64_000, (6, 24)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
#: Bytes as the character input sees them: anything but letters and digits is an edge.
_SEEN = np.where(_LETTER[_LOWER], _LOWER, 32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Words:
    """The words of some texts: bucket of each, and buckets of its character runs."""

    def __init__(self, hasher: WordHasher):
        self.hasher = hasher

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, bucket of each byte's trigram, starts, ends)."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        plain = _SEEN[raw].astype(np.uint8)
        hashes, starts, ends = self.hasher(plain.tobytes())
        padded = np.full(len(plain) + 3, 32, dtype=np.uint64)
        padded[1:-2] = plain
        four = padded[:-3] << np.uint64(24) | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(8) | padded[3:]
        four = (four * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHAR_BITS)
        return hashes, four.astype(np.int64), starts, ends


def word_bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def word_edges(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Edges for ``reduceat`` over bytes, whose even results are the words."""
    edges = np.stack([starts, ends], axis=1).ravel()
    return edges[:-1] if edges[-1] >= len(grams) else edges


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover ``n`` words, one at least if there are any."""
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    return np.arange(0, max(1, -(-(n - WINDOW) // STRIDE) + 1)) * STRIDE


class Network:
    """Parameters, forward and backward passes; everything is float32."""

    INPUT = CHAR_DIM + WORD_DIM

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * (1.0 / np.sqrt(shape[0]))).astype(np.float32)
        self.p = {
            # embeddings start at zero, so words never met in training stay neutral
            "word": np.zeros((1 << WORD_BITS, WORD_DIM), dtype=np.float32),
            "char": np.zeros((1 << CHAR_BITS, CHAR_DIM), dtype=np.float32),
            "att": small(2 * HIDDEN),
            "out": small(2 * HIDDEN),
            "bias": np.full(1, -1.0, dtype=np.float32),
        }
        for d in ("f", "b"):
            self.p |= {f"W{d}": small(self.INPUT, 3 * HIDDEN), f"U{d}": small(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, dtype=np.float32)}
        self.scale, self.shift, self.blank = 1.0, 0.0, -4.0

    # ---- inputs
    def inputs(self, buckets: np.ndarray, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One row a word: mean embedding of its characters' runs, embedding of the word."""
        x = np.empty((len(buckets), self.INPUT), dtype=np.float32)
        if not len(buckets):
            return x
        length = (ends - starts).astype(np.float32)[:, None]
        x[:, :CHAR_DIM] = np.add.reduceat(self.p["char"][grams], word_edges(grams, starts, ends), axis=0)[::2] / length
        x[:, CHAR_DIM:] = self.p["word"][buckets]
        return x

    # ---- one direction over time-major windows of projected inputs
    def _step(self, a: np.ndarray, h: np.ndarray, d: str):
        g = h @ self.p[f"U{d}"]
        zr = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        return z, r, c, g[:, 2 * HIDDEN :], z * (h - c) + c

    def run(self, projected: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """States (time, window, 2 HIDDEN); ``projected`` has a row a word, ``index`` is (time, window)."""
        steps, width = index.shape
        states = np.empty((steps, width, 2 * HIDDEN), dtype=np.float32)
        tape: dict[str, list] = {"f": [], "b": []}
        for d, order, part in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, None))):
            h = np.zeros((width, HIDDEN), dtype=np.float32)
            for t in order:
                z, r, c, u, new = self._step(projected[d][index[t]], h, d)
                if mask is not None:
                    new = np.where(mask[t][:, None], new, h)
                if keep:
                    tape[d].append((t, h, z, r, c, u))
                states[t, :, part] = h = new
        return states, tape

    def pool(self, states: np.ndarray, mask: np.ndarray | None):
        e = states @ self.p["att"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tw,twh->wh", a, states)
        return a, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in ("f", "b")}

    def gradients(self, words, grams, starts, ends, first, length, y):
        """Loss and gradients for windows over the given words; ``y`` is 0 or 1."""
        p = self.p
        x = self.inputs(words, grams, starts, ends)
        projected = self.project(x)
        steps = np.arange(WINDOW)[:, None]
        mask = steps < length
        index = first + np.minimum(steps, length - 1)
        states, tape = self.run(projected, index, mask, keep=True)
        a, pooled, logit = self.pool(states, mask)
        prob = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        dl = ((prob - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], dtype=np.float32)}
        dpool = dl[:, None] * p["out"]
        da = np.einsum("wh,twh->tw", dpool, states)
        de = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tw,twh->h", de, states)
        dstates = a[:, :, None] * dpool + de[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            gU, dproj = np.zeros_like(p[f"U{d}"]), np.zeros_like(projected[d])
            dh = np.zeros((len(y), HIDDEN), dtype=np.float32)
            for t, h, z, r, c, u in reversed(tape[d]):
                dh = dh + dstates[t, :, part]
                m = mask[t][:, None].astype(np.float32)
                dn, through = dh * m, dh * (1 - m)
                dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * u * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                gU += h.T @ dg
                np.add.at(dproj, index[t], np.concatenate([dz, dr, dc], axis=1))
                dh = dn * z + dg @ p[f"U{d}"].T + through
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = gU, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p[f"W{d}"].T
        spread = np.repeat(dx[:, :CHAR_DIM] / (ends - starts)[:, None], ends - starts, axis=0)
        inside = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)]) if len(starts) else np.zeros(0, int)
        g["char"], g["word"] = np.zeros_like(p["char"]), np.zeros_like(p["word"])
        np.add.at(g["char"], grams[inside], spread.astype(np.float32))
        np.add.at(g["word"], words, dx[:, CHAR_DIM:])
        return loss, g


def _odds(seen: list[np.ndarray], labels: np.ndarray, bits: int) -> np.ndarray:
    """Log odds of a toxic document for each bucket, from documents that have it; shrunk when few do."""
    hits = [np.bincount(np.concatenate([s for s, y in zip(seen, labels) if y == v] or [np.zeros(0, int)]), minlength=1 << bits) for v in (0, 1)]
    base = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    odds = np.log((hits[1] + 0.1) / (hits[0] + 0.1)) - base
    n = hits[0] + hits[1]
    return (np.where(n >= 2, odds * n / (n + 3.0), 0.0) / 2).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, class_weights: tuple[float, float] = (1.0, 1.0), epochs: int | None = None, seed: int = 3) -> Network:
    """Fit on whole labelled texts.

    A toxic document need be toxic in one window only, so every epoch scores
    all windows and learns from each document's highest ones.  In the first
    epoch, when nothing is learnt yet, log odds of words and characters (from
    other folds) point at a window; they are no input of the network.  Epochs
    fall with the number of documents (``MEETINGS``), batches grow with it.
    ``class_weights`` undo the sampling of the classes in the calibration.
    """
    rng = np.random.default_rng(seed)
    net, words = Network(seed), Words(WordHasher())
    labels = np.asarray(labels, dtype=np.int64)
    if len(labels) < 2 * FOLDS or labels.min() == labels.max():
        return net  # nothing to tell apart; every score is the same low one
    epochs = epochs or int(np.clip(round(MEETINGS / len(labels)), *EPOCHS))
    docs = [words.read(t) for t in texts]
    bucket = [word_bucket(d[0]) for d in docs]
    fold = rng.permutation(len(docs)) % FOLDS
    seen_words, seen_chars = [np.unique(b) for b in bucket], [np.unique(d[1]) for d in docs]

    def tables(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick = np.flatnonzero(own)
        return tuple(_odds([seen[i] for i in pick], labels[pick], bits) for seen, bits in ((seen_words, WORD_BITS), (seen_chars, CHAR_BITS)))

    filled = np.array([i for i, b in enumerate(bucket) if len(b)], dtype=np.int64)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def best_windows(f: int, top: int):
        """(document, start) of each document's highest windows in a fold, and its largest logit."""
        chosen, most, mine_all = [], [], filled[fold[filled] == f]
        for at in range(0, len(mine_all), 500):
            own = mine_all[at : at + 500]
            logit, which, begin = _score([docs[i] for i in own], net)
            for j, i in enumerate(own):
                mine = np.flatnonzero(which == j)
                order = mine[np.argsort(-logit[mine], kind="stable")]
                most.append(logit[order[0]])
                pick = list(order[: 1 if labels[i] else top])
                if not labels[i]:
                    pick.append(mine[rng.integers(len(mine))])
                chosen += [(i, int(begin[k])) for k in pick]
        return chosen, mine_all, np.array(most, dtype=np.float32)

    def first_windows(f: int):
        """Windows that word and character odds point at."""
        word_odds, char_odds = tables(fold != f)  # a document never meets odds that its own label has gone into
        chosen = []
        for i in filled[fold[filled] == f]:
            d = docs[i]
            hint = np.maximum.reduceat(char_odds[d[1]], word_edges(d[1], d[2], d[3]))[::2] + word_odds[bucket[i]]
            s = window_starts(len(bucket[i]))
            chosen.append((i, int(s[int(np.argmax([hint[a : a + WINDOW].max() for a in s]))])))
            if not labels[i]:
                chosen.append((i, int(s[rng.integers(len(s))])))
        return chosen

    for epoch in range(epochs):
        batches = []
        for f in range(FOLDS - 1):  # the last fold is kept for calibration
            chosen = first_windows(f) if epoch == 0 else best_windows(f, 2)[0]
            positive = [c for c in chosen if labels[c[0]]]
            times = max(1, min(6, (len(chosen) - len(positive)) // max(1, 3 * len(positive))))
            chosen = [c for c in chosen if not labels[c[0]]] + positive * times
            rng.shuffle(chosen)
            size = 256 if len(chosen) > 2000 else 128 if len(chosen) > 500 else 32
            batches += [(f, chosen[at : at + size]) for at in range(0, len(chosen), size)]
        for k in rng.permutation(len(batches)):
            f, part = batches[k]
            b, tri, st, en, first, length, y, n, m = [], [], [], [], [], [], [], 0, 0
            for i, s in part:
                i, s = int(i), int(s)
                d, e = docs[i], min(s + WINDOW, len(bucket[i]))
                lo, hi = d[2][s], d[3][e - 1]
                b.append(bucket[i][s:e])
                tri.append(d[1][lo:hi])
                st.append(d[2][s:e] - lo + m)
                en.append(d[3][s:e] - lo + m)
                first.append(n)
                length.append(e - s)
                y.append(labels[i])
                n, m = n + e - s, m + hi - lo
            _, g = net.gradients(*(np.concatenate(v) for v in (b, tri, st, en)), np.array(first), np.array(length), np.array(y, dtype=np.float32))
            step += 1
            rate = 0.01 * 0.1 ** (epoch / epochs)
            for k, v in net.p.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.01 * (g[k] * g[k] - m2)
                v -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                if k in ("word", "char"):
                    v *= np.float32(1 - 0.02 * rate)
    _, own, most = best_windows(FOLDS - 1, 1)
    net.blank = float(np.median(most[labels[own] == 0])) if (labels[own] == 0).any() else net.blank
    if labels[own].min() != labels[own].max():
        net.scale, net.shift = _calibrate(most, labels[own], class_weights)
    return net


def _calibrate(logit: np.ndarray, y: np.ndarray, class_weights: tuple[float, float]) -> tuple[float, float]:
    """Slope (drawn to 1, at least 0) and intercept of a logistic fit by Newton's method."""
    a, b = 1.0, 0.0
    x = logit.astype(np.float64)
    each = np.where(y == 1, class_weights[1], class_weights[0])
    each = each / each.mean()
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = each * p * (1 - p) + 1e-9
        ga, gb = (each * (p - y) * x).sum() + (a - 1.0), (each * (p - y)).sum()
        haa, hab, hbb = (w * x * x).sum() + 1.0, (w * x).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 0.0), b


def _score(docs: list, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, document, start) of every window of read documents; inputs are made once a distinct word."""
    n = np.array([len(d[0]) for d in docs])
    base = np.concatenate([[0], np.cumsum(n)])
    shift = np.concatenate([[0], np.cumsum([len(d[1]) for d in docs])])
    hashes = np.concatenate([d[0] for d in docs])
    _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    grams = np.concatenate([d[1] for d in docs])
    starts = np.concatenate([d[2] + s for d, s in zip(docs, shift)])[one]
    ends = np.concatenate([d[3] + s for d, s in zip(docs, shift)])[one]
    # the distinct words in order of place, so that their bytes can be summed in one sweep
    order = np.argsort(starts)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    x = net.inputs(word_bucket(hashes[one])[order], grams, starts[order], ends[order])
    begin = [window_starts(k) for k in n]
    which = np.repeat(np.arange(len(docs)), [len(b) for b in begin])
    begin = np.concatenate(begin)
    length = np.minimum(WINDOW, n[which] - begin)
    return _logits_by_word(net, x, place[back], base[which] + begin, length), which, begin


def _logits_by_word(net: Network, x: np.ndarray, word: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), dtype=np.float32)
    projected = net.project(x)
    steps = np.arange(WINDOW)[:, None]
    for full in (True, False):
        group = np.flatnonzero((length == WINDOW) == full)
        for at in range(0, len(group), 1024):
            own = group[at : at + 1024]
            mask = None if full else steps < length[own]
            index = word[first[own] + (steps if full else np.minimum(steps, length[own] - 1))]
            out[own] = net.pool(net.run(projected, index, mask)[0], mask)[2]
    return out


def score_texts(texts: list[str], net: Network, words: Words) -> np.ndarray:
    """Score (0 to 1) of every whole text; texts without words get the blank score."""
    most = np.full(len(texts), net.blank, dtype=np.float64)
    group: list[int] = []
    read: list = []
    size = 0

    def flush():
        if read:
            logit, which, _ = _score(read, net)
            top = np.full(len(read), -np.inf)
            np.maximum.at(top, which, logit)
            most[group] = top

    for i, text in enumerate(texts):
        d = words.read(text)
        if len(d[0]):
            group.append(i)
            read.append(d)
            size += len(d[1])
        if size > 1 << 21:
            flush()
            group, read, size = [], [], 0
    flush()
    return _sigmoid(net.scale * most + net.shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Network:
    """Train on whole labelled documents of any length, chosen by a hash of the id: of
    each class about ``fit_rows`` at most, and about ``fit_bytes`` bytes of text."""
    known = cut(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("y")))
    text = F.col(text_col).cast("string")
    found = join_small(docs.where(text.isNotNull()).select(F.col(id_col).alias("_id"), F.octet_length(text).alias("bytes")), known, "_id")
    counts = {r["y"]: (r["rows"], r["bytes"]) for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("bytes").cast("long")).alias("bytes")).collect()}
    pick = F.lit(0.0)
    for y, (n, size) in counts.items():
        pick = F.when(F.col("y") == y, F.lit(min(1.0, fit_rows / n, fit_bytes / max(1, size)))).otherwise(pick)
    sample = cut(known.where(unit_hash(F.col("_id"), seed=41) < pick))
    rows = join_small(docs.where(text.isNotNull()).select(F.col(id_col).alias("_id"), text.alias("t")), sample, "_id").collect()
    rows = sorted({(r["_id"], r["t"], r["y"]) for r in rows})
    y = np.array([y for _, _, y in rows], dtype=np.int64)
    weights = tuple(counts.get(v, (0, 0))[0] / max(1, int((y == v).sum())) for v in (0, 1))
    return train([t for _, t, _ in rows], y, weights)


def score_documents(docs: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """The columns in ``keep`` with ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double").add("predicted", "integer")
    shared = shared_model(docs.sparkSession, net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = received(shared), Words(WordHasher())
        for large in batches:
            for at in range(0, large.num_rows, 2000):
                batch = large.slice(at, 2000)
                score = score_texts([t.as_py() or "" for t in batch.column(len(keep))], model, words)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keep)], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*keep, "score", "predicted"]
                )

    return rows.mapInArrow(work, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, remainder: int = 1, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Labels are learnt from rows that are not held out; without two classes
    among them every score is the same low one.  Null and empty texts and texts
    without a letter or digit get the score of a clean document.  Whole texts
    of any length are scored; repeated rows get equal scores; an empty table
    gives an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col, modulus, remainder).alias("held_out"))
    net = fit(rows.where(~F.col("held_out")), labels.where(~held_out(id_col, modulus, remainder)).withColumnRenamed(id_col, "doc_id"))
    return score_documents(rows, net, keep=("doc_id", "held_out"), threshold=threshold)
