"""Each operator against a brute-force version on a small fixture with nulls,
empty and long texts, ties, repeated rows and columns with clashing names."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import ann, jaccard, langid, lengths, licenses, mixing, pieces, quality, sharding, toxicity
from twinframe.llm.common import WordHasher

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FR = "le chat est dans la maison avec les enfants et nous sommes allés au marché hier pour acheter du pain "
EN = "the cat is in the house with the children and we went to the market yesterday to buy some bread "
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, label string, token int, kept string"


def corpus():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        base = (EN if i % 2 else FR).split()
        rng.shuffle(base)
        body = " ".join(base + [f"w{rng.integers(0, 5000)}" for _ in range(40)])
        rows.append((i, body, "en" if i % 2 else "fr", f"src{i % 5}"))
    near = rows[3][1].split()
    near[5] = "changed"
    rows += [
        (100, " ".join(near), "en", "src1"),
        (101, rows[3][1].upper(), "en", "src2"),
        (102, rows[3][1], "en", None),
        (103, None, None, "src1"),
        (104, "", "en", "src1"),
        (105, " \n\t ", "en", None),
        (106, "one two", "en", "src3"),
        (107, "One  TWO", "en", "src3"),
        (108, "1234 5678 !!!", "en", "src3"),
        (109, "é" * 50_000 + " " + EN * 300, "en", "src4"),
        (110, "same line here\n" * 30 + EN, "en", "src0"),
        (5, rows[5][1], "en", "src0"),
    ]
    rows += [(200 + i, "shared line of every page on this host\n" + f"a{i} b{i} c{i} d{i}", "en", "src0") for i in range(14)]
    rows.append((300, "x <b> & | $ a\x0bb\x0cc\rd", "en", "src0"))
    return [(*r, len(r[1] or ""), 7, "x", 1, "no") for r in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_word_hasher():
    for t in ["", "a", " a  bb\tccc\x0bd ", "éé É x", "a" * 70_000 + " b"]:
        h, s, e = WordHasher(lower=False)(t.encode())
        raw = t.encode()
        assert [raw[a:b] for a, b in zip(s, e)] == raw.split()
    h1, h2 = (WordHasher()(x)[0] for x in (b"Abc x", b"yy abc"))
    assert h1[0] == h2[1] and h1[0] != h1[1]


def test_sharding(docs, none):
    rows = [r.asDict() for r in sharding.shard_by_mixture(docs, 16).collect()]
    assert len(rows) == len(ROWS)
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    sizes = [len(v) for v in shards.values()]
    assert set(shards) == set(range(16)) and max(sizes) - min(sizes) <= 1
    for v in shards.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    again = sharding.shard_by_mixture(docs.repartition(5), 16)
    assert collections.Counter((r["doc_id"], r["shard"]) for r in again.collect()) == collections.Counter((r["doc_id"], r["shard"]) for r in rows)
    for s in ("src0", "src1", None):
        n = sum(r["source"] == s for r in rows)
        for v in shards.values():
            assert abs(sum(r["source"] == s for r in v) - n / 16) <= 2
    assert sharding.shard_by_mixture(none).count() == 0


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        left = total - sum(target.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(docs, none):
    rows = mixing.plan_mix(docs).collect()
    sizes = collections.Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    want = water(dict(sizes))
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in ("src0", "src1", "src2"):
        assert abs(taken[s] - want[s]) < 0.2 * want[s]
    assert collections.Counter(mixing.plan_mix(docs.repartition(7)).collect()) == collections.Counter(rows)
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    copies = collections.Counter()
    for r in rows:
        copies[r["doc_id"]] += r["copies"]
    assert mixed == +copies and mixing.mix(docs).columns == docs.columns
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0


def test_language_id(docs, none):
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for r in ROWS:
        got = rows[r[0]]
        assert got["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) and 0 <= got["score"] <= 1
        assert (got["lang_pred"] == "und") == (not any(c.isalpha() for c in r[1] or ""))
    good = [rows[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(60)]
    assert np.mean(good) > 0.9
    assert langid.identify(none).count() == 0
    kept = {r["doc_id"] for r in langid.keep_identified(docs).collect()}
    assert not kept & {103, 104, 105, 108} and set(range(60)) <= kept


def test_language_floor(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    noise = []
    for n in (400, 3000):
        raw = base64.b64encode(rng.bytes(n)).decode()
        noise += [" ".join(raw[i : i + 20] for i in range(0, len(raw), 20)), raw]
        noise.append(" ".join(rng.bytes(8).hex() for _ in range(n // 8)))
        noise.append(" ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(n // 6)))
    rows = [r[:3] for r in ROWS[:60]] + [(500 + i, t, None) for i, t in enumerate(noise)]
    kept = {r["doc_id"] for r in langid.keep_identified(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert kept == set(range(60))


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 1 << 20])
def test_language_grams_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    text = "Ab, bà! x"
    spaced = " ab bà x "
    want = collections.Counter(c for c in spaced if c != " ")
    want.update(spaced[i : i + 2] for i in range(len(spaced) - 1))
    want.update(g for i in range(len(spaced) - 2) if (g := spaced[i : i + 3])[1] != " ")
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    keys, counts = langid.GramCounter().grams(text)
    assert dict(zip(keys.tolist(), counts.tolist())) == {code(g): n for g, n in want.items()}


def test_language_fit_sample_is_bounded(spark):
    rows = [(i, EN, "en") for i in range(400)] + [(400 + i, f"{FR} {i}", "fr") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert langid.fit_profiles(docs, fit_rows=40).languages == ["en", "fr"]
    # of 400 copies about 40 are drawn, not all or none
    drawn = docs.where("lang = 'en'").select((langid.unit_hash(docs.doc_id, docs.text, seed=5) * 400 < 40).alias("x")).where("x").count()
    assert 20 < drawn < 65


def test_language_fit_and_floor_take_all_rows(spark, monkeypatch):
    """Profiles and threshold of more rows than the former bound on a sample (1,500 a language) are those of all rows."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(4200):
        words = (FR if i < 100 else EN).split()
        rows.append((i, " ".join(rng.choice(words, rng.integers(3, 12))) + f" {chr(97 + i % 26)}x", "fr" if i < 100 else "en"))
    docs = spark.createDataFrame([*rows, (9000, None, "en"), (9001, EN, None), (9002, "", "en"), (9003, "12 34", "fr")], "doc_id bigint, text string, lang string").repartition(3)
    counter, counts = langid.GramCounter(), {"en": collections.Counter(), "fr": collections.Counter()}
    for _, text, lang in rows:
        counts[lang].update(dict(zip(*(x.tolist() for x in counter.grams(text)))))
    want = langid.Profiles({lang: np.array([g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]) for lang, c in counts.items()})
    for held in (langid.HELD, 50):
        monkeypatch.setattr(langid, "HELD", held)
        got = langid.fit_profiles(docs)
        assert got.languages == want.languages and np.array_equal(got.keys, want.keys) and np.array_equal(got.ranks, want.ranks)
    scores = {"en": [], "fr": []}
    for _, text, lang in rows:
        scores[lang].append(want.predict(counter.ranked(text))[1])
    for bins in (langid.BINS, 1):
        monkeypatch.setattr(langid, "BINS", bins)
        assert langid.score_floor(docs, want) == min(float(np.median(x)) / 2 for x in scores.values())


def test_language_medians(spark):
    rng = np.random.default_rng(9)
    groups = {"a": [0.5], "b": [0.0, 1.0], "c": [1.0] * 4, "d": [0.1, 0.1, 0.3, 0.3], "e": rng.random(1001).tolist(), "f": (rng.random(500) / 1e4).round(6).tolist()}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "lang string, score double").repartition(3)
    assert langid.medians(rows) == {g: float(np.median(xs)) for g, xs in groups.items()}
    assert langid.medians(rows.limit(0)) == {}


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(rows, k, percent):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.add((a, b))
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}, links


def near_group():
    """A group of altered copies, chains between them, and pages sharing a passage."""
    rng = np.random.default_rng(7)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(40):
        w = list(base)
        for at in rng.choice(80, rng.integers(0, 4), replace=False):
            w[at] = f"v{rng.integers(0, 1000)}"
        rows.append((1000 + i, " ".join(w)))
    w = list(base)
    for i in range(12):  # a chain whose ends are unlike
        w[i * 6 % 80] = f"c{i}"
        rows.append((2000 + i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(3000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(int(rng.integers(1, 12))))) for i in range(30)]
    return rows


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, none, k, percent):
    extra = near_group()
    rows = [(r[0], r[1]) for r in ROWS] + extra
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string")).withColumn("component", F.lit("x")).coalesce(3).cache()
    want, links = linked(rows, k, percent)
    got = jaccard.near_duplicates(df, k, percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    if k == 4:
        return
    found = {(r["a"], r["b"]) for r in jaccard.JaccardJoin(df, k, percent).links().collect()}
    reps = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        reps.setdefault(tuple((t or "").encode().lower().split()), i)
    assert found == {(a, b) for a, b in links if a in reps.values() and b in reps.values()}
    df = df.where("doc_id < 300")
    want, _ = linked([r for r in rows if r[0] < 300], k, percent)
    kept = [r["doc_id"] for r in jaccard.keep_one_of_each(df, k, percent).collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})
    assert jaccard.near_duplicates(none, k, percent).count() == 0


def test_jaccard_null_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "g")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(df, 4, 85).collect()} == {(None, None), (1, 1), (2, 2)}


def test_jaccard_one_id_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, 0), (1, b, 1), (2, a + " z", 2), (3, b + " z", 3), (4, "", 4), (4, a + " y", 5), (5, "other words of no other text", 6), (9, None, 7), (9, "", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _gone int").withColumn("key", F.lit(1)).withColumn("doc", F.lit("d")).repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, 4, 85).collect()}
    assert got == {(1, 57, 1), (2, 58, 1), (3, 58, 1), (4, 0, 1), (4, 58, 1), (5, 3, 5), (9, 0, 9)}
    kept = jaccard.keep_one_of_each(df, 4, 85)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 9]
    again = jaccard.keep_one_of_each(df.repartition(5), 4, 85)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in kept.collect()}


def test_jaccard_long_lists(spark, monkeypatch):
    """The join by steps of size loses no link, with every list counted as long."""
    monkeypatch.setattr(jaccard.JaccardJoin, "LONG_LIST", 1)
    rows = near_group()
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(60)]
    rows += [(5000 + i, " ".join(passage + [f"q{i}_{j}" for j in range(int(rng.integers(0, 14)))])) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, percent in ((4, 85), (5, 80), (4, 100)):
        want, links = linked(rows, k, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, k, percent).collect()} == want
        reps = {}
        for i, t in sorted(rows):
            reps.setdefault(t, i)
        found = {(r["a"], r["b"]) for r in jaccard.JaccardJoin(df, k, percent).links().collect()}
        assert found == {(a, b) for a, b in links if a in reps.values() and b in reps.values()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (50, 101)]
    got = {r["node"]: r["component"] for r in jaccard.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 50 and got[100] == 50


def test_jaccard_steps(spark, monkeypatch):
    """Thin tables in many partitions are read by few tasks, and a finished star costs no further round."""
    rows = near_group()
    want, _ = linked(rows, 4, 85)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        join = jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85)
        nodes = join.classes.select("node", "rep").collect()
        labels = {r["node"]: r["component"] for r in join.representative_components().collect()}
        few = 2 * spark.sparkContext.defaultParallelism
        assert all(df.rdd.getNumPartitions() <= few for df in (join.classes, join.filters, join.postings))
        cuts = []
        monkeypatch.setattr(jaccard, "cut", lambda df, f=jaccard.cut: cuts.append(1) or f(df))
        star = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, 21)], "a bigint, b bigint")
        assert {r["node"]: r["component"] for r in jaccard.components(star).collect()} == {i: 1 for i in range(1, 9)} | {20: 20, 21: 20}
        assert len(cuts) == 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    least = {}
    for r in nodes:
        c = labels.get(r["node"], r["node"])
        least[c] = min(least.get(c, r["rep"]), r["rep"])
    assert {r["rep"]: least[labels.get(r["node"], r["node"])] for r in nodes} == {i: want[i][1] for i in (r["rep"] for r in nodes)}


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(300):
        w = [f"w{rng.integers(0, 200)}" for _ in range(int(rng.integers(5, 120)))]
        if i % 4 == 0:
            w[int(rng.integers(len(w)))] = str(rng.choice(["idiotic", "Moron!", "scum"]))
        rows.append((i, " ".join(w), "en", "s", 0, 0, "", 0, ""))
        labels.append((i, 1, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, SCHEMA).union(docs.where("doc_id >= 300 or text is null or text = ''"))
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    test = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    toxic, clean = ([r["predicted"] for r in test if (r["doc_id"] % 4 == 0) == v] for v in (True, False))
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.1
    assert toxicity.toxicity(none, lab).count() == 0
    unlearnt = toxicity.toxicity(docs, lab.limit(0)).collect()
    assert len(unlearnt) == len(ROWS) and not any(r["predicted"] for r in unlearnt)


def test_forward_brute_force():
    """Logits of all overlapping windows against one word and one unit at a time."""
    net, w = toxicity.Network(2), toxicity.Words(WordHasher())
    rng = np.random.default_rng(8)
    net.p = {k: (0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in net.p.items()}
    texts = [" ".join(f"Wörd{rng.integers(30)}!" for _ in range(n)) for n in (75, 1, 32, 33)]
    docs = [w.read(t) for t in texts]
    logit, which, begin = toxicity._score(docs, net)
    H, p = toxicity.HIDDEN, {k: v.astype(np.float64) for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))

    def naive(d, start):
        rows = range(start, min(start + toxicity.WINDOW, len(d[0])))
        xs = [np.concatenate([p["char"][d[1][d[2][i] : d[3][i]]].mean(axis=0), p["word"][toxicity.word_bucket(d[0][i : i + 1])[0]]]) for i in rows]
        states = [np.zeros(2 * H) for _ in xs]
        for name, order, at in (("f", range(len(xs)), 0), ("b", reversed(range(len(xs))), H)):
            h = np.zeros(H)
            for t in order:
                a, g = xs[t] @ p[f"W{name}"] + p[f"c{name}"], h @ p[f"U{name}"]
                z, r = sig(a[:H] + g[:H]), sig(a[H : 2 * H] + g[H : 2 * H])
                c = np.tanh(a[2 * H :] + r * g[2 * H :])
                h = z * h + (1 - z) * c
                states[t][at : at + H] = h
        e = np.exp([s @ p["att"] for s in states])
        return sum(x / e.sum() * s for x, s in zip(e, states)) @ p["out"] + p["bias"][0]

    assert [list(begin[which == i]) for i in range(4)] == [[0, 16, 32, 48], [0], [0], [0, 16]]
    for k in range(len(logit)):
        assert logit[k] == pytest.approx(naive(docs[which[k]], int(begin[k])), rel=1e-3, abs=1e-4)


def test_language_choice_brute_force():
    counter, size = langid.GramCounter(), 60
    profiles = langid.Profiles({"fr": counter.ranked(FR, size), "en": counter.ranked(EN, size), "xx": counter.ranked("zzz yyy", size)}, size)
    for text in (EN, FR, "the chat is dans", "zz", "q", FR + EN):
        own = list(counter.ranked(text, size))
        apart = {}
        for lang in ("en", "fr", "xx"):
            ranks = {g: i for i, g in enumerate(counter.ranked({"en": EN, "fr": FR, "xx": "zzz yyy"}[lang], size))}
            apart[lang] = sum(abs(i - ranks[g]) if g in ranks else size for i, g in enumerate(own))
        best = min(sorted(apart), key=apart.get)
        assert profiles.predict(np.array(own)) == (best, pytest.approx(1 - apart[best] / (size * len(own))))


def test_gradients():
    net, w = toxicity.Network(1), toxicity.Words(WordHasher())
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) + (0.1 * rng.standard_normal(v.shape)) for k, v in net.p.items()}
    h, tri, s, e = w.read("you are such a moron my friend")
    args = (toxicity.word_bucket(h), tri, s, e, np.array([0, 2]), np.array([4, 5]), np.array([1.0, 0.0]))
    _, g = net.gradients(*args)
    for name in ("Wf", "Ub", "att", "out", "cf"):
        at = np.unravel_index(3 % net.p[name].size, net.p[name].shape)
        for sign in (1, -1):
            net.p[name][at] += sign * 1e-2 * (1 if sign > 0 else 2)
            if sign > 0:
                up = net.gradients(*args)[0]
            else:
                down = net.gradients(*args)[0]
        net.p[name][at] += 1e-2
        assert g[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4), name


def base(t):
    w = words(t)
    n, seen = len(w), collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def verdicts(rows, max_docs=10, max_share=0.01, min_left=1 / 3, by_text=False):
    """Share of words in frequent lines for rows (doc_id, text, source) that lose too many of them, else None."""
    lines = lambda t: [" ".join(words(x)).lower() for x in (t or "").split("\n") if words(x)]
    seen, sizes = collections.defaultdict(set), collections.Counter(r[2] for r in rows)
    for i, t, h in rows:
        for line in lines(t):
            seen[h, line].add(t if by_text or i is None else i)
    frequent = {k for k, v in seen.items() if len(v) > max_docs and len(v) > max_share * sizes[k[0]]}
    out = []
    for _, t, h in rows:
        n = [(len(x.split()), (h, x) in frequent) for x in lines(t)]
        gone, all_ = sum(a for a, f in n if f), sum(a for a, _ in n)
        out.append(gone / all_ if gone > (1 - min_left) * all_ else None)
    return out


def test_quality(docs, none):
    rows = quality.quality_rules(docs, max_docs=10).collect()
    texts = collections.defaultdict(list)
    for r in ROWS:
        texts[r[0]].append(r[1])
    assert len(rows) == len(ROWS)
    lost = collections.Counter(zip((r[0] for r in ROWS), verdicts([(r[0], r[1], r[3]) for r in ROWS])))
    assert collections.Counter((r["doc_id"], r["lost"]) for r in rows) == lost
    for r in rows:
        t = texts[r["doc_id"]][0]
        want = base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["lost"] is None)
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {r["doc_id"] for r in rows if r["kept"]}
    assert quality.quality_rules(none).count() == 0 and quality.keep_good(none).count() == 0


def test_quality_shares(spark):
    """Limits by number and by share, ties at the limit, null ids and hosts, copies counted by id or by text."""
    rng = np.random.default_rng(6)
    menu = [" ".join(f"m{i}x{j}" for j in range(25)) for i in range(4)]
    rows = []
    for i in range(400):
        own = " ".join(f"o{i}w{j}" for j in range(int(rng.integers(5, 40))))
        pick = [m for k, m in enumerate(menu) if i % 7 <= k]
        rows.append((None if i % 90 == 5 else i, "\n".join([*pick, own]), [None, "a", "b"][int(rng.integers(3))]))
    rows += [(1000 + i, f"{menu[0]} copy\n{menu[1]} copy", "c") for i in range(40)] + [(1000, f"{menu[0]} copy\n{menu[1]} copy", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("page", F.lit(1)).repartition(4)
    for share, once in ((0.01, False), (0.2, False), (0.2, True), (0.01, True)):
        want = verdicts(rows, 10, share, by_text=once)
        got = quality.quality_rules(df, max_share=share, copies_once=once).collect()
        assert collections.Counter((r["doc_id"], r["lost"]) for r in got) == collections.Counter(zip((r[0] for r in rows), want))
        assert 40 <= sum(x is not None for x in want) or once
    good = [r["doc_id"] for r in quality.keep_good(df, max_share=0.2).collect()]
    assert len(good) == sum(x is None and not (base(r[1])[0] < 20 or 100 * base(r[1])[4] > 30 * base(r[1])[0]) for r, x in zip(rows, verdicts(rows, 10, 0.2)))


def test_quality_depleted(spark):
    shared = " ".join(f"menu{i}" for i in range(25))
    rows = [(i, f"{shared}\nown{i} text{i}", "h") for i in range(12)] + [(50, shared + "\n" + " ".join(f"z{i}" for i in range(60)), "h"), (51, shared, "other")]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(got[i]["kept"] for i in range(12)) and got[50]["kept"] and got[51]["kept"]
    assert got[0]["lost"] == pytest.approx(25 / 27)
    clean = {r["doc_id"]: r["text"] for r in quality.without_frequent_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert clean[0] == "own0 text0" and clean[51] == shared


def test_quality_exact_copies(spark):
    text = "\n".join(" ".join(f"p{i}q{j}" for j in range(10)) for i in range(4))
    df = spark.createDataFrame([(i, text, "h") for i in range(14)], "doc_id bigint, text string, source string")
    rows = quality.quality_rules(df).collect()
    assert len(rows) == 14 and not any(r["kept"] for r in rows) and quality.keep_good(df).count() == 0
    # before a stage that leaves one of them, copies count once
    rows = quality.quality_rules(df, copies_once=True).collect()
    assert len(rows) == 14 and all(r["kept"] and r["lost"] is None for r in rows) and quality.keep_good(df, copies_once=True).count() == 14


def test_quality_lines_removed(spark):
    shared = " ".join(f"menu{i}" for i in range(8))
    own = [" ".join(f"z{i}x{j}" for j in range(40)) for i in range(14)]
    rows = [(i, f"{own[i]}\n\n {shared.upper()}  \nend of é{i}", "h", 0) for i in range(12)] + [(12, f"{own[12]}\n{shared}", "other", 7), (13, own[13], "h", 7), (0, f"{own[0]}\n\n {shared.upper()}  \nend of é0", "h", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int")
    kept = quality.keep_good(df)
    assert kept.schema["n_chars"].dataType == df.schema["n_chars"].dataType and kept.columns == df.columns
    got = collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect())
    want = [(i, t := f"{own[i]}\n\nend of é{i}", len(t)) for i in [*range(12), 0]] + [(12, rows[12][1], 7), (13, own[13], 7)]
    assert got == collections.Counter(want)
    clean = collections.Counter((r["doc_id"], r["text"]) for r in quality.without_frequent_lines(df).collect())
    assert clean == collections.Counter((i, t) for i, t, _ in want)


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:160] = x[100]  # ties
    rows = [(i, [float(np.float32(v)) for v in x[i]], i) for i in range(900)]
    rows += [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] + [1.0] * 15, 0), (1060, [None] + [1.0] * 15, 0), (1080, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, block_rows=300).collect()
    v = np.array([r[1] for r in rows[:900]], dtype=np.float64)
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 900, 20))
    hits = []
    for q, found in by.items():
        s = (v * v[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        hits.append(len(set(best) & {i for i, _ in found}) / 20)
        assert len(found) == 20 and all(sc == pytest.approx(s[i], abs=1e-12) for i, sc in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert np.mean(hits) >= 0.9
    assert [i for i, _ in by[100]][:19] == list(range(101, 120))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    twice = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (21, [1.0, 0.1]), (22, [0.1, 1.0]), (22, [0.1, 1.0])]
    two = spark.createDataFrame(twice, "vec_id bigint, embedding array<float>")
    lists = collections.Counter((r["rank"], r["vec_id"]) for r in ann.nearest(two, two.where("vec_id = 20"), 20).collect())
    assert lists == {(1, 21): 1, (2, 22): 2, (3, 22): 1, (1, 22): 1, (3, 21): 1}
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id = 0"), 20).count() == 4


def test_token_counts(docs, none):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=lengths.read_ranks(path), special_tokens={})
    n = sorted(len(enc.encode_ordinary(r[1] or "")) for r in ROWS)
    h = lengths.length_histogram(lengths.token_lengths(docs, path, P.PATTERN)).cache()
    rows = h.collect()
    assert {r["n_tokens"]: r["n_docs"] for r in rows} == collections.Counter(n)
    for r in rows:
        c = r["n_tokens"]
        assert r["docs_at_least"] == sum(x >= c for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= c)
        assert r["truncated_total"] == sum(min(x, c) for x in n) and r["quantile"] == pytest.approx(sum(x <= c for x in n) / len(n))
        assert r["docs_total"] == len(n) and r["tokens_total"] == sum(n)
    assert lengths.truncated_total(h, 33).first()["tokens"] == sum(min(x, 33) for x in n)
    assert lengths.length_quantile(h, 0.5).first()["n_tokens"] == n[int(np.ceil(0.5 * len(n))) - 1]
    assert lengths.length_histogram(lengths.token_lengths(none, path, P.PATTERN)).count() == 0


def test_token_counts_of_long_white_space(spark):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = lengths.read_ranks(path)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter = lengths.TokenCounter(ranks, P.PATTERN, long_run=3)
    assert counter.count == counter.in_parts
    rng = np.random.default_rng(4)
    for _ in range(3000):
        t = "".join(rng.choice(list(" \n\t\x0b\x1c\x85\xa0\u2003\u3000ab1?'s"), rng.integers(0, 20)))
        assert counter.count(t) == len(enc.encode_ordinary(t)), repr(t)
    # a pattern that treats line ends in its own way is left alone
    assert lengths.TokenCounter(ranks, r"\s*[\r\n]+|[^\s]+|\s+(?!\S)|\s+").count.__name__ == "in_one"
    texts = [" " * 1_000_000, "\n" * 2_000_000, "a" + " \t" * 600_000 + "b c", "a" * 3_000_000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in lengths.token_lengths(df, path, P.PATTERN, keep=("doc_id",)).collect()}
    one = lambda t: len(enc._encode_single_piece(t.encode()))
    assert got == {0: one(texts[0]), 1: one(texts[1]), 2: 1 + one(" \t" * 600_000) + 2, 3: one(texts[3]), 4: 0}


def test_workers_without_the_package(tmp_path):
    """Fitted models reach Python workers that can't import this package."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from twinframe.llm import ann, langid, licenses, toxicity
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "false").getOrCreate()
def there(_):
    import importlib.util
    yield importlib.util.find_spec("twinframe") is not None
assert spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect() == [False]
docs = spark.createDataFrame([(i, f"word{i} and more words", "en") for i in range(12)], "doc_id bigint, text string, lang string")
labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
assert toxicity.toxicity(docs, labels).count() == licenses.scan_licences(docs).count() == langid.identify(docs).count() == 12
v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id bigint, embedding array<float>")
assert ann.nearest(v, v.where("vec_id = 0"), 3).count() == 3
print("whole")
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[2])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "whole" in done.stdout, done.stderr[-3000:]


def test_licences(spark, docs, none):
    filler = [" ".join(f"word{(i * 7 + j) % 97}" for j in range(12)) for i in range(40)]
    cases = {
        1: ("Released under the MIT License.", "mit"),
        2: ("intro\nLicensed under the Apache License, Version 2.0.\nend", "apache"),
        3: (EN + "\nThis work is licensed under the GNU General Public License, version 3.", "gpl"),
        4: ("LICENSED UNDER CC BY-NC 4.0.", "cc-by-nc"),
        5: ("he got a license to drive the apache helicopter under version two", ""),
        6: (None, ""),
        7: ("", ""),
    }
    rows = [(i, t) for i, (t, _) in cases.items()] + [(100 + i, t) for i, t in enumerate(filler)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("found", F.lit(1))
    got = {r["doc_id"]: r for r in licenses.scan_licences(df).collect()}
    assert {i: got[i]["licences"] for i in cases} == {i: f for i, (_, f) in cases.items()}
    assert not any(got[100 + i]["licences"] for i in range(40)) and got[2]["found"][0]["line"] == 1 and got[6]["n_paragraphs"] == 0
    assert licenses.scan_licences(none).count() == 0


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, see <https://www.gnu.org/licenses/>.""",
    "agpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

You should have received a copy of the GNU Affero General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "gpl": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
}


def test_wrapped_licences(spark):
    filler = [" ".join(f"word{(i * 7 + j) % 97}" for j in range(12)) for i in range(40)]
    model = licenses.train(sorted([*filler, EN, FR]))
    read = licenses.Paragraphs()
    for before in ("", " * ", "# ", "// ", "-- "):
        for family, text in WRAPPED.items():
            lines = ["Copyright (c) 2020 Someone", "", *text.split("\n"), "", EN]
            (n, hits), = model.scan(read, ["\n".join(before + x for x in lines)])
            assert {h[1] for h in hits} == {family}, (before, family, hits)
            assert min(h[0] for h in hits) == 2 and n == 3 + text.count("\n\n")
    # inside other lines of the same paragraph, and two notices in one
    (n, hits), = model.scan(read, [f"{EN}\n{EN}\n{WRAPPED['mit']}\n{EN}"])
    assert n == 1 and [h[:2] for h in hits] == [(2, "mit")]
    (n, hits), = model.scan(read, ["Released under the\nMIT License. Licensed under\nCC BY-SA 4.0."])
    assert n == 1 and [h[:2] for h in hits] == [(0, "mit"), (1, "cc-by-sa")]
    # a template's halves in two paragraphs, or in two texts, are no notice
    one, two = "Permission to use, copy, modify, and/or distribute this software", "for any purpose with or without fee is hereby granted"
    assert [h for _, h in model.scan(read, [f"{one}\n\n{two}", one, two])] == [[], [], []]


def test_pieces(docs, none, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = collections.Counter(tuple(r) for r in pieces.encode_pieces(docs, path, table_bytes=20_000).collect())
    want = collections.Counter()
    for r in ROWS:
        ids = sp.encode(r[1] or "")
        want[(r[0], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))] += 1
    assert got == want
    full = {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.encode_pieces(docs, path, with_ids=True).collect()}
    assert full == {(r[0], tuple(sp.encode(r[1] or "")), sp.decode(sp.encode(r[1] or ""))) for r in ROWS}
    table = pieces.ChunkTable(open(path, "rb").read(), 5000)
    rng = np.random.default_rng(2)
    monkeypatch.setattr(pieces, "BLOCK", 5)
    for _ in range(2000):
        t = "".join(rng.choice(list(" ▁ab\n\té😀\x00<s>/0x日 "), rng.integers(0, 14)))
        ids = sp.encode(t)
        assert table.encode(t) == (len(ids), ",".join(map(str, ids)), sp.decode(ids)), repr(t)
        assert table.digests([t, "", t[:3]])[0] == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))), repr(t)
        assert table.bytes <= 5000 and all(sum(330 + len(c) for c in g) <= 5000 + 400 * 14 for g in (table.young, table.old))
    assert pieces.encode_pieces(none, path).count() == 0


def test_pipeline_edges(spark, none, docs):
    """Every stage on an empty table, and with columns that clash with the operators' own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    clash = docs.limit(30).withColumns({c: F.lit("z") for c in ("key", "doc", "page", "host", "h", "_t", "stratum", "rate", "copies", "marked")})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, "")
        assert out.columns == clash.columns and all(r["key"] == "z" for r in out.select("key").collect())


def test_pipeline_hands_small_batches_to_python(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pa = pytest.importorskip("pyarrow")
    many = spark.range(3000, numPartitions=1).selectExpr("id", "'x' AS text")
    large = spark.range(40, numPartitions=1).selectExpr("id", "repeat('x', 1000000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    for stage in (corpus_pipeline.identified, corpus_pipeline.single, corpus_pipeline.encoded):
        for name in corpus_pipeline.BATCHES:
            spark.conf.unset(name)
        stage(spark, docs, "")
        rows = many.mapInArrow(sizes, "n bigint, bytes bigint").collect()
        assert sum(r["n"] for r in rows) == 3000 and max(r["n"] for r in rows) <= 1000
        rows = large.mapInArrow(sizes, "n bigint, bytes bigint").collect()
        assert sum(r["n"] for r in rows) == 40 and max(r["bytes"] for r in rows) < 12 << 20


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([r[:5] for r in ROWS], columns).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    letters = [r for r in ROWS if any(c.isalpha() for c in r[1] or "")]
    good = [r for r in letters if (b := base(r[1]))[0] >= 20 and 100 * b[4] <= 30 * b[0]]
    single, _ = linked(good, 5, 80)
    kept = {c for _, c in single.values()}
    sizes, by = collections.Counter(), {r[0]: r for r in good}
    for i in kept:
        sizes[by[i][3]] += len(words(by[i][1]))
    want = water(dict(sizes))
    assert set(got) <= kept
    for i in kept:
        rate = want[by[i][3]] / sizes[by[i][3]]
        assert int(rate + 1e-9) <= got[i] <= int(rate - 1e-9) + 1
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r["n_tokens"] == len(sp.encode(by[r["doc_id"]][1]))
