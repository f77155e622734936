"""Hard negatives, source divergence and language identification against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekcast.llm import divergence, hard_negatives, language

# --------------------------------------------------------------------------
# Hard negatives
# --------------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>, score double, row string, block int"


def vectors(seed=0, n=600, d=8, clusters=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, d)) * 0.4
    rows = []
    for i in range(n):
        c = 0 if i % 3 == 0 else i % clusters            # a third of all rows in one cluster
        v = centres[c] if i % 9 == 0 else centres[c] + r.normal(size=d) * 0.1
        rows.append((i, int(r.integers(0, 4)), [float(np.float32(x)) for x in v], 0.5, "r", 3))
    nan, inf = float("nan"), float("inf")
    rows += [(50, 1, rows[3][2], None, None, None),              # a repeated id and vector
             (None, 1, rows[3][2], None, None, None), (700, None, rows[3][2], 1.0, "", 1),
             (750, 2, None, 1.0, "", 1), (800, 2, [0.1, None] * 4, 1.0, "", 1),
             (850, 2, [nan] * 8, 1.0, "", 1), (900, 2, [inf] * 8, 1.0, "", 1),
             (950, 2, [0.5, 0.25], 1.0, "", 1), (1000, 9, [], 1.0, "", 1)]
    return rows


def plain_negatives(rows):
    ok = [(i, label, np.pad(np.floor(256 * np.array(v, dtype=float)), (0, 8 - len(v))))
          for i, label, v, *_ in rows
          if i is not None and label is not None and v is not None
          and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (a, label, v) in enumerate(ok):
        if a % 50:
            continue
        by = sorted((-int(v @ w), i, k) for k, (i, _, w) in enumerate(ok) if k != n)
        for p, pid, _ in [x for x in by if ok[x[2]][1] == label][:5]:
            fit = [x for x in by if ok[x[2]][1] != label and 50 * -p <= 100 * -x[0] <= 95 * -p]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fit[:3])]
    return Counter(out)


@pytest.mark.parametrize("block_rows, first_rows", [(8192, 16384), (20, 40), (7, 0)])
def test_hard_negatives_are_exact(spark, block_rows, first_rows):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    out = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, block_rows=block_rows,
                                        first_rows=first_rows)
    got = Counter(tuple(r) for r in out.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score").collect())
    assert got == plain_negatives(rows) and len(got) > 50


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(vectors(n=5), VECTORS)
    anchor = F.col("vec_id") % 50 == 0
    for none in (df.where("vec_id > 1000000"), df.where("label IS NULL")):
        assert hard_negatives.hard_negatives(none, anchor).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_walk_is_in_order_and_stops_when_certified():
    r = np.random.default_rng(3)
    a, b = r.normal(size=7), r.normal(size=5)
    walk = list(hard_negatives.multi_sequence(a, b))
    assert {(i, j) for i, j, _ in walk} == {(i, j) for i in range(7) for j in range(5)}
    sums = [s for *_, s in walk]
    assert sums == sorted(sums, reverse=True)
    assert all(s == pytest.approx(a[i] + b[j]) for i, j, s in walk)
    books = np.eye(4)[:, :2] * 100, np.eye(4)[:, :2] * 100
    radii = np.ones(4), np.ones(4)
    index = hard_negatives.Index(None, books, radii, np.arange(16), np.ones(16, int),
                                 np.full(16, 10), 4, True)
    anchor = np.array([100, 0, 100, 0])
    begun = list(hard_negatives.visits(anchor, index, hard_negatives.LEAST, True, 10))
    rest = list(hard_negatives.visits(anchor, index, 19_000, False, 10))
    assert begun == [0] and rest == []
    assert set(hard_negatives.visits(anchor, index, 9_000, False, 10)) == {1, 2, 3, 4, 8, 12}


# --------------------------------------------------------------------------
# Source divergence
# --------------------------------------------------------------------------

def audit_rows(seed=1):
    r = random.Random(seed)
    words = ["an", "er", "th", "on", "été", "ñandú", "the", "of", "and"]
    rows = []
    for i in range(400):
        lang, source = r.choice(["x", "x", "y", None]), r.choice(["s0"] * 3 + ["s1", "s2", "é", None])
        text = " ".join(r.choice(words) + r.choice(["", "", r.choice(words)])
                        for _ in range(r.randint(0, 12)))
        rows.append((i, text.upper() if i % 5 == 0 else text, lang, source, 1, "z"))
    rows += [(1, None, "x", "s9", 0, ""), (2, "1 2, 3!", "lone", "s0", 0, ""),
             (3, "İß ǅ-x_y", "z", "s0", 0, ""), (4, "", "z", "s1", 0, ""),
             (5, "the of " * 30_000, "x", "long", 0, "")]
    return rows + rows[:20]


def plain_divergence(rows, least):
    docs = [("" if g is None else g, "" if s is None else s,
             re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+",
                        re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
            for _, t, g, s, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, w in mine for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        count = defaultdict(Counter)
        for _, s, w in mine:
            count[s].update(t for t in w if t in kept)
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (c.total() + 5 * len(kept))
        for s, c in count.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), x.encode(), x)
                     for x, o in count.items() if x != s]
            terms = [(share(whole, t) - share(c, t), t.encode(), t) for t in kept
                     if c[t] and share(c, t) > share(whole, t)]
            out += [(lang, s, "pair", x, -v, i + 1) for i, (v, _, x) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", x, -v, i + 1) for i, (v, _, x) in enumerate(sorted(terms)[:50])]
    return Counter(out)


@pytest.mark.parametrize("least, segment", [(30, 4096), (30, 2), (3, 10), (10_000, 4096)])
def test_divergence_is_that_of_a_plain_count(spark, least, segment):
    rows = audit_rows()
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n int, term string").repartition(4)
    out = divergence.divergence(docs, least_docs=least, segment_terms=segment)
    got = Counter(tuple(r) for r in out.select(
        "lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(rows, least) and got
    assert divergence.divergence(docs.where("doc_id < 0")).count() == 0


def test_galloping_finds_what_both_hold():
    r = random.Random(5)
    for _ in range(200):
        a = np.array(sorted(r.sample(range(1500), r.randint(0, 300))), dtype=np.int64)
        b = np.array(sorted(r.sample(range(1500), r.randint(0, 1200))), dtype=np.int64)
        i, j = divergence.gallop(a, b, run=r.choice([1, 7, 64]))
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    counts = np.array([0, 1, 7, 10**9])
    whole = 8 * 10**15
    assert divergence.shares(counts, whole).tolist() == [
        1 + 10**9 * (int(c) + 5) // whole for c in counts]


# --------------------------------------------------------------------------
# Languages
# --------------------------------------------------------------------------

SOUNDS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "er", "ung", "ei"], "cc": ["né", "ão", "ça"]}


def spoken(seed=2, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SOUNDS))
        words = ["".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4)))
                 for _ in range(r.randint(3, 60))]
        rows.append((i, " ".join(words) + r.choice([".", "!! 12"]), lang, "s", 0.1, i))
    return rows + [(n, None, "aa", "s", 0.0, 0), (n + 1, "", "aa", "s", 0.0, 0),
                   (n + 2, "12 + ½ = _?", "aa", "s", 0.0, 0), (None, rows[0][1], None, None, None, 1),
                   (7, rows[0][1], "aa", "s", 1.0, 1), (n + 3, "kalo " * 100_000, None, "s", 0.0, 0)]


def plain_phrases(text: bytes, known: bytes) -> int:
    """Longest matches from left to right, by searching the labelled text itself."""
    at = n = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and known.find(text[at:end + 1]) >= 0:
            end += 1
        at, n = end, n + 1
    return n


def test_phrases_are_longest_matches():
    r = random.Random(9)
    for _ in range(20):
        known = [" " + "".join(r.choice("abc d") for _ in range(r.randint(1, 80))) for _ in "xyz"]
        texts = ["".join(r.choice("abc de") for _ in range(r.randint(0, r.choice([3, 120, 5000]))))
                 for _ in range(r.choice([1, 5, 40]))]
        texts = [f" {t}".encode() if t else b"" for t in texts]
        model = language.Model(tuple(zip("xyz", map(str.encode, known))))
        by = language.parser(model)
        got = by.phrases([t.translate(by.classes) for t in texts])
        assert got.tolist() == [[plain_phrases(t, k.encode()) for k in known] for t in texts]


def test_languages_are_told_apart(spark):
    rows = spoken()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, "
                                       "score double, h int").repartition(3)
    model = language.fit(docs, ~language.held_out(), windows=40)
    assert [lang for lang, _ in model.texts] == sorted(SOUNDS)
    out = language.languages(docs, model).withColumn("held", language.held_out()).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, *_ in rows)
    assert all(0 <= r.score <= 1 for r in out)
    pred = {r.doc_id: r.lang_pred for r in out if r.doc_id is not None and r.doc_id != 7}
    assert pred[300] == pred[301] == pred[302] == "und" and pred[303] == "aa"
    assert all(pred[d] == lang for d, _, lang, *_ in rows[:300] if d != 7)
    assert all(r.held == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
               for r in out)
    for text in (rows[5][1], rows[6][1]):
        letters = language.normal(text)
        cost = {lang: plain_phrases(letters, known) * np.log2(len(known)) for lang, known in model.texts}
        assert language.identify([text], model)[0][0] == min(cost, key=cost.get)


def test_fit_reads_allowed_rows_only(spark):
    rows = spoken()
    schema = "doc_id long, text string, lang string, lang_pred string, score double, h int"
    docs = spark.createDataFrame(rows, schema)
    changed = spark.createDataFrame(
        [(d, t, ("zz" if zlib.crc32(str(d).encode()) % 3 == 1 else lang), *rest)
         for d, t, lang, *rest in rows], schema)
    allowed = ~language.held_out()
    assert language.fit(docs, allowed) == language.fit(changed, allowed)
    copies = docs.unionByName(docs.where("doc_id = 4"))
    assert language.fit(copies, allowed) == language.fit(docs, allowed)
    empty = language.fit(docs.where("doc_id < 0"))
    assert empty.texts == ()
    assert {(r.lang_pred, r.score) for r in language.languages(docs, empty).collect()} == {("und", 0.0)}
    assert language.languages(docs.where("doc_id < -1"), empty).count() == 0
