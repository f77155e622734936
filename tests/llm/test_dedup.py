"""Exact and near duplicates, and decontamination, against brute force."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from weekcast.llm import decontaminate, exact_dedup, near_dup
from weekcast.llm.common import LOWER, UPPER
from weekcast.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
low = lambda t: (t or "").translate(str.maketrans(UPPER, LOWER))
split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def corpus(n, seed=3, words=60):
    """Texts with exact, re-cased and edited copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7)))
    out = []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.2:
            out.append(r.choice(out))
        elif out and kind < 0.3:
            out.append(r.choice(out).upper().replace("É", "é"))
        elif out and kind < 0.7:
            t = r.choice(out).split()
            for _ in range(r.randint(1, 4)):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t))
        else:
            out.append(" ".join(word() for _ in range(r.randint(words, 2 * words))))
    return out


def frame(spark, texts, parts=3):
    rows = [(i, t, None if i % 3 else "en", i, "x", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, 2), rows[1], rows[1]]
    schema = "doc_id long, text string, lang string, row long, key string, `group` int"
    return spark.createDataFrame(rows, schema).repartition(parts).cache()


def same(rows, groups_of):
    """Groups, who stays in them, and one row for each input row."""
    groups = {}
    for doc_id, text, group in groups_of:
        groups.setdefault(group, []).append((doc_id, text))
    want = Counter()
    for members in groups.values():
        ids = [d for d, _ in members if d is not None]
        best = max(ids) if ids else None
        for d, _ in members:
            want[d, best, len(members)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
    kept = Counter(r.keep_id for r in rows if r.kept)
    assert kept == Counter(max([d for d, _ in m if d is not None], default=None)
                           for m in groups.values())
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


ODD = [None, "", "", "  ", "A", "a", "É", "é", "x" * 9000, "x" * 8999 + "X", "x" * 8999 + "y",
       "!?", "one two", "One two", "ab " * 3000, "ab " * 3001]


@pytest.mark.parametrize("hash_of", [lambda k: F.lit(7).cast("long"),
                                     lambda k: F.ascii(F.col(k).cast("string")).cast("long") % 3])
def test_exact_groups_where_blocks_of_one_hash_span_partitions(spark, monkeypatch, hash_of):
    monkeypatch.setattr(exact_dedup, "order_of", hash_of)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(5)
        texts = [r.choice(["a", "b" * 9, "c" * 40, "", "b" * 8 + "c"]) for _ in range(400)]
        texts += [f"{r.randrange(30)} x" for _ in range(400)]
        docs = frame(spark, texts, 4)
        for block in (4, 4096):
            got = exact_dedup.exact_duplicates(docs, block_bytes=block).collect()
            same(got, [(d.doc_id, low(d.text), low(d.text)) for d in docs.collect()])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_exact_groups_with_every_block_size(spark):
    docs = frame(spark, corpus(60) + ODD)
    rows = [(r.doc_id, low(r.text)) for r in docs.collect()]
    for block in (7, 64, 4096):
        got = exact_dedup.exact_duplicates(docs, block_bytes=block).collect()
        same(got, [(d, t, t) for d, t in rows])
        sha = {t: hashlib.sha256(t.encode()).hexdigest() for _, t in rows}
        assert Counter(r.text_sha256 for r in got) == Counter(sha[t] for _, t in rows)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(low(r.text) for r in left.collect()) == sorted({t for _, t in rows})


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return 1.0 if not a and not b else (a & b).total() / (a | b).total()


def shingle_lists(texts, n=5):
    out = []
    for t in texts:
        w = split(t)
        k = min(n, len(w))
        out.append([tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if w else [])
    return out


def brute_groups(texts, threshold=0.8):
    sets = shingle_lists(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= threshold:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_groups_equal_all_pairs(spark):
    docs = frame(spark, corpus(120) + ODD)
    rows = docs.collect()
    found = near_dup.near_duplicates(docs).collect()
    groups = brute_groups([r.text for r in rows])
    same(found, [(r.doc_id, r.text, g) for r, g in zip(rows, groups)])
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(set(groups))


def test_links_that_no_star_has_are_found(spark):
    """With one band and one row nearly all texts share buckets; a chain's ends do not
    link to each other, nor its middle to the hub."""
    base = [f"w{i}" for i in range(104)]
    chain = [" ".join(base[:i * 4] + [f"v{j}" for j in range(4 * i)] + base[8 * i:])
             for i in range(4)]
    shifted = [" ".join(base[3 * i:90 + 3 * i]) for i in range(5)]
    docs = frame(spark, chain + shifted)
    rows = docs.collect()
    found = near_dup.near_duplicates(docs, bands=24, rows=1).collect()
    same(found, [(r.doc_id, r.text, g)
                 for r, g in zip(rows, brute_groups([r.text for r in rows]))])


def test_pairs_that_lack_different_units_are_not_compared(spark):
    """Each text shares 178 of 178 units with others; two of them share 156 with each other
    (0.78), and two of the rest 168 (0.87)."""
    units = range(200)
    lacking = {1: range(22), 2: range(30, 52), 3: range(10, 32), 4: ()}
    texts = [(t, [7], [u for u in units if u not in gone],
              np.bincount([u % near_dup.PARTS for u in units if u not in gone],
                          minlength=near_dup.PARTS).tolist()) for t, gone in lacking.items()]
    wide = near_dup.with_bounds(spark.createDataFrame(
        texts, "text long, keys array<long>, units array<long>, parts array<int>"))
    found = {r.text: r for r in wide.collect()}
    assert all(found[t].shared == found[t].size == sum(found[t].parts) for t in found)
    label = wide.select("text", "size", "shared", F.lit(0).alias("band"),
                        F.lit(7).alias("key"), F.col("text").alias("root"))
    pairs = near_dup.across_groups(label, wide, 0.8).collect()
    assert {tuple(p) for p in pairs} == {(1, 3), (1, 4), (2, 4), (3, 4)}


@has_data
def test_near_groups_of_the_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    found = QUERIES["op9_minhash_near_dedup"](spark, FOLDER).collect()
    same(found, [(r.doc_id, r.text, g)
                 for r, g in zip(rows, brute_groups([r.text for r in rows]))])


def test_signatures_agree_as_often_as_texts_are_similar():
    texts = corpus(40, seed=8)
    sets = [near_dup.units(near_dup.shingles(t)) for t in texts]
    signed = near_dup.signatures(sets, 512)
    alone = near_dup.signatures(sets[5:6], 512)
    assert (alone[0] == signed[5]).all()
    exact = shingle_lists(texts)
    for i, j in itertools.combinations(range(40), 2):
        assert abs((signed[i] == signed[j]).mean() - jaccard(exact[i], exact[j])) < 0.13
    repeated = ["a b c d e f g h " * 9, "a b c d e f g h " * 5]
    s = near_dup.signatures([near_dup.units(near_dup.shingles(t)) for t in repeated], 1024)
    assert abs((s[0] == s[1]).mean() - jaccard(*shingle_lists(repeated))) < 0.06


def test_empty_tables(spark):
    none = frame(spark, ["a", "b"]).where("doc_id < 0")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    some = frame(spark, ["a b c d", "a b c"])
    judged = decontaminate.contamination(some, items.where("item_id < 0")).collect()
    assert len(judged) == 5 and not any(r.contaminated for r in judged)


def test_windows_hit_as_in_brute_force(spark):
    r = random.Random(4)
    w = lambda n: [r.choice("abcdefgh") + r.choice("xyzÉé") for _ in range(n)]
    items = [w(30), w(12), w(10), w(9), w(4), w(1), [], None, ["q"] * 15]
    bench = [(i if i != 2 else None, None if t is None else " ".join(t).upper().replace("É", "é"), "x")
             for i, t in enumerate(items)] + [(0, " ".join(items[0]), "x")]
    texts = [None, "", " . ", " ".join(items[0]), "-".join(w(40) + items[0][5:15] + w(3)),
             " ".join(w(20) + items[1] + items[2] + w(2)), " ".join(items[3] + w(500) + items[3]),
             " ".join(items[4][:3]), " ".join(w(50) + items[4]), "q " * 40, " ".join(items[0][:9]),
             " ".join(items[0][:10] + items[0][4:14]), " ".join(w(3000))]
    docs = frame(spark, texts)
    benchmark = spark.createDataFrame(bench, "item_id long, text string, row string")
    got = Counter((x.doc_id, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated)
                  for x in decontaminate.contamination(docs, benchmark).collect())
    want = Counter()
    for row in docs.collect():
        words, hit, names = split(row.text), set(), set()
        for item_id, text, _ in bench:
            t = split(text)
            n = min(10, len(t))
            grams = {tuple(t[i:i + n]) for i in range(len(t) - n + 1)} if t else set()
            at = [i for i in range(len(words) - n + 1) if n and tuple(words[i:i + n]) in grams]
            hit.update(p for i in at for p in range(i, i + n))
            if at and item_id is not None:
                names.add(str(item_id))
        want[row.doc_id, len(words), len(hit), tuple(sorted(names)), bool(hit)] += 1
    assert got == want
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert left.count() == sum(n for k, n in want.items() if not k[4])


@has_data
@pytest.mark.parametrize("name", ["op1_decontamination", "op3_exact_dedup"])
def test_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) == []


def test_word_hashes_and_earliest_darts_follow_their_definitions():
    texts = ["", None, "Don't STOP, ÄÖ été-été 日本語\u3000x\x85y\xa0z K\u212a \x00\x7f[a]{B}`9:",
             "one  two\n" * 3, "\U0001F600 a@b"]
    for t in texts:
        assert near_dup.word_hashes(t).tolist() == [
            near_dup.xxhash.xxh64_intdigest(w) for w in split(t)]
    k, sets = 8, [near_dup.units(near_dup.shingles(t)) for t in texts if t]
    for s, got in zip(sets, near_dup.signatures(sets, k), strict=True):
        best = [(np.inf, 0)] * k
        for element in s:
            rank = 0.0
            for turn in range(1, 400):               # far beyond any rank that is needed
                with np.errstate(over="ignore"):
                    dart = near_dup.mixed(np.array([element], np.uint64) + np.uint64(
                        turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                rank -= float(np.log(near_dup.uniform(dart))[0])
                name = int(near_dup.mixed(dart ^ np.uint64(0xA0761D6478BD642F))[0])
                best[name % k] = min(best[name % k], (rank, name))
        assert got.tolist() == [name for _, name in best]
