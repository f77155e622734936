"""License scans, sharding, the classifiers and the pipeline."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from checks.compare import connect, differences
from tests.llm.test_dedup import brute_groups, low, split
from weekcast.llm import learned, licenses, quality, shuffle_shards, toxicity
from weekcast.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def brute_licenses(text, notices, containment=0.8):
    """Every window of the text against every part."""
    w, found = split(text), {}
    for p in licenses.parts_of(notices):
        n = len(p.words)
        for s in range(0, len(w), licenses.step_of(n)):
            view = w[s:s + licenses.window_of(n)]
            has = {tuple(view[i:i + p.size]) for i in range(len(view) - p.size + 1)}
            share = len(has.intersection(p.shingles)) / len(p.shingles)
            marked = all(f" {m} " in f" {' '.join(view)} " for m in p.must)
            if share >= containment and marked:
                got = found.setdefault(p.license, [set(), 0, 0.0, s, False])
                got[0].add(p.number)
                got[1] += 1
                got[2], got[3] = max(got[2], share), min(got[3], s)
                got[4] |= p.decisive
    return {k: (len(a), b, c, d) for k, (a, b, c, d, told) in found.items() if told}


def plain(notice):
    return re.sub(r"[][]", "", notice)


def test_licenses_as_in_brute_force(spark):
    r = random.Random(2)
    noise = lambda n: " ".join(r.choice("abcde") * 3 for _ in range(n))
    long = " ".join(f"term{i % 37} clause{i}" for i in range(60))
    known = licenses.read_notices()
    notices = known + [("Long", long), ("Marked", long.replace("clause9", "[clause9]")),
                       ("Word", "xyzzy"), ("Empty", " . "), ("Null", None)]
    texts = [None, "", "license", long, long.upper() + noise(9), noise(300), "mit " * 30_000]
    for _, notice in known:
        w = plain(notice).split()
        texts.append(f"{noise(r.randrange(9))} {plain(notice).upper()} {noise(r.randrange(9))}")
        i = r.randrange(len(w))
        texts += [" ".join(w[:i] + ["x"] + w[i + 1:]), " ".join(w[:i] + w[i + 1:]),
                  noise(5) + " " + " ".join(w[:i] + ["x", "y"] + w[i:])]
        texts.append(f"{noise(20)} {plain(notice)} {plain(notice)} xyzzy")
        texts.append(" ".join(w[:len(w) * 9 // 10]))              # cut by the end of the text
    rows = [(i if i != 7 else None, t, 1, "z") for i, t in enumerate(texts)] + [(9, texts[9], 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, license string")
    want = Counter()
    for doc_id, text, *_ in rows:
        for name, found in brute_licenses(text, notices).items():
            want[(doc_id, name, *found)] += 1
    got = Counter((x.doc_id, x.license, x.parts, x.windows, x.containment, x.start)
                  for x in licenses.scan(docs, notices).collect())
    assert got == want and len(want) > 200
    assert {name for _, name, *_ in want} >= {name for name, _ in known}
    assert licenses.scan(docs.where("doc_id < 0")).count() == 0
    assert licenses.scan(docs, []).count() == 0


def test_edited_notices_are_found_and_versions_told_apart(spark):
    told = [
        ("Licensed under the Apache License, Version 2.0.", {"Apache-2.0"}),
        ("Licensed under the Apache Licence, Version 2.0.", {"Apache-2.0"}),
        ("Licensed under the Apache License, Version 1.1.", set()),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        ("The work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        ("Released under MIT License.", {"MIT"}),
        ("Released under the BSD License.", set()),
        ("// SPDX-License-Identifier: MIT", {"MIT"}),
        ("SPDX-License-Identifier: GPL-3.0-only", {"GPL-3.0"}),
        ("This is free and unencumbered software released to the public domain.", {"Unlicense"}),
        ("Licensed under CC BY-NC 4.0. All rights reserved.", {"CC-BY-NC-4.0", "Reserved"}),
        ("Ich gehe mit den Kindern in die Stadt", set()),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(told)], "doc_id int, text string")
    found = {i: set() for i in range(len(told))}
    for x in licenses.scan(docs).collect():
        found[x.doc_id].add(x.license)
    assert [found[i] for i in range(len(told))] == [names for _, names in told]


def test_notices_are_read_from_a_file(tmp_path):
    (tmp_path / "own.txt").write_text("# note\n== A spdx\none [two]\nthree\n\nfour\n== B\n\nfive\n")
    assert licenses.read_notices(str(tmp_path / "own.txt")) == [
        ("A", "one [two] three"), ("A", "four"), ("A", "[SPDX-License-Identifier: A]"), ("B", "five")]


def test_parts_bands_and_anchors_keep_the_promise():
    long = " ".join(f"w{i}" for i in range(300))
    parts = licenses.parts_of(licenses.read_notices() + [("Long", long)])
    for p in parts:
        n, own = len(p.words), len(p.shingles)
        window, shared = licenses.window_of(n) - p.size + 1, -(-own * 8 // 10)
        j = shared / (own + window - shared)
        assert n <= licenses.PART and ((1 - j) ** licenses.bands_of(n, own) <= licenses.MISS or j >= 1)
        anchors = p.anchors(0.8)
        if p.must:
            assert anchors <= {w for m in p.must for w in m.split()}
        else:
            assert sum(not anchors.isdisjoint(s) for s in p.shingles) > own - shared
    grams = {s for p in parts if p.license == "Long" for s in p.shingles}
    assert len(grams) == 296                                   # none is lost between parts


def test_shards_hold_every_row_once(spark):
    rows = [(i % 50 if i % 7 else None, None if i % 11 == 0 else "é" * (i % 40), i, "s")
            for i in range(997)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string")
    docs = docs.repartition(5).cache()
    for shards, seed in ((24, 1), (1, 2), (7, 3)):
        out = shuffle_shards.write_shards(docs, shards, seed=seed, bucket_bytes=3000).collect()
        assert Counter((r.doc_id, r.text) for r in out) == Counter((a, b) for a, b, *_ in rows)
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert set(slots) == set(range(shards))
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        sizes = [len(v) for v in slots.values()]
        assert max(sizes) - min(sizes) <= 1
    place = lambda out: [r.text for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    one = place(shuffle_shards.write_shards(docs, 3, seed=5).collect())
    two = place(shuffle_shards.write_shards(docs, 3, seed=6).collect())
    assert one != two and sorted(map(str, one)) == sorted(map(str, two))
    assert shuffle_shards.write_shards(docs.where("doc_id < 0"), 4).count() == 0


def classified(spark, seed=1, n=900):
    """Toxic texts hold invented insults; bad ones are shouted or repeat a word."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "sh", "re"])
                           for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 150))]
        toxic, good = r.random() < 0.3, r.random() < 0.7
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["blorgface", "snivelwurz", "gnarkwit"])
        text = " ".join(w)
        if not good:
            text = text.upper() + "!!" if r.random() < 0.5 else " ".join([w[0]] * 80)
        rows.append((i, text, "l", 0.5))
        labels.append((i, int(good), int(toxic and (good or text.isupper() or text[-1] == "!"))))
    rows += [(None, rows[3][1], None, None), (3, rows[3][1], None, None), (n, None, "", 0.0),
             (n + 1, "", "", 0.0), (n + 2, "ab " * 200_000, "", 0.0)]
    labels += [(None, 1, 1), (n + 7, 0, 1), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def accuracy(scored, labels, at):
    truth = {d: y[at] for d, *y in labels if d is not None and y[at] is not None}
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows, truth = classified(spark)
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, *_ in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
               for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert accuracy(out, truth, 1) > 0.93
    assert toxicity.score(docs.where("doc_id < 0"), toxicity.fit_texts([])).count() == 0
    none = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert {round(r.score, 6) for r in toxicity.score(docs.limit(5), none).collect()} == {0.5}


def test_fits_ignore_held_out_labels(spark):
    docs, labels, *_ = classified(spark, n=300)
    turned = labels.selectExpr(
        "doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) quality",
        "if(crc32(string(doc_id)) % 3 = 1, 1 - toxic, toxic) toxic")
    a, b = (toxicity.fit(docs, x) for x in (labels, turned))
    assert a.name == b.name and (a.weights == b.weights).all()
    stats = quality.described(docs).cache()
    a, b = (quality.fit(stats, x) for x in (labels, turned))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.levels, b.levels)


def test_quality_on_held_out_rows(spark):
    docs, labels, rows, truth = classified(spark, seed=2)
    out = quality.quality(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, *_ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert accuracy(out, truth, 0) > 0.95
    assert quality.quality(docs.where("doc_id < 0"), labels).count() == 0
    assert quality.quality(docs.limit(3), labels.where("doc_id < 0")).count() == 3


def test_isotonic_is_the_closest_rising_fit():
    out = learned.isotonic(np.array([1, 1, 2, 1]), np.array([1, 0, 1, 1]))
    assert np.allclose(out, [0.5, 0.5, 0.5, 1.0])


@has_data
@pytest.mark.parametrize("name", ["op8_license_scan"])
def test_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) == []


@has_data
def test_pipeline_stages_follow_each_other(spark):
    """Each stage against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept, left = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = corpus_pipeline.write_stage(stage(spark, kept, FOLDER), name)
        assert kept.columns == columns
        left[name] = (before, {r.doc_id for r in kept.collect()})
    before, after = left["exact_dedup"]
    groups = {}
    for d, t in before.items():
        groups.setdefault(low(t), []).append(d)
    assert after == {max(g) for g in groups.values()}
    before, after = left["near_dedup"]
    ids, groups = list(before), {}
    for d, g in zip(ids, brute_groups([before[d] for d in ids])):
        groups.setdefault(g, []).append(d)
    assert after == {max(g) for g in groups.values()}
    before, after = left["decontamination"]
    grams = lambda w: {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 0))}
    bench = set().union(*(grams(split(r.text)) for r in
                          spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()))
    assert after == {d for d, t in before.items() if not grams(split(t)) & bench}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in out} == after
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[-1][0])
