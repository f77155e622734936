"""The boosting loop against plain versions, and the protocol of the registered queries."""

from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import suite_products as P
from weekcast.plans import boosting as B
from weekcast.plans import evaluation as E
from weekcast.plans import features as FT

WHOLE = replace(E.Params(), subsample=1.0, colsample=1.0, min_child_weight=3, learning_rate=0.3,
                max_depth=3)


@pytest.fixture(scope="module")
def numbers(spark):
    """400 rows: a and b matter, c is noise; a third of all rows are alike."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):
        a, b, noise = (0.5, 0.25, 0.0) if i % 3 == 0 else np.round(r.normal(size=3), 1).tolist()
        y = 3.0 * (a > 0) - 2.0 * (b > 0.3) * (a < 0.5) + 0.3 * r.normal()
        rows.append((i, a, b, noise, float(y), ("train", "train", "val", None)[i % 4]))
    return spark.createDataFrame(
        rows, "row int, a double, b double, c double, y double, part string").repartition(3)


def job(params, split="part", features=("a", "b", "c")):
    return B.Job("one", params, F.col(split), features)


def plain_boost(rows, params, rounds):
    """Every cut of every feature tried, one node after another."""
    train = [r for r in rows if r.part == "train"]
    x = np.array([[r.a, r.b, r.c] for r in train])
    y = np.array([r.y for r in train])
    all_x = np.array([[r.a, r.b, r.c] for r in rows])
    score, every = np.full(len(y), y.mean()), np.full(len(rows), y.mean())
    for _ in range(rounds):
        def grow(at, everywhere, depth, g=None):
            g = score - y
            worth = lambda m: g[m].sum() ** 2 / (m.sum() + 1)
            best = (1e-9, None, None)
            for f in range(3):
                for cut in np.unique(x[:, f]) if depth else []:
                    left, right = at & (x[:, f] <= cut), at & (x[:, f] > cut)
                    if min(left.sum(), right.sum()) >= params.min_child_weight:
                        gain = worth(left) + worth(right) - worth(at)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
            if best[1] is None:
                leaf = -params.learning_rate * g[at].sum() / (at.sum() + 1)
                return [(at, everywhere, leaf)]
            _, f, cut = best
            return (grow(at & (x[:, f] <= cut), everywhere & (all_x[:, f] <= cut), depth - 1)
                    + grow(at & (x[:, f] > cut), everywhere & (all_x[:, f] > cut), depth - 1))

        leaves = grow(np.ones(len(y), bool), np.ones(len(rows), bool), params.max_depth)
        for at, everywhere, leaf in leaves:
            score[at] += leaf
            every[everywhere] += leaf
    return every


def test_trees_are_those_of_a_plain_search(spark, numbers):
    """Fewer distinct values than bins, so every cut is tried."""
    rows = numbers.orderBy("row").collect()
    params = replace(WHOLE, rounds=4, max_depth=2)
    fitted = B.fit_many(numbers.withColumn("part", F.when(F.col("part") == "train", "train")),
                        [job(params)], "y")["one"]
    got = [r.prediction for r in fitted.predict(numbers).orderBy("row").collect()]
    assert len(fitted.trees) == 4 and got == pytest.approx(plain_boost(rows, params, 4), abs=1e-9)


def test_the_early_stop_is_that_of_all_rounds(numbers):
    params = replace(WHOLE, rounds=40, patience=4)
    stopped = B.fit_many(numbers, [job(params)], "y")["one"]
    whole = B.fit_many(numbers, [job(replace(params, patience=1000))], "y")["one"]
    assert len(whole.errors) == 40
    best = 0
    for i, e in enumerate(whole.errors):
        if e < whole.errors[best]:
            best = i
        if i - best >= 4:
            break
    assert stopped.errors == whole.errors[:i + 1] and i < 39
    assert stopped.best_iteration == best and len(stopped.trees) == best + 1
    for one, other in zip(stopped.trees, whole.trees):
        assert (one.feature == other.feature).all() and (one.value == other.value).all()


def test_blocks_and_company_do_not_change_a_fit(numbers):
    params = replace(WHOLE, rounds=4, patience=5)
    alone = B.fit_many(numbers, [job(params)], "y")["one"]
    many = [B.Job(f"{k}", replace(params, max_depth=1 + k % 4), F.col("part"), ("a", "b", "c"))
            for k in range(3)]
    spread = B.fit_many(numbers, many, "y", parallel=2, block_rows=70)
    assert spread["2"].errors == pytest.approx(alone.errors)
    assert spread["2"].best_iteration == alone.best_iteration
    rows = numbers.orderBy("row")
    score = lambda f: [r.prediction for r in f.predict(rows).orderBy("row").collect()]
    assert score(spread["2"]) == pytest.approx(score(alone))
    only = B.fit_many(numbers, [B.Job("b", params, F.col("part"), ("b",)), *many], "y")
    tree = only["b"].trees[0]
    assert {only["b"].features[f] for f in tree.feature if f >= 0} == {"b"}


def test_node_tables_give_the_model(spark, numbers):
    params = replace(E.Params(), rounds=12, patience=3)
    jobs = [B.Job(n, replace(params, max_depth=d), F.col("part"), ("a", "b", "c"))
            for n, d in (("deep", 4), ("flat", 1))]
    models = B.fit_many(numbers, jobs, "y")
    rows = numbers.withColumn("m", F.when(F.col("row") % 2 == 0, "deep").otherwise("flat"))
    joined = {r.row: r.prediction for r in B.score_by_joins(rows, ["row"], F.col("m"), models).collect()}
    each = B.predict_each(rows, ["m"], {(n,): [(n, f)] for n, f in models.items()}, ["row"]).collect()
    assert len(joined) == len(each) == 400
    assert all(joined[r.row] == pytest.approx(r.prediction, abs=1e-12) for r in each)
    shown = {r.feature: r.importance for r in models["deep"].importance(spark, 3).collect()}
    counted = {r.feature: r.importance for r in B.gains_by_nodes(spark, models["deep"]).collect()}
    assert counted == pytest.approx(shown) and sum(shown.values()) == pytest.approx(1)


def test_rows_and_columns_are_sampled(numbers):
    params = replace(WHOLE, rounds=6, subsample=0.5, colsample=0.4)
    train = numbers.where("part = 'train'")
    fitted = B.fit_many(train, [job(params)], "y")["one"]
    assert len(fitted.trees) == 6 and fitted.errors == []
    assert all(60 < t.rows[0] < 140 for t in fitted.trees)               # half of 200
    assert all(len({f for f in t.feature if f >= 0}) <= 1 for t in fitted.trees)
    again = B.fit_many(train, [job(params)], "y")["one"]
    assert [t.value.tolist() for t in again.trees] == [t.value.tolist() for t in fitted.trees]


def test_null_targets_and_features(spark, numbers):
    holes = numbers.withColumn("b", F.lit(None).cast("double")).withColumn(
        "y", F.when(F.col("row") > 20, F.col("y")))
    fitted = B.fit_many(holes, [job(replace(WHOLE, rounds=3))], "y")["one"]
    assert fitted.predict(holes).where("prediction IS NULL").count() == 0


def test_queries_run_the_whole_protocol(spark, monkeypatch):
    """Settings and weeks, as the registered queries hand them on."""
    seen = {}
    d = SimpleNamespace(gold=None, spark=spark, once=lambda name, make: make(),
                        star=SimpleNamespace(schedules=None, rosters=None, depth_snapshots=None))

    def taken(name):
        def run(*args, **named):
            seen[name] = (args, named)
            raise LookupError
        return run

    monkeypatch.setattr(E, "training_frame", lambda gold: None)
    monkeypatch.setattr(E, "stored_frame", lambda frame: None)
    monkeypatch.setattr(P.SL, "before", lambda *a: None)
    for name in ("fit", "walk_models", "latest_model"):
        monkeypatch.setattr(E, name, taken(name))

    def call(name, inner):
        with pytest.raises(LookupError):
            P.add.__globals__["QUERIES"][name](spark, "")
        return seen.pop(inner)[0]

    monkeypatch.setattr("checks.suite.domain", lambda *a: d)
    for name in ("m5_boosted_baseline", "m12_importance"):
        assert call(name, "fit")[3] == E.BASELINE
    for name in ("m6_early_stopping", "g10_slate_scored"):
        assert call(name, "fit")[3] == E.Params()
    assert call("m8_walk_forward_global", "walk_models")[1:] == ({"": E.Params()}, (9, None), None)
    assert call("m8_walk_forward_positions", "walk_models")[1:] == (
        {"": E.Params()}, (9, None), E.position_features())
    _, settings, weeks, groups = call("m9_grid_tuning", "walk_models")
    assert list(settings.values()) == E.GRID and weeks == E.TUNE_WEEKS and groups is None
    assert call("m14_predict_latest", "latest_model")[1] == E.Params()
    assert (E.Params().rounds, E.Params().patience, len(E.GRID)) == (500, 20, 12)


def test_walks_and_tuning_cover_their_weeks(spark, league):
    frame = E.training_frame(FT.build_gold(league))
    season, week = frame.agg(F.max(F.struct("season", "week"))).first()[0]
    params = replace(E.Params(), rounds=2, patience=1)
    out = E.walk_forward(frame, params, weeks=(week - 1, None))
    assert {r.test_week for r in out.select("test_week").distinct().collect()} == {week - 1, week}
    tuned = E.tune(frame, [params, replace(params, max_depth=1)], (week - 1, week)).collect()
    assert len(tuned) == 2 and tuned[0].tune_mae <= tuned[1].tune_mae
    assert E.best_params(spark.createDataFrame(tuned)).max_depth == tuned[0].max_depth
    expected = frame.where((F.col("season") == season) & (F.col("week") >= week - 1)).count()
    assert out.count() == expected


def test_a_level_sums_and_sends_only_what_its_tree_needs():
    """Of 30 features two are used: their sums and the first one's are made; rows end in the
    nodes that a walk of one row after another finds."""
    r = np.random.default_rng(5)
    bins, y = r.integers(0, B.BINS, (30, 200)).astype(np.uint8), r.normal(size=200)
    splits = np.full((200, 1), B.TRAIN, dtype=np.int8)
    fit = B.Fit(replace(WHOLE, colsample=1.0), 0, np.isin(np.arange(30), [7, 9]))
    tree = B.Tree(3)
    tree.feature[:3], tree.bin[:3] = (7, 9, 9), (30, 20, 40)
    nodes = []
    for row in bins.T:
        i = 0
        while tree.feature[i] >= 0:
            i = 2 * i + 1 + (row[tree.feature[i]] > tree.bin[i])
        nodes.append(i)
    assert tree.walk(bins, tree.bin).tolist() == nodes
    sums = dict(B._sums((((0, 200),), bins, y, splits), {0: fit}, {0: tree}, 2, lambda k: 0.0))[0, "grow"]
    assert fit.summed().tolist() == [0, 7, 9] and sums.shape == (2, 4, 3, B.BINS)
    for node in range(4):
        for j, f in enumerate([0, 7, 9]):
            at = np.array(nodes) == node + 3
            assert sums[1, node, j].tolist() == np.bincount(bins[f, at], minlength=64).tolist()
            assert sums[0, node, j] == pytest.approx(np.bincount(bins[f, at], -y[at], 64))


def test_a_frame_of_many_parts_is_one_block(spark, numbers):
    """Fits over one block of all parts, in a job for ten rounds, are those over the parts."""
    params = replace(WHOLE, rounds=12, subsample=0.7, colsample=0.7, patience=50)
    jobs = [job(params), B.Job("flat", replace(params, max_depth=1), F.col("part"), ("a", "b"))]
    parts = B.packed_blocks(numbers, ["a", "b"], "y", [F.col("part")], [np.array([0.0])] * 2, 70)
    assert parts.count() == 1 and len(parts.first()[0]) > 1
    whole = B.fit_many(numbers, jobs, "y", block_rows=70)
    apart = B.fit_many(numbers, jobs, "y", block_rows=70, whole_rows=0)
    for name in whole:
        assert whole[name].errors == pytest.approx(apart[name].errors)
        for one, other in zip(whole[name].trees, apart[name].trees, strict=True):
            assert one.value == pytest.approx(other.value)


def test_a_fit_over_one_block_is_one_task(spark, numbers):
    """The number of jobs does not grow with the rounds, and each fit has its task."""
    def jobs_of(rounds):
        spark.sparkContext.setJobGroup(f"fits-{rounds}", "")
        params = replace(WHOLE, rounds=rounds, patience=rounds)
        models = B.fit_many(numbers, [replace(job(params), name=str(i)) for i in range(3)], "y")
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"fits-{rounds}")]
        tasks = tracker.getStageInfo(max(s for j in jobs for s in j.stageIds)).numTasks
        return len(jobs), tasks, {len(m.errors) for m in models.values()}

    few, many = jobs_of(5), jobs_of(50)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few[0] == many[0] and few[1] == many[1] == 3
    assert many[2] == {50}


@pytest.fixture(scope="module")
def many(spark):
    """3,000 rows without ties between features; 'few' marks 300 rows, 'part' all."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        x = r.normal(size=5).tolist()
        y = 3.0 * (x[0] > 0) - 2.0 * (x[1] > 0.3) * (x[0] < 0.5) + x[2] + 0.3 * r.normal()
        part = ("train", "train", "val", "train", None)[i % 5]
        rows.append((*x, float(y), part, part if i % 10 < 3 and i % 3 == 0 else None))
    return spark.createDataFrame(
        rows, "a double, b double, c double, d double, e double, y double, part string, "
              "few string").repartition(3).localCheckpoint()


def same_trees(one, other):
    assert one.errors == pytest.approx(other.errors, rel=1e-9)
    for t, u in zip(one.trees, other.trees, strict=True):
        assert (t.feature == u.feature).all() and (t.bin == u.bin).all()
        assert (t.rows == u.rows).all() and t.value == pytest.approx(u.value, abs=1e-8)


def test_exact_sums_give_the_same_trees(many):
    """In one block, over many blocks, and of a fit's own rows gathered in a task."""
    names = ("a", "b", "c", "d", "e")
    params = replace(E.Params(), rounds=12, patience=50, min_child_weight=9)
    jobs = [B.Job("all", params, F.col("part"), names),
            B.Job("flat", replace(params, max_depth=2, subsample=1.0), F.col("part"), names[:2]),
            B.Job("few", replace(params, max_depth=2), F.col("few"), names)]
    plain = B.fit_many(many, jobs, "y", block_rows=200)
    alone = B.fit_many(many, jobs, "y", block_rows=200, paired_rows=0)
    apart = B.fit_many(many, jobs, "y", block_rows=200, whole_rows=1000)
    steps = B.fit_many(many, jobs, "y", block_rows=200, whole_rows=0)
    for name in plain:
        for other in (alone, apart, steps):
            same_trees(plain[name], other[name])


def test_pairs_of_bins_give_the_sums_of_each_feature():
    r = np.random.default_rng(6)
    bins = r.integers(0, B.BINS, (5, 9000)).astype(np.uint8)
    grads, rows = np.rint(r.normal(size=9000) * 2 ** 20), np.flatnonzero(r.random(9000) < 0.7)
    for some in (rows, rows[:100]):                       # by pairs, and one after another
        sums = B._node_sums(bins, some, grads, np.array([0, 2, 4]))
        for j, f in enumerate((0, 2, 4)):
            assert sums[0, j].tolist() == np.bincount(bins[f, some], grads[some], 64).tolist()
            assert sums[1, j].tolist() == np.bincount(bins[f, some], minlength=64).tolist()


def test_of_two_children_the_smaller_one_is_summed():
    tree = B.Tree(3)
    tree.feature[:3], tree.rows[:7] = (1, 1, 1), (100, 70, 30, 60, 10, 3, 27)
    assert B._to_sum(tree, 0, 5) == [0]
    assert B._to_sum(tree, 1, 5) == [2] and B._to_sum(tree, 2, 5) == [4, 5]
    assert B._to_sum(tree, 2, 20) == [4]                  # 27 rows are too few for a split


def test_a_large_frame_is_stored_in_files_for_all_cores(spark):
    rows = spark.range(5 * B.PAIRED_ROWS).withColumn("y", F.col("id") * 2.0)
    frame = E.stored_frame(rows)
    assert len(frame.inputFiles()) == 5
    assert frame.agg(F.sum("id")).first()[0] == rows.agg(F.sum("id")).first()[0]
    assert len(E.stored_frame(rows.limit(100)).inputFiles()) == 1
