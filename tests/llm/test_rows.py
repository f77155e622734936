"""Row numbers hold although later scans of the same files are split otherwise."""

import pytest

from weekcast.llm import common, decontaminate, exact_dedup, near_dup, shuffle_shards

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def moving(spark, tmp_path, monkeypatch):
    """A stored table whose splits change after each written stage."""
    def text(i):
        return " ".join(f"w{i}x{j}" for j in range(40))

    path = str(tmp_path / "docs")
    rows = [(i, text(i % 25)) for i in range(50)] + [(None, text(60)), (3, text(3))]
    for k in range(4):
        spark.createDataFrame(rows[k * 13:(k + 1) * 13], "doc_id long, text string").coalesce(
            1).write.mode("append").parquet(path)
    old, turn, plain = spark.conf.get(SPLIT), [0], common.write_stage

    def shifted(*args, **options):
        out = plain(*args, **options)
        turn[0] += 1
        spark.conf.set(SPLIT, ["700", "64m", "300"][turn[0] % 3])
        return out

    for module in (common, near_dup, decontaminate, exact_dedup):
        monkeypatch.setattr(module, "write_stage", shifted)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark.read.parquet(path), rows, text
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.set(SPLIT, old)


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())


def test_copies(moving):
    docs, rows, text = moving
    stays = [(-1, text(60))] + [(i, text(i)) for i in range(25, 50)]
    stays = sorted((d, text(d % 25)) if d >= 25 else (d, t) for d, t in stays)
    assert ids(near_dup.drop_near_duplicates(docs)) == stays
    assert ids(exact_dedup.drop_exact_duplicates(docs)) == stays


def test_leaks(spark, moving):
    docs, rows, text = moving
    bench = spark.createDataFrame([(1, text(3)), (2, text(7))], "item_id long, text string")
    left = sorted((-1 if d is None else d, t) for d, t in rows if t not in (text(3), text(7)))
    assert ids(decontaminate.drop_contaminated(docs, bench)) == left


def test_shards(moving):
    docs, rows, _ = moving
    out = shuffle_shards.write_shards(docs, 3, bucket_bytes=1500)
    assert ids(out) == sorted((-1 if d is None else d, t) for d, t in rows)
    slots = sorted((r.shard, r.slot) for r in out.select("shard", "slot").collect())
    sizes = [sum(s == k for s, _ in slots) for k in range(3)]
    assert slots == [(k, i) for k in range(3) for i in range(sizes[k])]
    assert max(sizes) - min(sizes) <= 1


def test_a_column_of_that_name_is_data(spark):
    """Neither as a row number, though it repeats, nor lost."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 7), (2, text, 7), (3, text + " end", 7), (4, "other words", None)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {common.ROW} int")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    for kept, left in ((near_dup.drop_near_duplicates(docs), {3, 4}),
                       (exact_dedup.drop_exact_duplicates(docs), {2, 3, 4}),
                       (decontaminate.drop_contaminated(docs, bench), {4})):
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] in left}
    out = shuffle_shards.write_shards(docs, 2)
    assert sorted(tuple(r) for r in out.select(*docs.columns).collect()) == rows


def test_shards_keep_columns_of_any_name(spark):
    names = ["place", "row", "bucket", "offset", "record", "rows", "at", "entry", "count"]
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "9 AS Slot",
                                       *[f"id + {i} AS {n}" for i, n in enumerate(names)])
    out = shuffle_shards.write_shards(docs, 5, bucket_bytes=2000)
    assert sorted(out.columns) == sorted(["doc_id", "text", "shard", "slot", *names])
    got = out.select("doc_id", *names).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))
    assert all(r[n] == r.doc_id + i for r in got for i, n in enumerate(names))
