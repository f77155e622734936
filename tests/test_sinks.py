"""Rebuild, slice replace, conformance and the slice gate."""

import os
import re
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast import schema
from weekcast.session import new_path, shared_folder, stage
from weekcast.sources import catalog, sinks, tables

ROWS = [("a", 2024, 1, 1.0), ("b", 2024, 1, 2.0), ("a", 2024, 2, 3.0), ("a", 2025, 1, 4.0)]
DDL = "id string, season int, week int, v double"


@pytest.fixture
def table(spark):
    path = new_path(spark, "table")
    sinks.rebuild(spark.createDataFrame(ROWS, DDL), path)
    return path


def content(spark, path):
    return sorted(tuple(r[c] for c in ("id", "season", "week", "v"))
                  for r in spark.read.parquet(path).collect())


def test_replace_leaves_other_slices(spark, table):
    sinks.replace_slice(spark.createDataFrame([("z", 2024, 1, 9.0)], DDL), table, 2024, 1)
    assert content(spark, table) == [
        ("a", 2024, 2, 3.0), ("a", 2025, 1, 4.0), ("z", 2024, 1, 9.0)]


@pytest.mark.parametrize("stray", [(2024, 2), (None, 1), (2025, 1)])
def test_stray_row_fails_and_changes_nothing(spark, table, stray):
    rows = spark.createDataFrame([("z", 2024, 1, 9.0), ("y", *stray, 9.0)], DDL)
    with pytest.raises(PySparkException):
        sinks.replace_slice(rows, table, 2024, 1)
    assert content(spark, table) == sorted(ROWS)


def test_replace_by_no_rows(spark, table):
    none = spark.createDataFrame([], DDL)
    sinks.replace_slice(none, table, 2024, 1)
    assert content(spark, table) == [("a", 2024, 2, 3.0), ("a", 2025, 1, 4.0)]
    sinks.replace_slice(none, table, 2030, 9)                       # a slice that is not there
    assert len(content(spark, table)) == 2


def test_catalog_tables(spark, table):
    schema_of = T.StructType.fromDDL(DDL)
    catalog.register(spark, "sliced", table, schema_of)
    rows = lambda: sorted(tuple(r[c] for c in ("id", "season", "week", "v"))
                          for r in spark.table("sliced").collect())
    assert rows() == sorted(ROWS) and catalog.newest_slice(spark, "sliced") == (2025, 1)
    plan = spark.table("sliced").where("season = 2025")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "FileScan" in plan
    assert len(spark.table("sliced").where("season = 2025").inputFiles()) == 1
    catalog.replace_slice(spark.table("sliced").where("season = 2025 AND v < 0"), "sliced", 2025, 1)
    assert catalog.newest_slice(spark, "sliced") == (2024, 2) and len(rows()) == 3
    own = spark.table("sliced").where("season = 2024 AND week = 1").withColumn("v", F.col("v") + 1)
    catalog.replace_slice(own.withColumn("note", F.lit("new")), "sliced", 2024, 1)
    assert rows() == [("a", 2024, 1, 2.0), ("a", 2024, 2, 3.0), ("b", 2024, 1, 3.0)]
    assert {(r.week, r.note) for r in spark.table("sliced").collect()} == {(1, "new"), (2, None)}
    with pytest.raises(PySparkException):
        catalog.replace_slice(spark.createDataFrame([("z", 2024, 2, 9.0)], DDL), "sliced", 2024, 1)
    assert len(rows()) == 3
    spark.sql("DROP TABLE sliced")


def test_replace_with_a_new_column(spark, table):
    rows = spark.createDataFrame([("z", 2024, 1, 9.0, "text")], DDL + ", insight string")
    sinks.replace_slice(rows, table, 2024, 1)
    merged = sinks.merged_history(spark, table)
    assert {(r.id, r.insight) for r in merged.collect()} == {("a", None), ("z", "text")}


def test_conform_casts_drops_and_adds(spark):
    target = T.StructType([T.StructField("v", T.IntegerType()), T.StructField("w", T.StringType()),
                           T.StructField("id", T.StringType())])
    out = sinks.conform(spark.createDataFrame(ROWS, DDL), target)
    assert [(f.name, f.dataType) for f in out.schema.fields] == [
        (f.name, f.dataType) for f in target.fields]
    assert out.first() == (1, None, "a")


def test_slice_gate(spark, table):
    df = spark.read.parquet(table)
    assert sinks.require_slice(df, 2024, 1) == 2
    with pytest.raises(sinks.MissingSliceError):
        sinks.require_slice(df, 2024, 3)
    with pytest.raises(sinks.MissingSliceError):
        sinks.require_slice(df, 2030, 1)


def test_sources_read_with_declared_schema_and_season_filter(spark, league):
    folder = new_path(spark, "sources")
    sinks.rebuild(league.plays, f"{folder}/plays")
    plays = tables.read_source(spark, folder, "plays", [2024])
    assert {f.name: f.dataType for f in plays.schema.fields} == {
        f.name: f.dataType for f in schema.PLAYS.fields}
    assert plays.select("season").distinct().collect() == [(2024,)]
    plan = plays._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*season", plan)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, "y")], "v double, s string")
    assert tables.nan_to_null(df).where(F.col("v").isNull()).count() == 1


def test_stages_go_to_the_named_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    staged = stage(spark.range(5).selectExpr("id", "id % 2 AS kind"), "part", "kind")
    assert staged.columns == ["id", "kind"]
    assert folder in staged.inputFiles()[0]
    assert staged.where("kind = 1").count() == 2


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {os.path.join(at, n) for d in dirs for at, _, names in os.walk(d.getPath())
            for n in names if n.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    rows = spark.range(3000).select((F.col("id") % 7).cast("int").alias("season"),
                                    (F.col("id") % 3).cast("int").alias("week"), "id")
    before = shuffle_files(spark)
    held = [rows.groupBy("season").agg(F.sum("id").alias("n")), rows.repartition(3)]  # no garbage
    staged = [stage(df, "left") for df in held]
    sinks.rebuild(rows, new_path(spark, "left"))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert staged[0].count() == 7 and staged[1].count() == 3000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
