"""Tables registered in the session catalog, with their slices as catalog partitions.

The catalog holds which slices a table has, so reads list the files of the slices they
want and the newest slice is known without looking at any file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.session import stage
from weekcast.sources.sinks import SLICE, inside_slice


def register(spark: SparkSession, name: str, path: str, target: T.StructType) -> None:
    """Make the sliced parquet table at ``path`` known as ``name``, all its slices included.

    Columns that older slices lack read as NULL.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in target.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet "
              f"PARTITIONED BY ({', '.join(SLICE)}) LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def slices(spark: SparkSession, name: str) -> DataFrame:
    """(season, week) of every slice, from the catalog alone."""
    parts = spark.sql(f"SHOW PARTITIONS {name}")
    value = lambda c: F.regexp_extract("partition", rf"{c}=(\d+)", 1).try_cast("int").alias(c)
    return parts.select(*map(value, SLICE))


def newest_slice(spark: SparkSession, name: str) -> tuple[int, int] | None:
    """The greatest (season, week) that the table has; None if it has no slice."""
    found = slices(spark, name).agg(F.max(F.struct(*SLICE)).alias("latest")).first()["latest"]
    return tuple(found) if found else None


def replace_slice(df: DataFrame, name: str, season: int, week: int) -> None:
    """Replace one slice by exactly the rows of ``df``, also when those are none or are read
    from the same table.

    The rows are stored apart first. Then a static partition overwrite swaps that slice's
    files and touches no other; a slice that has become empty leaves the catalog. Every row
    must belong to the slice: a stray one fails before anything is replaced. Columns are
    matched by name; ones the table lacks are added to it, ones the rows lack are NULL.
    """
    spark = df.sparkSession
    rows = stage(inside_slice(df, season, week), "slice")
    have = spark.table(name).schema
    new = [f for f in rows.schema.fields if f.name not in have.names]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS (" + ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in new) + ")")
        have = spark.table(name).schema
    body = rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in have.fields if f.name not in SLICE])
    view = f"slice_of_{name}"
    body.hint("rebalance").createOrReplaceTempView(view)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (season = {season}, week = {week}) "
              f"SELECT * FROM {view}")
    spark.catalog.dropTempView(view)
    if rows.isEmpty():
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (season = {season}, week = {week})")
    spark.catalog.refreshTable(name)
