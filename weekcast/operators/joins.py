"""Domain-free joins.

No join here carries a broadcast hint (the one hint of the library is on the
season calendar of ``windows.densify``, whose size is checked). Small sides are broadcast by Spark when
their measured size (file statistics or adaptive runtime size) is under the
configured threshold; beyond it the same plan runs as a shuffle join with
adaptive skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekcast.session import stage


def lookup(left: DataFrame, right: DataFrame, on: dict[str, str], *,
           how: str = "left") -> DataFrame:
    """Equi-join ``left.key == right.key`` and drop the right keys.

    A NULL key matches nothing.
    """
    renamed = {r: f"_lookup_{r}" for r in on.values()}
    right = right.withColumnsRenamed(renamed)
    condition = [left[l] == right[renamed[r]] for l, r in on.items()]
    return left.join(right, condition, how).drop(*renamed.values())


def same_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], *,
              how: str = "inner") -> DataFrame:
    """Join on a row key whose parts may be NULL: NULL equals NULL."""
    renamed = {k: f"_same_{k}" for k in keys}
    right = right.withColumnsRenamed(renamed)
    condition = [left[k].eqNullSafe(right[r]) for k, r in renamed.items()]
    return left.join(right, condition, how).drop(*renamed.values())


def merge_outer(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of additive tables where NULL keys equal NULL keys.

    Expressed as a union and one grouped sum: grouping treats NULLs as equal,
    and n tables cost one shuffle rather than n - 1 joins. Measures that a
    table lacks are 0.
    """
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    values = [c for c in merged.columns if c not in keys]
    return merged.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in values])


def outer_all(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of tables that are unique on ``keys`` (no NULL keys).

    Same one-shuffle shape as ``merge_outer`` for arbitrary column types; a
    value missing on every side stays NULL.
    """
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    values = [c for c in merged.columns if c not in keys]
    return merged.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def opponent_value(df: DataFrame, keys: Sequence[str], entity: str, opponent: str,
                   value: str, out: str) -> DataFrame:
    """Attach the opponent's own value from the same table (self-join)."""
    other = df.select(*keys, F.col(entity).alias("_other"), F.col(value).alias(out))
    return lookup(df, other, {**{k: k for k in keys}, opponent: "_other"})


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_time: str,
                  right_time: str, value: str, *, out: str | None = None,
                  bucket: str | None = None) -> DataFrame:
    """Latest right value at or before each left row's time, per key.

    Equality counts as a match. Left rows with a NULL key or time pass through
    with a NULL value. Where the right side repeats a (key, time) its smallest
    value wins.

    The search runs on a skeleton: the distinct (key, time) points of both
    sides, combined on the map side. Row multiplicity never reaches the
    window, so a hot key costs as much as it has distinct times, and its left
    rows are spread over their times in the final join. When times are finer
    than days, ``bucket`` (a ``date_trunc`` unit) splits each key's points into
    independent windows; the value in force at the start of a bucket is
    carried in from a per-bucket summary. Choose the unit so that a key has
    few points per bucket and few buckets overall; the result is the same for
    every unit.
    """
    out = out or value
    known, tagged = _skeleton(left, right, by, left_time, right_time, value)
    groups = ["_key"]
    if bucket:
        tagged = tagged.withColumn("_bucket", F.date_trunc(bucket, "_time"))
        groups = ["_key", "_bucket"]
    running = (Window.partitionBy(*groups).orderBy("_time", "_side")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = tagged.withColumn(
        "_found", F.last("_value", ignorenulls=True).over(running)).where("_side = 1")
    if bucket:
        found = _carry_in(found, known, bucket)
    return _answer(left, found, by, left_time, out)


def asof_segmented(left: DataFrame, right: DataFrame, by: str, left_time: str,
                   right_time: str, value: str, *, out: str | None = None) -> DataFrame:
    """``asof_backward`` for keys that own any share of the points, at any resolution.

    The skeleton is range-partitioned by (key, time), so a hot key takes up as many
    partitions as its points need, and stored with the number of the partition. Each
    stretch of a key in a partition is searched by itself. A key that goes on in the next
    partition carries its last value there: that is one row a partition, and the only
    window that sees a whole key runs over those. There is no unit to choose.
    """
    out = out or value
    _, tagged = _skeleton(left, right, by, left_time, right_time, value)
    # stored, since the range bounds may come out otherwise when tasks run again
    points = stage(tagged.repartitionByRange("_key", "_time", "_side")
                   .withColumn("_part", F.spark_partition_id()), "asof-points")
    stretch = Window.partitionBy("_part", "_key")
    found = points.withColumn("_found", F.last("_value", ignorenulls=True).over(
        stretch.orderBy("_time", "_side").rowsBetween(
            Window.unboundedPreceding, Window.currentRow))).where("_side = 1")
    # at most one key goes on from a partition into the next
    ends = points.groupBy("_key", "_part").agg(
        F.max(F.when(F.col("_side") == 0, F.struct("_time", "_value"))).alias("_last"))
    going_on = (points.groupBy("_key").agg(F.min("_part").alias("a"), F.max("_part").alias("b"))
                .where("a < b").select("_key"))
    earlier = (Window.partitionBy("_key").orderBy("_part")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.join(going_on, "_key").select(
        "_key", "_part",
        F.last("_last", ignorenulls=True).over(earlier)["_value"].alias("_carried"))
    found = found.join(carried, ["_key", "_part"], "left").withColumn(
        "_found", F.coalesce("_found", "_carried"))
    return _answer(left, found, by, left_time, out)


def _skeleton(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str,
              value: str) -> tuple[DataFrame, DataFrame]:
    """The values known at (key, time), and these beside the points that are asked for."""
    points = left.where(F.col(by).isNotNull() & F.col(left_time).isNotNull()).select(
        F.col(by).alias("_key"), F.col(left_time).alias("_time")).distinct()
    known = (right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull())
             .groupBy(F.col(by).alias("_key"), F.col(right_time).alias("_time"))
             .agg(F.min(value).alias("_value"))
             .where("_value IS NOT NULL"))
    return known, known.withColumn("_side", F.lit(0)).unionByName(
        points.withColumn("_side", F.lit(1)), allowMissingColumns=True)


def _answer(left: DataFrame, found: DataFrame, by: str, left_time: str, out: str) -> DataFrame:
    """``left`` with the value found at its (key, time)."""
    answers = found.where("_found IS NOT NULL").select(
        F.col("_key").alias(by), F.col("_time").alias(left_time),
        F.col("_found").alias(out), F.lit(0).cast("long").alias("_spread"))
    # rows that can match nothing are spread by their content, not sent to one partition
    missing = F.col(by).isNull() | F.col(left_time).isNull()
    spread = left.withColumn("_spread", F.when(missing, F.xxhash64(*left.columns))
                             .otherwise(F.lit(0).cast("long")))
    return spread.join(answers, [by, left_time, "_spread"], "left").select(*left.columns, out)


def _carry_in(found: DataFrame, known: DataFrame, bucket: str) -> DataFrame:
    """Fill points that precede the first right value of their bucket."""
    last_of_bucket = (
        known.groupBy("_key", F.date_trunc(bucket, "_time").alias("_bucket"))
        .agg(F.max(F.struct("_time", "_value")).alias("_last"))
        .select("_key", "_bucket", F.col("_last._value").alias("_value")))
    buckets = found.select("_key", "_bucket").distinct().unionByName(
        last_of_bucket, allowMissingColumns=True)
    earlier = (Window.partitionBy("_key").orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = buckets.groupBy("_key", "_bucket").agg(
        F.max("_value").alias("_value")).withColumn(
        "_carried", F.last("_value", ignorenulls=True).over(earlier)).select(
        "_key", "_bucket", "_carried")
    return (found.join(carried, ["_key", "_bucket"], "left")
            .withColumn("_found", F.coalesce("_found", "_carried")))
