"""Sharding by a two-pass external shuffle.

Pass one scatters the records evenly, by a seeded hash of their place in the table,
into buckets that fit in memory. Pass two puts each bucket in Fisher-Yates order
(the built-in ``shuffle``) and writes it. Bucket after bucket, this is one random
order of the whole table, which is cut into shards whose sizes differ by a row at
most. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import ROW, broadcast_if, columns_of, numbered
from weekcast.session import new_path

BUCKET_BYTES = 16 << 20
ROW_BYTES = 8
BROADCAST_BUCKETS = 1_000_000      # two numbers each


def record_bytes() -> F.Column:
    """UTF-8 bytes of the text (null: none) and a fixed share of the row."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES


def write_shards(docs: DataFrame, shards: int, seed: int = 17,
                 bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write ``docs`` in random order as ``shards`` folders and return a scan of them.

    The result has the columns of ``docs``, ``shard`` (0 to shards - 1) and ``slot``
    (the place in the shard, gapless from 0). Row counts of shards differ by one at
    most. Null texts and ids, repeated rows and texts of any length are records like
    others: a row is dealt by its place, so equal rows spread evenly. Columns of
    ``docs`` named ``shard`` or ``slot``, in any case, are replaced; other names are
    kept, whatever they are. An empty table gives no rows. Each bucket is a task of its
    own; a record larger than ``bucket_bytes`` makes a larger bucket. The files of a shard
    hold runs of consecutive slots.
    """
    spark = docs.sparkSession
    total = docs.agg(F.count(F.lit(1)), F.sum(record_bytes())).first()
    rows, size = total[0], total[1] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.col("row"), F.lit(seed)), F.lit(buckets)).cast("int")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    docs = numbered(docs, *kept)
    placed = docs.select(F.col(ROW).alias("row"), F.struct(*columns_of(docs)).alias("record"))
    offsets = (docs.select(F.col(ROW).alias("row")).groupBy(bucket.alias("bucket")).count()
               .select("bucket", (F.sum("count").over(Window.orderBy("bucket"))
                                  - F.col("count")).alias("offset")))
    shuffled = (
        placed.withColumn("bucket", bucket).repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("row", "record"))).alias("rows"))
        .join(broadcast_if(offsets, buckets, BROADCAST_BUCKETS), "bucket")
        .select("offset", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "entry"))
        .select((F.col("offset") + F.col("at")).alias("place"), "entry.record"))
    # shard s starts at floor(s * rows / shards), in whole numbers
    shard = F.expr(f"((place + 1) * {shards} - 1) div {max(rows, 1)}")
    start = F.expr(f"(shard * {rows}) div {shards}")
    out = (shuffled.withColumn("shard", shard.cast("int"))
           .select("record.*", "shard", (F.col("place") - start).alias("slot")))
    path = path or new_path(spark, "llm/shards")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
