"""Exact deduplication by block naming.

The lower-cased text is cut into fixed-size blocks. All blocks of the corpus are
sorted and each distinct one gets an integer name; then adjacent pairs of names
are named in the same way, level by level, until one name is left of each
document. Equal sequences get equal names and different ones never do, so the
identity (level, name) has no collisions, unlike a digest.

The text moves once, in the range exchange of the first level. The sort key ends
with the row number, so a block that a third of all rows share is spread over many
partitions. Blocks are ordered by a hash first; those of a hash that may go on in
another partition are compared by content across partitions, all distinct ones of
them, so blocks of equal hash are neither merged nor kept apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import (
    ROW, lower_ascii, numbered, row_of, ship_code, unnumbered, whole_text, write_stage)

BLOCK_BYTES = 4096


def order_of(key: str) -> Column:
    """What blocks are sorted by before their content: a few bytes, so that the range
    bounds that the driver sees are small. It never decides that blocks are equal."""
    return F.xxhash64(key)


def _rank_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct keys of a partition sorted by (order, key).

    More rows hold in ``edge`` the keys that other partitions may hold too: all distinct
    ones of the first and the last hash. Which hash is the last shows at the end only, so
    one key is held back; a hash of several keys has them all written, wherever it stands.
    """
    part, rank, schema = TaskContext.get().partitionId(), -1, None
    first = last = hash_ = held = None         # held: the last distinct key, if not written

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if schema is None:
            schema = pa.schema([f for f in batch.schema if f.name not in ("key", "order")] + [
                pa.field("part", pa.int32()), pa.field("rank", pa.int64()),
                pa.field("edge", pa.binary())])
            first = batch.column("order")[0].as_py()
        keys, orders = batch.column("key"), batch.column("order")
        new = np.ones(n, dtype=bool)
        new[0] = rank < 0 or keys[0].as_py() != last
        if n > 1:
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        ranks = rank + np.cumsum(new)
        starts = np.flatnonzero(new)
        hashes = orders.to_numpy(zero_copy_only=False)[starts]
        several = np.zeros(len(starts), dtype=bool)       # hashes that have another key
        several[1:] = hashes[1:] == hashes[:-1]
        several[:-1] |= several[1:]
        several |= hashes == first
        if len(starts):
            if hashes[0] == hash_:
                several[0] = True
                if held is not None:
                    yield _edges([held], part, schema)
            hash_, last_key = int(hashes[-1]), keys[int(starts[-1])].as_py()
            held = None if several[-1] else (int(ranks[starts[-1]]), last_key)
            found = [(int(ranks[i]), keys[int(i)].as_py()) for i in starts[several]]
            for at in range(0, len(found), 1000):
                yield _edges(found[at:at + 1000], part, schema)
        rank, last = int(ranks[-1]), keys[n - 1].as_py()
        kept = [batch.column(c) for c in batch.schema.names if c not in ("key", "order")]
        yield pa.RecordBatch.from_arrays(
            kept + [pa.array(np.full(n, part, dtype=np.int32)), pa.array(ranks),
                    pa.nulls(n, pa.binary())], schema=schema)
    if held is not None:
        yield _edges([held], part, schema)


def _edges(found: list[tuple[int, bytes]], part: int, schema: pa.Schema) -> pa.RecordBatch:
    values = {"part": [part] * len(found), "rank": [r for r, _ in found],
              "edge": [k for _, k in found]}
    return pa.RecordBatch.from_arrays(
        [pa.array(values.get(f.name, [None] * len(found)), f.type) for f in schema],
        schema=schema)


def name_keys(rows: DataFrame, name: str) -> DataFrame:
    """Replace binary ``key`` by ``name``, an integer that equal keys share and no two
    different ones.

    ``rows`` needs columns ``row`` and ``pos`` to spread equal keys. The result is
    stored, so names stay as they are when tasks run again.
    """
    out = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields
                        if f.name != "key"] + [
        T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()),
        T.StructField("edge", T.BinaryType())])
    ranked = write_stage(
        rows.withColumn("order", order_of("key"))
        .repartitionByRange("order", "row", "pos").sortWithinPartitions("order", "key")
        .mapInArrow(_rank_sorted, out), name)
    edges = ranked.where("edge IS NOT NULL").select("part", "rank", "edge")
    # the last key of a partition is always an edge; one row per partition that had rows
    counts = edges.groupBy("part").agg((F.max("rank") + 1).alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n"))
                            .alias("offset"))
    placed = edges.join(F.broadcast(offsets), "part").select(
        "edge", (F.col("offset") + F.col("rank")).alias("name"))
    # a key is an edge of a partition once at most
    again = placed.withColumn("one", F.min("name").over(Window.partitionBy("edge")))
    again = write_stage(again.where("one <> name").select("name", "one"), f"{name}-again")
    return (ranked.where("edge IS NULL").drop("edge")
            .join(F.broadcast(offsets), "part")
            .withColumn("name", F.col("offset") + F.col("rank"))
            .drop("part", "rank", "offset")
            .join(again, "name", "left")            # broadcast where its files are small
            .withColumn("name", F.coalesce("one", "name")).drop("one"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, sha (hex SHA-256 of the normalised
    text), level and name. Rows with equal (level, name) have equal texts."""
    ship_code(docs.sparkSession)
    text = docs.select(row_of(docs).alias("row"), "doc_id",
                       lower_ascii(whole_text()).cast("binary").alias("bytes"))
    size = F.octet_length("bytes")
    blocks = F.greatest(F.lit(1), F.ceil(size / block_bytes)).cast("int")
    level = text.select(
        "row", "doc_id", F.sha2("bytes", 256).alias("sha"), blocks.alias("blocks"),
        F.posexplode(F.transform(
            F.sequence(F.lit(0), blocks - 1),
            lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)),
        )).alias("pos", "key"))
    named = name_keys(level, "blocks")
    longest = named.agg(F.max("blocks")).first()[0] or 1
    depth = math.ceil(math.log2(longest)) if longest > 1 else 0
    parts = []
    for k in range(depth + 1):
        parts.append(named.where("blocks = 1").select(
            "row", "doc_id", "sha", F.lit(k).alias("level"), "name"))
        if k == depth:
            break
        side = lambda bit: F.max(F.when(F.col("pos") % 2 == bit, F.col("name")))
        as_bytes = lambda c: F.lpad(F.hex(F.coalesce(c, F.lit(-1))), 16, "0")
        pairs = (named.where("blocks > 1")
                 .groupBy("row", "doc_id", "sha",
                          F.ceil(F.col("blocks") / 2).cast("int").alias("blocks"),
                          F.floor(F.col("pos") / 2).cast("int").alias("pos"))
                 .agg(side(0).alias("left"), side(1).alias("right")))
        named = name_keys(pairs.select(
            "row", "doc_id", "sha", "blocks", "pos",
            F.unhex(F.concat(as_bytes(F.col("left")), as_bytes(F.col("right")))).alias("key")),
            f"pairs{k + 1}")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty
    one. Of a group the row with the largest doc_id stays; among rows that repeat
    this id, the first in the table. A null doc_id counts as smaller than any other
    and keep_id is null only if a group has no other. Columns besides doc_id and
    text are not read. An empty table gives no rows.
    """
    # stored: the plan of all levels is made and run once, though its rows are used twice
    ids = write_stage(identities(docs, block_bytes), "identities")
    groups = (ids.groupBy("level", "name")
              .agg(F.count(F.lit(1)).alias("group_size"),
                   F.max(F.struct("doc_id", (-F.col("row")).alias("before"))).alias("stays"))
              .where("group_size > 1"))
    joined = ids.join(groups, ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "row", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == -F.col("stays.before"))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = numbered(docs)
    gone = exact_duplicates(docs, block_bytes).where("NOT kept").select(
        F.col("row").alias(ROW))
    return unnumbered(docs.join(gone, ROW, "left_anti"))
