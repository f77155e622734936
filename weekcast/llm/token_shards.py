"""Token ids in training order, as binary shards of a fixed stride.

Documents become one stream of ids per task, cut into sequences of equal length. A
keyed Feistel permutation with cycle walking maps the number of each sequence to its
global slot, so the order is random, fixed by the key, and any slot can be computed
without a table. Slots are range-partitioned into shard files of equal records:
slot s is record ``s % per_shard`` of shard ``s // per_shard``, so a reader resumes
from a slot by a seek.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekcast.llm.common import in_tasks_of, ship_code, text_bytes, write_stage
from weekcast.llm.tokens import encoder
from weekcast.session import new_path

LENGTH = 2048                      # ids of a sequence
HEADER = "<IQI"     # stream, number in the stream, ids that are no padding
SHARD_BYTES = 4 << 20
TASK_BYTES = 32 << 20
ROWS_AT_ONCE = 200
ROUNDS = 6
END = "\n"                         # the writer closes each record with it


def stride(length: int = LENGTH) -> int:
    return struct.calcsize(HEADER) + 2 * length + len(END)


def feistel(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """A permutation of 0..count-1: ``count`` need not be a power of two, since
    results outside the range go through the network again until they fall inside."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def mixed(x: np.ndarray, turn: int) -> np.ndarray:
        x = x + np.uint64((key + 0x9E3779B97F4A7C15 * (turn + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & mask

    out = np.asarray(numbers).astype(np.uint64)
    walk = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        while walk.any():
            left, right = out[walk] >> shift, out[walk] & mask
            for turn in range(ROUNDS):
                left, right = right, left ^ mixed(right, turn)
            out[walk] = (left << shift) | right
            walk = out >= np.uint64(count)
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1,
              task_bytes: int = TASK_BYTES) -> DataFrame:
    """stream, number and packed (a zstandard frame of one record) of each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, squeeze = encoder(tokenizer, "<u2"), zstandard.ZstdCompressor(level=3)
        stream, number, rest = TaskContext.get().partitionId(), 0, b""
        end, full = np.uint16(end_id).tobytes(), 2 * length

        def rows(bodies: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            packed = [squeeze.compress(struct.pack(HEADER, stream, number + i, len(b) // 2)
                                       + b.ljust(full, b"\0")) for i, b in enumerate(bodies)]
            numbers = range(number, number + len(bodies))
            number += len(bodies)
            return pa.RecordBatch.from_arrays(
                [pa.array([stream] * len(bodies), pa.int32()), pa.array(numbers, pa.int64()),
                 pa.array(packed, pa.binary())], names=["stream", "number", "packed"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                texts = batch.slice(at, ROWS_AT_ONCE).column("text").to_pylist()
                rest += b"".join(ids + end for ids in ids_of.encode(texts))
                cut = len(rest) - len(rest) % full
                if cut:
                    yield rows([rest[i:i + full] for i in range(0, cut, full)])
                    rest = rest[cut:]
        if rest:
            yield rows([rest])

    ship_code(docs.sparkSession)
    docs = docs.select("text")
    return in_tasks_of(docs, text_bytes(docs, "text"), task_bytes).mapInArrow(
        run, "stream int, number long, packed binary")


def write_token_shards(docs: DataFrame, tokenizer: str, key: int = 20_24, length: int = LENGTH,
                       shard_bytes: int = SHARD_BYTES, path: str | None = None) -> str:
    """Write the ids of all documents as binary shards; returns their folder.

    A document is the ids of its text and the end id; a null or empty text is the end
    id alone. Ids never get lost: only the last sequence of a stream is padded. The
    order does not depend on ids or other columns of ``docs``, which may be null,
    repeated or anything else. An empty table gives a folder without shards.
    """
    spark = docs.sparkSession
    stored = write_stage(sequences(docs, tokenizer, length), "sequences")
    streams = stored.groupBy("stream").count()
    total = stored.count()
    offsets = streams.select("stream", (
        F.sum("count").over(Window.orderBy("stream")) - F.col("count")).alias("offset"))

    @F.pandas_udf("long")
    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(), total, key))

    @F.pandas_udf("binary")
    def unpacked(packed: pd.Series) -> pd.Series:
        return packed.map(zstandard.ZstdDecompressor().decompress)

    per_shard = max(1, shard_bytes // stride(length))
    shards = max(1, -(-total // per_shard))
    path = path or new_path(spark, "llm/token-shards")
    (stored.join(F.broadcast(offsets), "stream")           # one row per task that had rows
     .select(slot_of(F.col("offset") + F.col("number")).alias("slot"), "packed")
     .withColumn("shard", F.expr(f"cast(slot div {per_shard} as int)"))
     .repartitionById(shards, "shard")     # a range of slots each: no sample finds the bounds
     .sortWithinPartitions("shard", "slot")
     .select(unpacked("packed").cast("string").alias("value"), "shard")
     .write.partitionBy("shard").option("lineSep", END).text(path))
    return path


def read_token_shards(spark: SparkSession, path: str, start: int = 0, length: int = LENGTH,
                      shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Records from slot ``start`` on: slot, shard, place, stream, number, n_tokens,
    ids (little-endian unsigned 16-bit, without padding) and ids_crc32 of them.

    Shards before the start are not opened.
    """
    ship_code(spark)
    step, head = stride(length), struct.calcsize(HEADER)
    per_shard = max(1, shard_bytes // step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(),
                                      batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                if len(data) % step:
                    raise ValueError(f"shard {shard} has a broken record")
                first = max(0, start - shard * per_shard)
                out = []
                for place in range(first, len(data) // step):
                    at = place * step
                    stream, number, n = struct.unpack_from(HEADER, data, at)
                    ids = bytes(data[at + head:at + head + 2 * n])
                    out.append((shard * per_shard + place, shard, place, stream, number, n,
                                ids, zlib.crc32(ids)))
                for i in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(zip(*out[i:i + 1000], strict=True), (
                            pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(),
                            pa.int32(), pa.binary(), pa.int64()), strict=True)],
                        names=["slot", "shard", "place", "stream", "number", "n_tokens", "ids",
                               "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    if "shard" not in files.columns:                     # no sequences, no folders
        files = files.withColumn("shard", F.lit(0))
    files = files.where(F.col("shard") >= start // per_shard)
    return files.select("shard", "content").mapInArrow(
        run, "slot long, shard int, place int, stream int, number long, n_tokens int, "
             "ids binary, ids_crc32 long")
