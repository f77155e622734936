"""Best-fit packing of documents into training sequences.

Bounded-space online best fit: a task keeps a fixed number of open sequences, in
stacks keyed by their free space, with one bit for each stack that is not empty. A
piece goes to the open sequence with the least room that still holds it; if there is
none, a new one opens, and the fullest closes when there are too many.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weekcast.llm.common import in_tasks_of, ship_code, text_bytes
from weekcast.llm.tokens import encoder

OPEN = 4096
TASK_BYTES = 32 << 20
ROWS_AT_ONCE = 200


class BestFit:
    """Places pieces one by one; ``place`` gives (sequence, offset)."""

    def __init__(self, size: int, open_bins: int = OPEN):
        self.size, self.most, self.open = size, open_bins, 0
        self.bits = 0                                     # bit f: a bin has f free
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.sequences = 0

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        roomy = self.bits >> length
        if roomy:
            free = length + (roomy & -roomy).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.sequences
            self.sequences += 1
        left = free - length
        if left:
            if self.open == self.most:                    # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            if not self.bins[left]:
                self.bits |= 1 << left
            self.bins[left].append(number)
            self.open += 1
        return number, self.size - free


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1,
         open_bins: int = OPEN, task_bytes: int = TASK_BYTES, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned
    32-bit), sequence_id, offset. With ``digest``, ids_crc32 stands in for the ids.

    A document is the ids of its text and ``end_id``; null or empty text is the end
    id alone. Only documents longer than ``size`` are cut, the last piece is what is
    left. Sequences are filled without gaps from offset 0. doc_id may be null or
    repeated: every row is a document. Other columns are not read. An empty table
    gives no rows. ``tokenizer`` is the path of a tokenizer file on the executors.

    Nothing is shuffled: each task packs the rows it reads, and small inputs are
    read by few tasks, so that a task leaves few sequences partly filled. Memory is
    a batch of rows and ``open_bins`` numbers.
    """
    width = 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bins = encoder(tokenizer), BestFit(size, open_bins)
        first, end = TaskContext.get().partitionId() << 40, np.uint32(end_id).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = []
                for i, ids in enumerate(ids_of.encode(part.column("text").to_pylist())):
                    ids += end
                    for piece, lo in enumerate(range(0, len(ids), size * width)):
                        body = ids[lo:lo + size * width]
                        number, offset = bins.place(len(body) // width)
                        rows.append((i, piece, lo // width, len(body) // width,
                                     zlib.crc32(body) if digest else body,
                                     first + number, offset))
                row, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)),
                     *[pa.array(v, t) for v, t in zip(rest, (
                         pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary(),
                         pa.int64(),
                         pa.int64()), strict=True)]],
                    names=out.names)

    out = T.StructType([docs.schema["doc_id"]] + [
        T.StructField(n, t) for n, t in (
            ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
            ("ids_crc32", T.LongType()) if digest else ("ids", T.BinaryType()),
            ("sequence_id", T.LongType()), ("offset", T.LongType()))])
    ship_code(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    return in_tasks_of(docs, text_bytes(docs, "text"), task_bytes).mapInArrow(run, out)
