"""Column expressions and small helpers shared by the operators."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.session import new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# Everything that is no word character once A-Z is lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, for functions that run in Python workers."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="weekcast-"), "weekcast_code.zip")
    with zipfile.ZipFile(archive, "w") as z:               # Spark serves it from the driver
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def whole_text(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order: runs of a-z, 0-9 and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where it is used in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


ROW = "__row"
_MARK = "row number"
_OTHER = "__row of the input"


def row_number() -> Column:
    """A number for every row of one scan.

    Rows may repeat and ids may be null, so rows are told apart by their place. Another
    scan of the same table may be split otherwise and give other numbers: results that
    are joined by number take it from ``numbered``.
    """
    return F.monotonically_increasing_id()


def is_numbered(docs: DataFrame) -> bool:
    """Whether ``numbered`` made this frame; a column of that name alone is no proof."""
    return ROW in docs.columns and _MARK in docs.schema[ROW].metadata


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (default: all) of ``docs`` and their number, written once, so that all
    scans see the same. A frame that has the number already is returned as it is. A column
    of the input that has the number's name steps aside until ``unnumbered``."""
    if is_numbered(docs):
        return docs
    kept = [F.col(c).alias(_OTHER) if c.lower() == ROW else F.col(c)
            for c in columns or docs.columns]
    return write_stage(docs.select(row_number().alias(ROW, metadata={_MARK: True}), *kept),
                       "numbered", compression="zstd")


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of the input of ``numbered``, by their own names."""
    return [F.col(_OTHER).alias(ROW) if c == _OTHER else F.col(c)
            for c in docs.columns if c != ROW]


def unnumbered(docs: DataFrame) -> DataFrame:
    return docs.select(*columns_of(docs))


def row_of(docs: DataFrame) -> Column:
    """The stored number if there is one; else one that holds for a single scan."""
    return F.col(ROW) if is_numbered(docs) else row_number()


def write_stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    path = new_path(df.sparkSession, f"llm/{name}")
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_tasks_of(df: DataFrame, total_bytes: int, task_bytes: int) -> DataFrame:
    """``df`` in about ``total_bytes / task_bytes`` tasks.

    Fewer tasks are made by merging scan partitions, without a shuffle; more by
    dealing rows out evenly, whatever their keys.
    """
    want = max(1, math.ceil(total_bytes / task_bytes))
    have = df.rdd.getNumPartitions()
    if have > want:
        return df.coalesce(want)
    return df.repartition(want) if have * 2 < want else df


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column, summed over all rows."""
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast a side whose rows were counted and are at most ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
