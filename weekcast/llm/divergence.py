"""Divergence between the sources of each language, term by term.

Every (language, source) group has smoothed, scaled shares of the language's kept terms.
A pair of groups is one task: their sorted (term id, count) arrays are co-grouped and
merged by a galloping intersection, which prices terms that both hold, terms of one side
and, at once, all terms that neither holds. The price is a difference of shares without
its sign, so it counts both ways.

Kept terms are dealt to segments of bounded size by a hash, and a pair is merged segment
by segment, so no array grows with the vocabulary or with a source.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import ship_code, write_stage

SCALE = 1_000_000_000
SMOOTH = 5
SEGMENT_TERMS = 4096                  # terms of one language in a segment, on average
COUNTERS = 400_000                    # (group, term) counters that a task holds at most
# Terms are runs of letters: A-Z is lowered, other ASCII separates, the rest stays.
_TERM_BYTES = bytes.maketrans(
    bytes(range(128)), bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32
                             for b in range(128)))


# --------------------------------------------------------------------------
# Counts
# --------------------------------------------------------------------------

def _flush(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (times, docs) in held.items():
        n = len(times)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n), pa.array([source] * n),
                 pa.array([t.decode() for t in times]), pa.array(times.values(), pa.int64()),
                 pa.array(map(docs.__getitem__, times), pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
    held.clear()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs with it), partly summed: a task sums what
    it reads until it holds ``COUNTERS`` counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        room = COUNTERS
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = text.encode().translate(_TERM_BYTES).split()
                if not terms:
                    continue
                times, docs_with = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(times)
                times.update(terms)
                docs_with.update(set(terms))
                room -= len(times) - before
                if room <= 0:
                    yield from _flush(held)
                    room = COUNTERS
        yield from _flush(held)

    ship_code(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


# --------------------------------------------------------------------------
# Shares and their differences
# --------------------------------------------------------------------------

def _share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / whole), exact: long division, three digits of SCALE
    at a time, so that nothing leaves 64 bits for ``whole`` below 9e15."""
    quotient, rest = F.lit(0).cast("long"), n + SMOOTH
    step = F.lit(1000).cast("long")
    for _ in range(3):
        rest = rest * step
        quotient = quotient * step + F.call_function("div", rest, whole)
        rest = rest % whole
    return quotient + 1


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """``_share`` of arrays."""
    rest, quotient = counts.astype(np.int64) + SMOOTH, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // whole
        rest = rest % whole
    return quotient + 1


def gallop(small: np.ndarray, large: np.ndarray, run: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that both sorted arrays hold, in each of them.

    Runs of the smaller array are looked up one after another. From where the last run
    ended, the step in the larger one doubles until it is past the run; only that stretch
    is searched.
    """
    mine, theirs, at = [], [], 0
    for lo in range(0, len(small), run):
        part = small[lo:lo + run]
        step = len(part)
        while at + step < len(large) and large[at + step] < part[-1]:
            step *= 2
        stretch = large[at:at + step + 1]
        if not len(stretch):
            break
        found = np.searchsorted(stretch, part)
        hit = found < len(stretch)
        hit[hit] = stretch[found[hit]] == part[hit]
        mine.append(lo + np.flatnonzero(hit))
        theirs.append(at + found[hit])
        at += int(found[-1])
    none = np.zeros(0, np.int64)
    return (np.concatenate(mine), np.concatenate(theirs)) if mine else (none, none)


def price(ids_a: np.ndarray, counts_a: np.ndarray, whole_a: int, ids_b: np.ndarray,
          counts_b: np.ndarray, whole_b: int, terms: int) -> int:
    """Sum over ``terms`` terms of the difference of two groups' shares, without sign."""
    if not terms:
        return 0
    if len(ids_a) > len(ids_b):
        ids_a, counts_a, whole_a, ids_b, counts_b, whole_b = (
            ids_b, counts_b, whole_b, ids_a, counts_a, whole_a)
    zero = np.zeros(1, np.int64)
    none_a, none_b = int(shares(zero, whole_a)[0]), int(shares(zero, whole_b)[0])
    in_a, in_b = gallop(ids_a, ids_b)
    p_a, p_b = shares(counts_a, whole_a), shares(counts_b, whole_b)
    only_a, only_b = np.delete(p_a, in_a), np.delete(p_b, in_b)
    absent = terms - len(ids_a) - len(only_b)
    return (int(np.abs(p_a[in_a] - p_b[in_b]).sum())          # both hold it
            + int(np.abs(only_a - none_b).sum())              # one side
            + int(np.abs(only_b - none_a).sum())
            + absent * abs(none_a - none_b))                  # neither


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Price the pairs of a batch; the ids and counts of a side are list columns."""
    def arrays(batch: pa.RecordBatch, name: str):
        column = batch.column(name)
        return column.offsets.to_numpy(), column.values.to_numpy()

    for batch in batches:
        (at_a, ids_a), (_, n_a) = arrays(batch, "ids_a"), arrays(batch, "n_a")
        (at_b, ids_b), (_, n_b) = arrays(batch, "ids_b"), arrays(batch, "n_b")
        whole_a, whole_b = batch.column("whole_a").to_pylist(), batch.column("whole_b").to_pylist()
        terms = batch.column("terms").to_pylist()
        values = []
        for i in range(batch.num_rows):
            a, b = slice(at_a[i], at_a[i + 1]), slice(at_b[i], at_b[i + 1])
            values.append(price(ids_a[a], n_a[a], whole_a[i], ids_b[b], n_b[b], whole_b[i],
                                terms[i]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("source_a"), batch.column("source_b"),
             pa.array(values, pa.int64())], names=["lang", "source_a", "source_b", "value"])


def _segment(segments: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(segments)).cast("int")


def divergence(docs: DataFrame, least_docs: int = 30, top_terms: int = 50,
               segment_terms: int = SEGMENT_TERMS) -> DataFrame:
    """One row per pair of sources of a language, both ways, and per leading term of a
    source: lang, source, part ('pair' or 'term'), item, value, rank.

    A language keeps the terms that at least ``least_docs`` of its rows hold. Of a group
    with N occurrences of the V kept terms, a term with n of them has the share
    1 + floor(1e9 * (n + 5) / (N + 5 V)). A pair's value is the sum of the differences of
    shares over all kept terms; a term's is by how much its share in the source is above
    that in the whole language, for terms that occur in the source. Ranks are by value
    downwards, then item by its bytes; terms only to rank ``top_terms``.

    Null text, lang or source is ''. A row without terms still makes its group known; a
    source that is alone in its language has no pairs. A language without kept terms has
    pairs of value 0 and no terms. Repeated rows are rows. Other columns are not read. An
    empty table gives no rows.

    Work grows with the text for the counts, and with the pairs of sources times their
    kept terms for the pairs, which is what is asked for.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")])
    counts = write_stage(
        term_counts(read).repartition("lang", "term")
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "divergence-counts", compression="zstd")

    kept = (counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"),
                                               F.sum("docs").alias("docs"))
            .where(F.col("docs") >= least_docs))
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    segments = max(1, math.ceil(most / segment_terms))
    of_segment = Window.partitionBy("lang", "segment").orderBy("term")
    vocabulary = write_stage(
        kept.withColumn("segment", _segment(segments)).select(
            "lang", "segment", "term", "n_lang",
            F.row_number().over(of_segment).alias("id")), "divergence-terms", compression="zstd")
    held = write_stage(
        counts.select("lang", "term", "source", "n").join(vocabulary, ["lang", "term"]),
        "divergence-held", compression="zstd")

    per_lang = vocabulary.groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("n_all"))
    # Few rows each: (lang, source) groups, languages, segments.
    groups = write_stage(
        read.select("lang", "source").distinct()
        .join(held.groupBy("lang", "source").agg(F.sum("n").alias("n_group")),
              ["lang", "source"], "left")
        .join(per_lang, "lang", "left")
        .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"),
                (F.coalesce("n_group", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).alias("whole"),
                (F.coalesce("n_all", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0)))
                .alias("whole_lang")), "divergence-groups")
    sizes = vocabulary.groupBy("lang", "segment").agg(F.count(F.lit(1)).alias("terms"))
    arrays = held.groupBy("lang", "segment", "source").agg(
        F.sort_array(F.collect_list(F.struct("id", "n"))).alias("held"))   # one segment's terms
    every = (groups.select("lang", "source", "whole",
                           F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
             .join(arrays, ["lang", "segment", "source"], "left")
             .select("lang", "segment", "source", "whole",
                     F.coalesce(F.col("held.id"), F.array().cast("array<int>")).alias("ids"),
                     F.coalesce(F.col("held.n"), F.array().cast("array<long>")).alias("n")))
    sides = write_stage(every, "divergence-arrays", compression="zstd")
    side = lambda s: sides.select("lang", "segment", *[
        F.col(c).alias(f"{c}_{s}") for c in ("source", "whole", "ids", "n")])
    pairs = (side("a").join(side("b"), ["lang", "segment"])
             .where("source_a < source_b")
             .join(sizes, ["lang", "segment"], "left")
             .withColumn("terms", F.coalesce("terms", F.lit(0))))
    priced = (pairs.mapInArrow(_merged, "lang string, source_a string, source_b string, value long")
              .groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")))
    pair_rows = priced.select("lang", "value", F.explode(F.array(      # both ways
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("way")
    ).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    term_rows = (held.join(groups, ["lang", "source"])
                 .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                         (_share(F.col("n"), F.col("whole"))
                          - _share(F.col("n_lang"), F.col("whole_lang"))).alias("value"))
                 .where("value > 0"))
    rank = F.row_number().over(
        Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return (pair_rows.withColumn("rank", rank)
            .unionByName(term_rows.withColumn("rank", rank).where(F.col("rank") <= top_terms)))
