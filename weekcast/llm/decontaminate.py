"""Benchmark decontamination by winnowing.

Of every run of ``span`` words the smallest k-gram hash is kept (k + w - 1 = span,
for windows of w k-grams), so two texts that share ``span`` consecutive words share a
fingerprint. Fingerprints of the documents are joined with those of the benchmark;
each hit is then extended to the windows of ``span`` words around it, which are
compared word by word. Items shorter than the span are one window of their own
length, and their fingerprint is that whole window.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import (
    ROW, broadcast_if, let, numbered, row_of, unnumbered, words, write_stage)

SPAN = 10
GRAM = 5
BROADCAST_ROWS = 2_000_000          # fingerprints or windows of the benchmark, counted


def gram_hashes(tokens: Column, k: int) -> Column:
    """The hash of each k-gram, in order; no elements if there are fewer words.
    ``tokens`` is a column or lambda variable, not an expression."""
    return F.when(F.size(tokens) >= k, F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (k - 1)),
        lambda i: F.xxhash64(F.slice(tokens, i, F.lit(k))))).otherwise(
        F.array().cast("array<bigint>"))


def winnowed(hashes: Column, window: int) -> Column:
    """The distinct minima of all windows of consecutive hashes."""
    return F.when(F.size(hashes) >= window, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(hashes) - (window - 1)),
        lambda i: F.array_min(F.slice(hashes, i, F.lit(window)))))).otherwise(
        F.array().cast("array<bigint>"))


def fingerprints(tokens: Column, span: int, gram: int) -> Column:
    """Fingerprints of a window length: winnowed k-grams, or whole short windows."""
    k = min(gram, span)
    return let(tokens, lambda t: let(gram_hashes(t, k), lambda h: winnowed(h, span - k + 1)))


def window_texts(tokens: Column, starts: Column, span: int) -> Column:
    """(start, window text) at each 0-based start."""
    return F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.array_join(F.slice(tokens, s + 1, F.lit(span)), " ").alias("window")))


def all_windows(tokens: Column, span: int) -> Column:
    return let(tokens, lambda t: window_texts(t, F.when(
        F.size(t) >= span, F.sequence(F.lit(0), F.size(t) - span)).otherwise(
        F.array().cast("array<int>")), span))


def windows_around(tokens: Column, prints: Column, span: int, gram: int) -> Column:
    """The windows that hold a k-gram whose hash is among ``prints``."""
    k = min(gram, span)

    def around(t: Column, h: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(h) - 1),
                        lambda j: F.array_contains(prints, F.get(h, j)))
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda j: F.sequence(
            F.greatest(j - (span - k), F.lit(0)), F.least(j, F.size(t) - span)))))
        return let(starts, lambda s: window_texts(t, s, span))

    return let(tokens, lambda t: let(gram_hashes(t, k), lambda h: around(t, h)))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN,
                  gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_words, n_hit, n_items, items (the
    ids, sorted as strings), contaminated.

    A document word is hit if it lies in any occurrence of an item's window. Null
    and empty texts have no words and are never hit; items without words have no
    windows. An item without an id hits words but is not listed; equal ids count
    once. Rows of ``docs`` may repeat and their ids may be null: each row is judged.
    Other columns are not read. With an empty table nothing is hit.
    """
    docs = numbered(docs, "doc_id", "text")
    item = benchmark.select(F.col("item_id").cast("string").alias("item"),
                            words(F.col("text")).alias("words")).where("size(words) > 0")
    items = write_stage(item, "items")
    lengths = sorted(r[0] for r in items.select(
        F.least(F.size("words"), F.lit(span)).alias("n")).distinct().collect())  # span at most
    base = docs.select(row_of(docs).alias("row"), "doc_id", words(F.col("text")).alias("words"))
    of_length = lambda n: items.where(F.size("words") >= span if n == span
                                      else F.size("words") == n)

    # candidates: documents that share a fingerprint, with the fingerprints they share
    found = []
    for n in lengths:
        prints = of_length(n).select(
            F.explode(fingerprints(F.col("words"), n, gram)).alias("print")).distinct()
        prints = write_stage(prints, "prints")
        side = broadcast_if(prints, prints.count(), broadcast_rows)
        found.append(base.select("row", F.explode(
            fingerprints(F.col("words"), n, gram)).alias("print"))
            .join(side, "print").select("row", F.lit(n).alias("n"), "print"))
    counted = docs.select(row_of(docs).alias("row"), "doc_id",
                          F.size(words(F.col("text"))).cast("long").alias("n_words"))
    nothing = counted.select(
        "row", "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"))
    if not found:
        return _finish(nothing)
    prints_of = write_stage(
        reduce(DataFrame.unionByName, found).groupBy("row", "n").agg(
            F.collect_list("print").alias("prints")), "candidates")

    # extend: the windows around each hit, compared in full
    places = []
    for n in lengths:
        windows = (base.join(prints_of.where(F.col("n") == n), "row")
                   .select("row", F.inline(windows_around(
                       F.col("words"), F.col("prints"), n, gram)))
                   .groupBy("row", "window").agg(F.collect_list("start").alias("starts")))
        texts = (of_length(n).select("item", F.inline(all_windows(F.col("words"), n)))
            .groupBy("window").agg(F.collect_set("item").alias("items")))
        texts = write_stage(texts, "windows")
        places.append(windows.join(broadcast_if(texts, texts.count(), broadcast_rows), "window")
                      .select("row", "items", F.transform("starts", lambda s: F.struct(
                          s.alias("start"), (s + n).alias("end"))).alias("spans")))
    hit = reduce(DataFrame.unionByName, places).groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda seen, s: F.struct(
            F.greatest(seen["end"], s["end"]).alias("end"),
            (seen["hit"] + F.greatest(s["end"] - F.greatest(seen["end"], s["start"]), F.lit(0)))
            .alias("hit")))["hit"]
    hit = write_stage(hit.select("row", covered.alias("n_hit"), "items"), "hits")
    return _finish(counted.join(hit, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def _finish(judged: DataFrame) -> DataFrame:
    return judged.select("row", "doc_id", "n_words", "n_hit",
                         F.size("items").cast("long").alias("n_items"), "items",
                         (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    docs = numbered(docs)
    hit = contamination(docs, benchmark, **options).where("contaminated").select(
        F.col("row").alias(ROW))
    return unnumbered(docs.join(hit, ROW, "left_anti"))
