"""Near-duplicate groups by DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles (weights are counts). Darts are
thrown at random into the area (element, weight, rank) by hashing, so equal regions of
two texts hold the same darts; of the darts below a text's weights the earliest of
each coordinate makes its signature. Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity. Only about ``k ln k`` darts of a
text are ever made, however long it is.

Texts that agree in all coordinates of a band are compared exactly. In a bucket all
members are compared with the first and the last one. Texts that still share buckets
with another group are banded again, with wider bands, and there members of different
groups are compared, unless counting what each shares with any other text, in all and
in each part of the space of hashes, rules them out. So a group of thousands costs no more than its members, and texts that only share
a passage hardly meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import (
    LOWER, ROW, UPPER, numbered, row_of, ship_code, unnumbered, write_stage)

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
# The second round, for texts whose buckets hold several groups: wider bands, drawn
# from other darts, let far fewer texts meet that only share a passage.
WIDE_BANDS, WIDE_ROWS, WIDE_COORDINATES, SALT = 150, 12, 320, 0x5851F42D4C957F2D
PARTS = 64                    # parts of the space of units, which are counted apart
EDGES_OF_A_TASK = 1 << 18      # 4 MB of them
CACHED_WORDS = 600_000
DOCS_AT_ONCE = 200
# Of UTF-8 bytes: A-Z to lower case, all that is no word character to a space.
_TO_WORDS = bytes(b if chr(b) in LOWER or 0x30 <= b <= 0x39 or b > 0x7F
                  else b + 32 if chr(b) in UPPER else 0x20 for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well-spread bits (a public-domain mixer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word hashes, worked out when they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_word_hash = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    found = (text or "").encode().translate(_TO_WORDS).split()
    if len(_word_hash) > CACHED_WORDS:
        _word_hash.clear()
    return np.fromiter(map(_word_hash.__getitem__, found), dtype=np.uint64, count=len(found))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles, each as often as it occurs. A text of
    fewer words, but not none, is one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - n + 1 + i])
    h.sort()
    return h


def units(sorted_hashes: np.ndarray) -> np.ndarray:
    """One element of weight 1 for each unit of weight: the c-th occurrence of a hash
    is an element of its own. The weighted Jaccard similarity of two texts is the
    Jaccard similarity of these sets."""
    if not len(sorted_hashes):
        return sorted_hashes
    new = np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1]]
    at = np.arange(len(new))
    count = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(sorted_hashes + count * np.uint64(0xD6E8FEB86659FD93))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(sets: list[np.ndarray], k: int, salt: int = 0) -> np.ndarray:
    """A row of ``k`` 64-bit values for each non-empty set of unit elements.

    Along the rank axis the darts in the region of an element are a Poisson process
    of rate 1, made by summing exponential gaps. Darts up to a rank that gives each
    text about ``k ln k + 2k`` of them are thrown; where a coordinate is still empty,
    later ranks are searched, so every coordinate holds its earliest dart.
    """
    out = np.zeros((len(sets), k), dtype=np.uint64)
    darts = k * np.log(k) + 2 * k
    todo = [(i, s ^ np.uint64(salt), darts / len(s)) for i, s in enumerate(sets)]
    with np.errstate(over="ignore"):
        while todo:
            owner = np.repeat([t[0] for t in todo], [len(t[1]) for t in todo])
            upto = np.repeat([t[2] for t in todo], [len(t[1]) for t in todo])
            element = np.concatenate([t[1] for t in todo])
            rank, turn = np.zeros(len(element)), 0
            owners, ranks, names = [], [], []
            while len(element):
                dart = mixed(element + np.uint64(((turn + 1) * 0x9E3779B97F4A7C15)
                                                 & 0xFFFFFFFFFFFFFFFF))
                rank = rank - np.log(uniform(dart))
                hit = rank <= upto
                element, owner, rank, upto = element[hit], owner[hit], rank[hit], upto[hit]
                owners.append(owner)
                ranks.append(rank)
                names.append(mixed(dart[hit] ^ np.uint64(0xA0761D6478BD642F)))
                turn += 1
            owner, rank, name = map(np.concatenate, (owners, ranks, names))
            slot = owner * k + (name % np.uint64(k)).astype(np.int64)
            earliest = np.full(len(sets) * k, np.inf)
            np.minimum.at(earliest, slot, rank)
            first = np.flatnonzero(rank == earliest[slot])[::-1]     # of equal ones the first
            out.reshape(-1)[slot[first]] = name[first]
            full = (earliest < np.inf).reshape(len(sets), k).all(axis=1)
            todo = [(i, s, 2 * r) for i, s, r in todo if not full[i]]
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of hashes."""
    if not len(a) and not len(b):
        return 1.0
    ua, ub = units(a), units(b)
    both = len(np.intersect1d(ua, ub, assume_unique=True))
    return both / (len(ua) + len(ub) - both)


def band_keys(signed: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; ``chosen`` has the coordinates of a band in a row."""
    with np.errstate(over="ignore"):
        key = np.full((len(signed), len(chosen)), 7, dtype=np.uint64)
        for j in range(chosen.shape[1]):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, chosen[:, j]])
    return key.view(np.int64)


def bands_of(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, sets (128-bit digest of the shingle multiset, 16 bytes) and keys
    (a 64-bit value for each band; none for a text without words)."""
    k = bands * rows
    chosen = np.arange(k).reshape(rows, bands).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                hashed = [shingles(t) for t in part.column("text").to_pylist()]
                some = [i for i, h in enumerate(hashed) if len(h)]
                keys: list = [None] * len(hashed)
                if some:
                    signed = signatures([units(hashed[i]) for i in some], k)
                    for i, v in zip(some, band_keys(signed, chosen), strict=True):
                        keys[i] = v
                digest = [xxhash.xxh3_128_digest(h.tobytes()) for h in hashed]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(digest, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "sets", "keys"])

    ship_code(docs.sparkSession)
    return docs.select(row_of(docs).alias("row"), "doc_id", "text").mapInArrow(
        run, T.StructType([T.StructField("row", T.LongType(), False), docs.schema["doc_id"],
                           T.StructField("sets", T.BinaryType()),
                           T.StructField("keys", T.ArrayType(T.LongType()))]))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of rows those whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for batch in batches:
            good = []
            for a, first, second in zip(batch.column("a").to_pylist(), batch.column("first"),
                                        batch.column("second"), strict=True):
                if kept[0] != a:                      # a group comes in a row
                    kept = (a, np.frombuffer(first.as_buffer(), np.uint64))
                other = np.frombuffer(second.as_buffer(), np.uint64)
                good.append(similarity(kept[1], other) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = (pairs.join(texts.select(F.col("row").alias("b"), F.col("hashes").alias("second")), "b")
              .join(texts.select(F.col("row").alias("a"), F.col("hashes").alias("first")), "a"))
    return joined.select("a", "b", "first", "second").mapInArrow(run, "a long, b long")


def hashes_of(docs: DataFrame) -> DataFrame:
    """row and hashes: the sorted shingle hashes, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(
                        [shingles(t).tobytes() for t in part.column("text").to_pylist()],
                        pa.binary())], names=["row", "hashes"])

    ship_code(docs.sparkSession)
    return docs.mapInArrow(run, "row long, hashes binary")


def wide_bands_of(hashes: DataFrame) -> DataFrame:
    """text, keys of the second round, unit elements and how many of them are in each part,
    from stored shingle hashes."""
    pick = np.random.default_rng(12)
    chosen = np.array([pick.choice(WIDE_COORDINATES, WIDE_ROWS, replace=False)
                       for _ in range(WIDE_BANDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                sets = [units(np.frombuffer(h.as_buffer(), np.uint64))
                        for h in part.column("hashes")]
                keys = band_keys(signatures(sets, WIDE_COORDINATES, SALT), chosen)
                parts = [np.bincount((x % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)
                         for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(list(keys), pa.list_(pa.int64())),
                     pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                     pa.array(parts, pa.list_(pa.int32()))],
                    names=["text", "keys", "units", "parts"])

    return hashes.where("length(hashes) > 0").select("row", "hashes").mapInArrow(
        run, "text long, keys array<long>, units array<long>, parts array<int>")


def with_bounds(texts: DataFrame) -> DataFrame:
    """``texts`` with size, shared and parts: how many units a text has, and how many of them
    any other of these texts has too, in all and in each part. No other text can share more."""
    part = F.pmod("unit", F.lit(PARTS))
    alone = (texts.select("text", F.explode("units").alias("unit"))
             .groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
             .where("n = 1").groupBy("text").agg(
                 F.count(F.lit(1)).alias("alone"),
                 F.array(*[F.count_if(part == p).cast("int") for p in range(PARTS)])
                 .alias("alone_parts")))
    size = F.size("units")
    return texts.join(alone, "text", "left").select(
        "text", "keys", size.alias("size"),
        (size - F.coalesce("alone", F.lit(0))).alias("shared"),
        F.coalesce(F.zip_with("parts", "alone_parts", lambda a, b: a - b), "parts").alias("parts"))


def buckets(texts: DataFrame, name: str, *more: str) -> DataFrame:
    """band, key and text of every bucket with two members or more, and its first and
    last member."""
    entries = texts.select("text", *more, F.posexplode("keys").alias("band", "key"))
    hubs = write_stage(entries.groupBy("band", "key").agg(
        F.min("text").alias("first"), F.max("text").alias("last")).where("first < last"),
        f"{name}-hubs")
    return write_stage(entries.join(hubs, ["band", "key"]), name)


def stars(members: DataFrame, *hubs: str) -> DataFrame:
    """Pairs (a, b) of the members of each bucket with its first or last one, or both."""
    return (members.select("text", F.explode(F.array(*hubs)).alias("hub"))
            .where("text <> hub")
            .select(F.least("text", "hub").alias("a"), F.greatest("text", "hub").alias("b"))
            .distinct())


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts are not yet in one group."""
    root = lambda c: groups.select(F.col("row").alias(c), F.col("root").alias(f"root_{c}"))
    return (pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
            .where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"))


def labelled(members: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    rest = [c for c in members.columns if c not in ("first", "last")]
    return write_stage(
        members.select(*rest).join(groups.withColumnRenamed("row", "text"), "text", "left")
        .select(*rest, F.coalesce("root", "text").alias("root")), name)


def enough(common: Column, sizes: Column, threshold: float) -> Column:
    """Whether texts of these sizes in sum can be similar with so many common units: c of
    them make c / (x + y - c)."""
    return common * (1 + threshold) >= F.lit(threshold - 1e-9) * sizes


def possible(pairs: DataFrame, bounds: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose bounds allow them to be similar."""
    side = lambda x: bounds.select(
        F.col("text").alias(x), F.col("size").alias(f"{x}_size"),
        F.col("shared").alias(f"{x}_shared"))
    return (pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
            .join(side("x"), "x").join(side("y"), "y")
            .where(enough(F.least("x_shared", "y_shared"), F.col("x_size") + F.col("y_size"),
                          threshold))
            .select(F.col("x").alias("a"), F.col("y").alias("b")))


def in_parts(first: str, second: str) -> Column:
    """The most units that texts with these counts in each part have in common."""
    both = F.zip_with(first, second, lambda a, b: F.least(a, b))
    return F.aggregate(both, F.lit(0), lambda total, n: total + n)


def across_groups(label: DataFrame, bounds: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members of a bucket that are in different groups and have enough
    shared units to be similar, in all and part by part."""
    several = (label.groupBy("band", "key")
               .agg(F.min("root").alias("low"), F.max("root").alias("high"))
               .where("low < high").select("band", "key"))
    label = write_stage(label.join(several, ["band", "key"], "left_semi").join(
        bounds.select("text", "parts"), "text"), "open-labels")
    roots = label.groupBy("band", "key", "root").agg(
        F.min("size").alias("least"), F.max("shared").alias("most"),
        F.array(*[F.max(F.get("parts", F.lit(p))) for p in range(PARTS)]).alias("parts"))
    side = lambda root, x: label.select(
        "band", "key", F.col("root").alias(root), F.col("text").alias(x),
        F.col("size").alias(f"{x}_size"), F.col("shared").alias(f"{x}_shared"),
        F.col("parts").alias(f"{x}_parts"))
    high = roots.withColumnsRenamed(
        {"root": "high", "least": "least_y", "most": "most_y", "parts": "parts_y"})
    sizes = F.col("least") + F.col("least_y")
    both = (roots.withColumnRenamed("root", "low").join(high, ["band", "key"])
            .where(F.col("low") < F.col("high"))
            .where(enough(F.least("most", "most_y"), sizes, threshold)
                   & enough(in_parts("parts", "parts_y"), sizes, threshold)).drop("parts"))
    sizes = F.col("x_size") + F.col("least_y")
    some = (both.join(side("low", "x"), ["band", "key", "low"])
            .where(enough(F.least("x_shared", "most_y"), sizes, threshold)
                   & enough(in_parts("x_parts", "parts_y"), sizes, threshold)).drop("parts_y"))
    sizes = F.col("x_size") + F.col("y_size")
    return (some.join(side("high", "y"), ["band", "key", "high"])
            .where(enough(F.least("x_shared", "y_shared"), sizes, threshold)
                   & enough(in_parts("x_parts", "y_parts"), sizes, threshold))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """row and root: the smallest row of each row's connected component, for rows with
    edges (a, b), which must be stored. Large-star and small-star steps, until nothing
    changes. Every step is stored, so a node with very many edges meets plain joins that
    Spark can split, and only counts reach the driver. Steps never add edges; few of them
    stay in one task, where dealing them out for each join would take most of the time."""
    few = edges.count() <= EDGES_OF_A_TASK
    dealt = lambda df: df.coalesce(1) if few else df
    edges = dealt(write_stage(dealt(edges).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b").distinct(), "edges"))
    while True:
        both = edges.select(F.inline(F.array(
            F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = dealt(write_stage(both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")), "lowest"))
        # large star: larger neighbours of a node go to the smallest of its neighbours
        large = (both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b")
                 .where("a < b").distinct())
        large = dealt(write_stage(large, "large-star"))
        # small star: smaller neighbours and the node itself go to the smallest
        low = dealt(write_stage(large.groupBy("b").agg(F.min("a").alias("m")), "lowest"))
        small = (large.join(low, "b")
                 .select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
                 .where("a < b").distinct())
        small = dealt(write_stage(small, "small-star"))
        changed = (small.join(edges, ["a", "b"], "left_anti").limit(1).count()
                   + edges.join(small, ["a", "b"], "left_anti").limit(1).count())
        edges = small
        if not changed:
            return edges.select(F.col("b").alias("row"), F.col("a").alias("root"))


def grown(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``groups`` once more ``links`` are known; both are stored. A group's
    rows and root stand for all links it was made of."""
    if not links.limit(1).count():
        return groups
    return components(links.unionByName(groups.select(
        F.col("root").alias("a"), F.col("row").alias("b"))))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id (doc_id of the row that stays,
    the same in all rows of a group), group_size and kept.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles
    is at least ``threshold``; groups are connected by links. Rows with the same
    shingles are one text. Texts without words (null and empty ones too) are equal to
    each other; a text of fewer than five words is one shingle. The row with the
    largest doc_id stays, and of rows that repeat it the first; a null id counts as
    smaller than any other. Other columns are not read. An empty table gives no rows.
    """
    docs = numbered(docs, "doc_id", "text")
    signed = write_stage(bands_of(docs, bands, rows), "signatures")
    # rows with the same shingles: the first stands for all
    same = write_stage(signed.groupBy("sets").agg(
        F.min("row").alias("text"), F.count(F.lit(1)).alias("n")).where("n > 1"), "same")
    signed = write_stage(signed.join(same, "sets", "left").select(
        "row", "doc_id", F.coalesce("text", "row").alias("text"), "keys"), "texts")
    members = buckets(signed.where("row = text").select("text", "keys"), "members")
    in_bucket = members.select(F.col("text").alias("row")).distinct()
    hashes = write_stage(hashes_of(
        docs.select(row_of(docs).alias("row"), "text").join(in_bucket, "row")), "hashes")
    star = write_stage(stars(members, "first"), "stars")
    groups = components(write_stage(verified(star, hashes, threshold), "links"))
    # the last members only matter where the first ones have not joined the texts
    ends = write_stage(apart(stars(members, "last"), groups).join(star, ["a", "b"], "left_anti"),
                       "end-stars")
    groups = grown(groups, write_stage(verified(ends, hashes, threshold), "end-links"))
    star = star.unionByName(ends)

    # what the stars leave open: texts that share a bucket with another group
    label = labelled(members, groups, "labels")
    several = (label.groupBy("band", "key")
               .agg(F.min("root").alias("low"), F.max("root").alias("high"))
               .where("low < high").select("band", "key"))
    open_texts = (label.join(several, ["band", "key"]).select(F.col("text").alias("row"))
                  .distinct())
    wide = write_stage(wide_bands_of(hashes.join(open_texts, "row")), "wide-bands")
    wide = with_bounds(wide).where(F.col("shared") >= F.lit(threshold - 1e-9) * F.col("size"))
    wide = write_stage(wide, "wide-texts")
    members = buckets(wide, "wide-members", "size", "shared")
    more = write_stage(apart(
        possible(stars(members, "first", "last"), wide, threshold)
        .join(star, ["a", "b"], "left_anti"), groups), "more-stars")
    groups = grown(groups, write_stage(verified(more, hashes, threshold), "more-links"))
    rest = (across_groups(labelled(members, groups, "wide-labels"), wide, threshold)
            .join(star.unionByName(more), ["a", "b"], "left_anti"))
    groups = grown(groups, write_stage(verified(rest, hashes, threshold), "last-links"))

    told = write_stage(
        signed.join(groups.withColumnRenamed("row", "text"), "text", "left")
        .select("row", "doc_id", F.coalesce("root", "text").alias("group")), "groups")
    stays = write_stage(told.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("doc_id", (-F.col("row")).alias("before"))).alias("best"))
        .where("n > 1"), "stays")
    alone = F.col("n").isNull()
    return told.join(stays, "group", "left").select(
        "row", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == -F.col("best.before"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    docs = numbered(docs)
    gone = near_duplicates(docs, **options).where("NOT kept").select(
        F.col("row").alias(ROW))
    return unnumbered(docs.join(gone, ROW, "left_anti"))
