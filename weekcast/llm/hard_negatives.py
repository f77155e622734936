"""Hard negatives from vectors, by an inverted multi-index.

The components are cut into two halves with a codebook each; a row's cell is its pair of
nearest codewords. For an anchor, half a cell's score is at most the codeword's inner
product with that half of the anchor, plus the codeword's radius times the half's length.
A heap walks the cells by the sum of both bounds, highest first (multi-sequence order).
The first cells give scores to beat; then the walk goes on until the bound is below all
of them, which certifies that no row beyond can change the result.

Cells are stored as blocks of bounded size; a request is a block and the anchors that
visit it, so work is dealt by block and a cell with a third of all rows is many blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import row_number, ship_code, write_stage

SAMPLE = 8192                # rows that the codebooks are fitted on at most
BLOCK_ROWS = 8192
CODEWORDS = 64               # of a half at most
ANCHORS_AT_ONCE = 512
ROUNDS = 10                  # of k-means
LEAST, MOST = -(1 << 62), 1 << 62
FOUND = "row long, id long, slot int, other_row long, other long, score long"


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    codebooks: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    first_block: np.ndarray      # of each cell
    block_count: np.ndarray
    cell_rows: np.ndarray
    width: int                   # components
    exact_floats: bool           # scores are whole numbers below 2^53

    @property
    def cut(self) -> int:
        return self.width // 2


# --------------------------------------------------------------------------
# Rows and index
# --------------------------------------------------------------------------

def whole_numbers(rows: DataFrame, vector: str, scale: int, columns: dict[str, Column]) -> DataFrame:
    """``columns`` and ``vec`` = floor(scale * component), of the rows whose vector has only
    finite components; written once with a row number."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    picked = rows.where(x.isNotNull() & finite).select(
        row_number().alias("row"), *[c.alias(n) for n, c in columns.items()],
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("vec"))
    return write_stage(picked, "vectors", compression="zstd")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List values as rows; missing components of shorter ones are 0."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def codebook(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k-means centres of a bounded sample."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].astype(float)
    for _ in range(ROUNDS):
        nearest = _nearest(sample, centres)
        for c in range(len(centres)):
            mine = sample[nearest == c]
            if len(mine):
                centres[c] = mine.mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2.0 * (x.astype(float) @ centres.T), axis=1)


def build_index(numbers: DataFrame, block_rows: int = BLOCK_ROWS) -> Index | None:
    """The index of all rows of ``whole_numbers`` (row, id, label, vec); None if there are none.

    The codebooks come from ``SAMPLE`` rows in the order of a hash; every row is assigned,
    and radii and cell sizes are of all rows. The driver sees the sample, a radius for each
    codeword and a count for each cell.
    """
    stats = numbers.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"),
        F.max(F.greatest(F.array_max("vec"), -F.array_min("vec"))).alias("most")).first()
    if not stats["n"]:
        return None
    width, most = max(stats["width"], 2), max(stats["most"] or 0, 1)
    if most * most * width >= 1 << 62:
        raise ValueError("scores do not fit in 64 bits")
    cut = width // 2
    sample = np.zeros((min(SAMPLE, stats["n"]), width), dtype=np.int64)
    for i, r in enumerate(numbers.orderBy(F.xxhash64("row"), "row").limit(SAMPLE)
                          .select("vec").collect()):
        sample[i, :len(r.vec)] = r.vec
    k = int(np.clip(round((stats["n"] / block_rows) ** 0.5), 1, CODEWORDS))
    books = codebook(sample[:, :cut], k), codebook(sample[:, cut:], k)
    codes = len(books[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), width)
            halves = x[:, :cut], x[:, cut:]
            near = [_nearest(h, b) for h, b in zip(halves, books, strict=True)]
            far = [np.sqrt(((h - b[i]) ** 2).sum(axis=1))
                   for h, b, i in zip(halves, books, near, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(near[0] * codes + near[1]), *map(pa.array, far)],
                names=["row", "cell", "r1", "r2"])

    ship_code(numbers.sparkSession)
    cells = (numbers.select("row", "vec").mapInArrow(
        assign, "row long, cell long, r1 double, r2 double")
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"),
                             F.max("r2").alias("r2")).collect())       # codes * codes at most
    radii = np.zeros((2, codes))
    cell_rows = np.zeros(codes * codes, dtype=np.int64)
    for r in cells:
        cell_rows[r.cell] = r.n
        radii[0, r.cell // codes] = max(radii[0, r.cell // codes], r.r1)
        radii[1, r.cell % codes] = max(radii[1, r.cell % codes], r.r2)
    block_count = -(-cell_rows // block_rows)
    first_block = np.concatenate([[0], np.cumsum(block_count)[:-1]])
    dtype = "<i4" if most < 1 << 31 else "<i8"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), width)
            cell = _nearest(x[:, :cut], books[0]) * codes + _nearest(x[:, cut:], books[1])
            spread = batch.column("spread").to_numpy() % np.maximum(block_count[cell], 1)
            packed = pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(first_block[cell] + spread), batch.column("row"), batch.column("id"),
                 batch.column("label"), packed], names=["block", "row", "id", "label", "vec"])

    def pack(table: pa.Table) -> pa.Table:
        """The rows of a block by id, as one row of byte strings."""
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])
        raw = lambda n: table.column(n).to_numpy().astype("<i8").tobytes()
        return pa.table({"block": table.column("block")[:1], "rows": [raw("row")],
                         "ids": [raw("id")], "labels": [raw("label")],
                         "vecs": [b"".join(table.column("vec").to_pylist())]})

    dealt = numbers.select(
        "row", "id", "label", "vec",
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)).alias("spread")).mapInArrow(
        deal, "block long, row long, id long, label long, vec binary")
    blocks = write_stage(dealt.groupBy("block").applyInArrow(
        pack, "block long, rows binary, ids binary, labels binary, vecs binary"), "vector-blocks")
    return Index(blocks, books, (radii[0], radii[1]), first_block, block_count, cell_rows, width,
                 most * most * width < 1 << 53)


# --------------------------------------------------------------------------
# Search
# --------------------------------------------------------------------------

def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Pairs (i, j, first[i] + second[j]) by their sum, highest first."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        value, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j]), -value
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def visits(anchor: np.ndarray, index: Index, lowest: int, beginning: bool,
           first_rows: int) -> Iterator[int]:
    """The cells that an anchor visits: those of the beginning (until they hold
    ``first_rows`` rows), or those after it whose bound reaches ``lowest``."""
    halves = anchor[:index.cut].astype(float), anchor[index.cut:].astype(float)
    bounds = [b @ h + np.sqrt(h @ h) * r
              for h, b, r in zip(halves, index.codebooks, index.radii, strict=True)]
    codes, seen = len(index.codebooks[0]), 0
    for i, j, bound in multi_sequence(*bounds):
        if bound + 1 + 1e-9 * abs(bound) < lowest:          # room for rounding
            return
        n = int(index.cell_rows[i * codes + j])
        if n and beginning == (seen < first_rows):
            yield i * codes + j
        seen += n
        if beginning and seen >= first_rows:
            return


def _requests(anchors: DataFrame, index: Index, beginning: bool, first_rows: int) -> DataFrame:
    plan = Index(None, index.codebooks, index.radii, index.first_block, index.block_count,
                 index.cell_rows, index.width, index.exact_floats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ANCHORS_AT_ONCE):
                batch = whole.slice(at, ANCHORS_AT_ONCE)
                x = _matrix(batch.column("vec"), plan.width)
                lo, hi = batch.column("lo").to_pylist(), batch.column("hi").to_pylist()
                wanted: dict[int, list[int]] = {}
                for a in range(batch.num_rows):
                    open_slots = [p for p, q in zip(lo[a], hi[a], strict=True) if p <= q]
                    if open_slots:
                        for cell in visits(x[a], plan, min(open_slots), beginning, first_rows):
                            wanted.setdefault(cell, []).append(a)
                for cell, who in wanted.items():
                    some = batch.take(pa.array(who))
                    vecs = x[who].astype("<i8").tobytes()
                    for block in range(plan.block_count[cell]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(plan.first_block[cell]) + block]),
                             pa.array([vecs], pa.binary()),
                             *[pa.array([some.column(n).to_pylist()])
                               for n in ("row", "id", "label", "lo", "hi")]],
                            schema=out)

    longs = pa.list_(pa.int64())
    out = pa.schema([("block", pa.int64()), ("a_vecs", pa.binary()), ("a_row", longs),
                     ("a_id", longs), ("a_label", longs), ("lo", pa.list_(longs)),
                     ("hi", pa.list_(longs))])
    return anchors.select("row", "id", "label", "vec", "lo", "hi").mapInArrow(
        run, "block long, a_vecs binary, a_row array<long>, a_id array<long>, "
             "a_label array<long>, lo array<array<long>>, hi array<array<long>>")


def _scored(requests: DataFrame, index: Index, same_label: bool, k: int) -> DataFrame:
    """The first ``k`` rows of each block for each anchor and slot."""
    width, exact = index.width, index.exact_floats
    names = [part.split()[0] for part in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, ids, labels = (np.frombuffer(r[n], "<i8") for n in ("rows", "ids", "labels"))
                size = len(r["vecs"]) // max(1, len(rows) * width)
                b = np.frombuffer(r["vecs"], f"<i{size}").reshape(len(rows), width)
                a = np.frombuffer(r["a_vecs"], "<i8").reshape(-1, width)
                if exact:
                    scores = (a.astype(float) @ b.astype(float).T).astype(np.int64)
                else:
                    scores = a @ b.astype(np.int64).T
                found = []
                for i, (me, my_id, label) in enumerate(zip(r["a_row"], r["a_id"], r["a_label"],
                                                           strict=True)):
                    slots = [(s, lo, hi) for s, (lo, hi) in enumerate(
                        zip(r["lo"][i], r["hi"][i], strict=True)) if lo <= hi]
                    mine = scores[i]
                    fit = (labels == label) & (rows != me) if same_label else labels != label
                    near = np.flatnonzero(fit & (mine >= min(lo for _, lo, _ in slots))
                                          & (mine <= max(hi for *_, hi in slots)))
                    near = near[np.argsort(-mine[near], kind="stable")]    # ties: by id
                    value = mine[near]
                    for s, lo, hi in slots:
                        at = int(np.searchsorted(-value, -hi))
                        for j in near[at:at + k][value[at:at + k] >= lo]:
                            found.append((me, my_id, s, int(rows[j]), int(ids[j]), int(mine[j])))
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if n == "slot" else pa.int64())
                     for n, c in zip(names, columns, strict=True)], names=names)

    return requests.join(index.blocks, "block").mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "other", "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best(anchors: DataFrame, index: Index, k: int, same_label: bool,
         first_rows: int = 2 * BLOCK_ROWS) -> DataFrame:
    """For each anchor (row, id, label, vec) and each of its slots, the first ``k`` rows with
    lo[slot] <= score <= hi[slot], by score downwards, then id: exact."""
    ask = lambda rows, beginning: _scored(
        _requests(rows, index, beginning, first_rows), index, same_label, k)
    early = write_stage(_first(ask(anchors, True), k), "vector-early")
    beat = early.where(F.col("rank") == k).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("beat"))   # a slot each
    raised = anchors.join(beat, "row", "left").withColumn("lo", F.transform(
        "lo", lambda lo, slot: F.greatest(lo, F.coalesce(F.try_element_at("beat", slot), lo))))
    return _first(early.drop("rank").unionByName(ask(raised, False)), k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
                   low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20),
                   scale: int = 256, block_rows: int = BLOCK_ROWS,
                   first_rows: int = 2 * BLOCK_ROWS) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of its own label, the first
    ``negatives`` rows of another label whose score is between ``low`` and ``high`` times the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; ``anchor`` says which rows are anchors. Scores are
    inner products of floor(``scale`` * component), whole numbers; more comes first, ties by
    smaller vec_id. Results are exact.

    Rows with a null id, label or vector, or a component that is null or not finite, take no
    part. Shorter vectors are read as if they ended in zeros. Repeated rows are rows: a copy of
    an anchor is one of its positives. Other columns are not read. An empty table gives no rows;
    a positive without such negatives gives none either. Scores of 2^62 or more raise an error.
    """
    numbers = whole_numbers(
        rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()), "embedding", scale,
        {"id": F.col("vec_id").cast("long"), "label": F.col("label").cast("long"),
         "anchor": F.coalesce(anchor, F.lit(False))})
    index = build_index(numbers, block_rows)
    out = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
           "negative_score long")
    if index is None:
        return rows.sparkSession.createDataFrame([], out)
    anchors = numbers.where("anchor").select("row", "id", "label", "vec")
    longs = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    near = write_stage(best(anchors.withColumns({"lo": longs(LEAST), "hi": longs(MOST)}), index,
                            positives, True, first_rows), "vector-positives")
    scores = near.groupBy("row").agg(F.transform(              # ``positives`` of them at most
        F.sort_array(F.collect_list(F.struct("rank", "score"))),
        lambda p: p["score"]).alias("scores"))
    windows = anchors.join(scores, "row").withColumns({
        "lo": F.transform("scores", lambda p: -_floor(-p * low[0], low[1])),
        "hi": F.transform("scores", lambda p: _floor(p * high[0], high[1]))})
    far = best(windows, index, negatives, False, first_rows)
    return far.join(near.select("row", (F.col("rank") - 1).alias("slot"),
                                F.col("other").alias("positive_id"),
                                F.col("score").alias("positive_score")), ["row", "slot"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def _floor(x: Column, by: int) -> Column:
    """floor(x / by) of whole numbers."""
    by = F.lit(by).cast("long")
    return F.call_function("div", x - F.pmod(x, by), by)
