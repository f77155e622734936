"""Language identification by cross-parsing entropy.

For each language, labelled text is put into a suffix automaton. A text is parsed against
it from left to right into longest matches: a phrase ends where the labelled text does
not hold it with the next letter. A phrase costs the bits of a place in the labelled
text, so phrases per letter times those bits is an estimate of the cross entropy; the
language with the least of it wins.

The automata work on UTF-8 bytes of lower-cased words with single spaces between them.
They are laid out as one table of (state, byte class) so that a step is one look-up: where
a phrase ends, the table leads to a copy of the state that the next letter starts from,
and phrases are counted as visits to those copies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import ship_code, write_stage
from weekcast.llm.learned import remainder

UNKNOWN = "und"
WINDOW = 300                 # letters that the fit takes from one text
WINDOWS = 100                # windows that the fit takes of one language at most
ROWS_AT_ONCE = 400
STEPS = 2048                 # bytes of each text that are laid side by side at once
FEW = 24                     # so few lanes are parsed faster one by one
_GAPS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> bytes:
    """Lower-cased words with single spaces around; nothing if there is no letter."""
    words = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode() if any(map(str.isalpha, words)) else b""


# --------------------------------------------------------------------------
# Suffix automaton
# --------------------------------------------------------------------------

def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for symbol in data:
        new = len(go)
        go.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at >= 0 and symbol not in go[at]:
            go[at][symbol] = new
            at = link[at]
        if at >= 0:
            after = go[at][symbol]
            if longest[after] == longest[at] + 1:
                link[new] = after
            else:
                copy = len(go)
                go.append(dict(go[after]))
                link.append(link[after])
                longest.append(longest[at] + 1)
                link[after] = link[new] = copy
                while at >= 0 and go[at].get(symbol) == after:
                    go[at][symbol] = copy
                    at = link[at]
        last = new
    return go


@dataclass(frozen=True)
class Model:
    """Labelled text by language, as sent to the executors."""

    texts: tuple[tuple[str, bytes], ...]


class Parser:
    """Counts the phrases of texts against the labelled text of every language.

    The automata share one table of (state, byte class). Texts are parsed side by side, one
    byte of each in a step; the few longest go on alone where the others have ended.
    """

    def __init__(self, model: Model):
        used = sorted(set(b"".join(t for _, t in model.texts)))
        self.width = width = len(used) + 1       # the last class: bytes that no language has
        classes = bytearray([len(used)]) * 256
        for i, symbol in enumerate(used):
            classes[symbol] = i
        self.classes = bytes(classes)
        self.names = [lang for lang, _ in model.texts]
        self.bits = np.array([math.log2(max(len(t), 2)) for _, t in model.texts])
        automata = [suffix_automaton(t) for _, t in model.texts]
        first = np.cumsum([0] + [len(go) for go in automata])
        step = np.full((first[-1] + len(automata) * width, width), -1, dtype=np.int64)
        for k, go in enumerate(automata):
            for state, ways in enumerate(go):
                for symbol, after in ways.items():
                    step[first[k] + state, classes[symbol]] = first[k] + after
            # Behind all automata: rows for a phrase that has just begun with a class. A
            # class that the labelled text lacks is a phrase of its own.
            begins = first[-1] + k * width + np.arange(width)
            known = step[first[k]] >= 0
            step[begins[known]] = step[step[first[k]][known]]
            for rows in (slice(first[k], first[k + 1]), begins):
                step[rows] = np.where(step[rows] < 0, begins, step[rows])
        self.begun = int(first[-1] * width)
        self.start = first[:-1] * width
        self.table = (step * width).astype(np.int32 if step.size < 1 << 31 else np.int64).ravel()

    def phrases(self, coded: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        languages = len(self.names)
        order = sorted(range(len(coded)), key=lambda i: -len(coded[i]))
        lengths = np.array([len(coded[i]) for i in order] + [0])
        state = np.tile(self.start, len(order)).astype(self.table.dtype)
        count = np.repeat(np.minimum(lengths[:-1], 1), languages)
        at = 0
        while True:
            alive = int(np.count_nonzero(lengths > at))
            if alive * languages < FEW:
                break
            span = min(STEPS, int(lengths[alive - 1]) - at)
            block = np.frombuffer(b"".join(coded[i][at:at + span] for i in order[:alive]), np.uint8)
            block = np.repeat(block.reshape(alive, span).T, languages, axis=1).astype(state.dtype)
            now, n = state[:alive * languages], count[:alive * languages]
            for symbols in block:
                symbols += now
                np.take(self.table, symbols, out=now, mode="clip")     # always inside
                n += now >= self.begun
            at += span
        table, begun = memoryview(self.table), self.begun
        for lane in range(alive * languages):
            here, n = int(state[lane]), 0
            for symbol in coded[order[lane // languages]][at:]:
                here = table[here + symbol]
                if here >= begun:
                    n += 1
            count[lane] += n
        out = np.empty((len(order), languages), dtype=np.int64)
        out[order] = count.reshape(-1, languages)
        return out


@lru_cache(maxsize=2)
def parser(model: Model) -> Parser:
    """Built once in each Python worker."""
    return Parser(model)


def identify(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """For each text the language of least cost and how sure that is: its share of the
    likelihood when every language has 2 to the power of minus its bits per letter."""
    letters = [normal(t) for t in texts]
    if not model.texts:
        return [(UNKNOWN, 0.0)] * len(texts)
    by = parser(model)
    costs = by.phrases([t.translate(by.classes) for t in letters]) * by.bits
    costs /= np.array([max(len(t), 1) for t in letters])[:, None]
    best = costs.argmin(axis=1)                   # names are sorted: ties go to the first
    sure = 1 / (2.0 ** (costs.min(axis=1)[:, None] - costs)).sum(axis=1)
    return [(by.names[b], float(p)) if t else (UNKNOWN, 0.0)
            for t, b, p in zip(letters, best, sure, strict=True)]


# --------------------------------------------------------------------------
# Fit and prediction
# --------------------------------------------------------------------------

def fit(docs: DataFrame, allowed: Column | None = None, windows: int = WINDOWS,
        window: int = WINDOW) -> Model:
    """Labelled text of each language: at most ``windows`` windows of ``window`` characters,
    each from another text, in the order of a hash of the texts.

    Equal texts count once, so a group of copies is one window. A text's window begins at
    a place that its hash names, so beginnings are not preferred. The choice is a window
    per language over (language, hash) pairs, cut on the map side; the driver gets
    languages x ``windows`` x ``window`` characters, whatever the input.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                          & (F.lit(True) if allowed is None else allowed))
    h = F.xxhash64("text")
    start = F.pmod(F.shiftright(h, 8), F.greatest(F.length("text") - window, F.lit(0)) + 1)
    parts = labelled.select(F.col("lang").cast("string").alias("lang"), h.alias("h"), F.substring(
        "text", (start + 1).cast("int"), F.lit(window)).alias("part"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = write_stage(
        parts.select("lang", "h").distinct()
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= windows)
        .select("lang", "h"), "language-windows")
    found = parts.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(
        F.min("part").alias("part")).collect()
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in found:
        texts.setdefault(r.lang, []).append((r.h, normal(r.part)))
    joined = {lang: b"".join(t for _, t in sorted(parts)) for lang, parts in texts.items()}
    return Model(tuple(sorted((lang, t) for lang, t in joined.items() if t)))


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1, higher: surer).

    Whole texts are parsed. A null text, one without letters, and every text under a model
    without languages is 'und' with score 0. Ties go to the language that is first by name.
    doc_id may be null or repeated; other columns are not read and do not matter. An empty
    table gives no rows. Memory is a batch of rows and the tables: for each language about
    twice its letters times the bytes in use, 4 bytes each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = identify(part.column("text").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    ship_code(docs.sparkSession)
    out = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, out)


def held_out(column: str = "doc_id") -> Column:
    """Rows whose labels the fit may not read."""
    return remainder(3, column) == 1
