"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what toxic
text has beyond it. A window (a word) is compressed with the ordinary dictionary
alone and with the toxic one beside it; a window that gets much shorter with the
toxic dictionary is toxic language. Thresholds on that ratio, and the weight of the
number of windows above each, are calibrated on labelled texts that the dictionaries
have not seen.

Lengths are whole bytes, which is coarse for a word, so each character is written as
a fixed three-byte code before compression: what a dictionary does not hold costs
three bytes a character, and what it holds costs one match. A window follows a fixed
filler that both dictionaries end with, which keeps headers out of the comparison.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import row_of, ship_code
from weekcast.llm.learned import examples, logistic, remainder

REJECTED = 0.7                    # the least score of a toxic text
FIT_ROWS = 4000                   # labelled rows of each label that the fit reads at most
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 16 << 10
THRESHOLDS = (1.2, 1.5, 2.0, 2.5, 3.0)
EVIDENCE = 14.0                   # log-likelihood statistic a word needs to count as toxic
LEVEL = 12                        # finds every match; lower levels skip places
CACHED_WORDS = 300_000
PLENTY = 5                        # fewer bytes than this leave no room for a ratio of note
APART = " " * 8                   # training sees words one by one, not their neighbours
_WORD = re.compile(r"[^\W_]+")
_FILLER = bytes(range(1, 33))
_codes: dict[str, bytes] = {}
_seen: dict[str, dict[str, float]] = {}


def windows(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def coded(text: str) -> bytes:
    for c in text:
        if c not in _codes:
            _codes[c] = hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=3).digest()
    return b"".join(map(_codes.__getitem__, text))


def trained(texts: list[str], size: int, segment: int) -> str:
    """The words of a zstandard dictionary trained on texts; with too few of them to
    train on, those of the texts themselves."""
    samples = [t.encode("utf-8", "replace") for t in texts if len(t) >= 8]
    try:
        data = zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        data = b" ".join(samples)[-size:]
    text = "".join(c if c.isalnum() else " " for c in data.decode("utf-8", "ignore"))
    return " ".join(text.split())


def trained_in_rounds(texts: list[list[str]], size: int, rounds: int = 6) -> str:
    """A dictionary of single words: each round trains on the words that the rounds
    before have not put into it. Words that training cut short are left out."""
    words: dict[str, None] = {}
    whole = {w for d in texts for w in d}
    for _ in range(rounds):
        left = [APART.join(["", *(w for w in d if w not in words), ""]) for d in texts]
        found = [w for w in trained([t for t in left if t.strip()], size, 24).split()
                 if w in whole and w not in words]
        if not found:
            break
        words |= dict.fromkeys(found)
    return " ".join(words)


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in (4, 5, 6) if n < len(word)] + [word]


def toxic_words(toxic: list[list[str]], ordinary: list[list[str]]) -> set[str]:
    """Words of toxic texts that those have more often than chance allows, or that begin
    like that."""
    count = lambda texts, of: Counter(b for d in texts for b in {
        b for w in set(d) for b in beginnings(w) if of is None or b in of})
    t = count(toxic, None)
    o = count(ordinary, t)            # only what toxic texts have is looked up
    n, m = max(len(toxic), 1), max(len(ordinary), 1)
    share = n / (n + m)

    def evident(word: str) -> bool:
        a, b = t[word], o[word]
        e = (a + b) * share
        if a < 2 or a * m <= 5 * b * n:
            return False
        return 2 * (a * math.log(a / e) + (b * math.log(b / (a + b - e)) if b else 0)) >= EVIDENCE

    known = {b for b in t if evident(b)}
    return {w for d in toxic for w in set(d) if known.intersection(beginnings(w))}


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def __getstate__(self) -> dict:                # compressors are made where they are used
        return {k: getattr(self, k) for k in ("ordinary", "toxic", "weights")}

    @cached_property
    def name(self) -> str:
        return hashlib.sha1(self.ordinary + b"|" + self.toxic).hexdigest()

    @cached_property
    def _pair(self):
        def of(content: bytes):
            data = zstandard.ZstdCompressionDict(
                content + _FILLER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            squeeze = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False,
                write_dict_id=False).compress
            nothing = len(squeeze(_FILLER))
            return lambda w: max(len(squeeze(_FILLER + w)) - nothing, 0) + 1
        return of(self.ordinary), of(self.ordinary + self.toxic)

    def ratio(self, word: str) -> float:
        """How many times longer the word is without the toxic dictionary."""
        plain, toxic = self._pair
        window = coded(f" {word} ")
        length = plain(window)
        return 1.0 if length < PLENTY else length / toxic(window)

    def features(self, text: str | None) -> list[float]:
        known, found = _seen.setdefault(self.name, {}), windows(text)
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = self.ratio(w)
        ratios = np.fromiter(map(known.__getitem__, found), float, len(found))
        counts = [int((ratios >= t).sum()) for t in THRESHOLDS]
        n = max(len(found), 1)
        return ([math.log1p(c) for c in counts] + [min(1.0, 20 * c / n) for c in counts]
                + [min(float(ratios.max()), 6.0) if found else 1.0, math.log1p(len(found))])

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights[:-1], self.features(text)) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_texts(sample: list[tuple[str, int]]) -> Model:
    """Dictionaries from two thirds of the examples, calibration on the rest."""
    check = sample[2::3]
    learn = [e for i, e in enumerate(sample) if i % 3 != 2]
    words: dict[str, str] = {}                     # equal words are one object
    of = lambda t: [words.setdefault(w, w) for w in windows(t)]
    ordinary = [of(t) for t, y in learn if not y]
    toxic = [of(t) for t, y in learn if y]
    own = toxic_words(toxic, ordinary)
    toxic = [[w for w in d if w in own] for d in toxic]
    base = [" ".join(d[i:i + 150]) for d in ordinary for i in range(0, len(d), 150)]
    del ordinary, words, of
    plain = coded(f" {trained(base, ORDINARY_BYTES, 64)} ")
    del base
    model = Model(plain, coded(f" {trained_in_rounds(toxic, TOXIC_BYTES)} "), np.zeros(0))
    if not check:
        model.weights = np.zeros(len(model.features("")) + 1)
        return model
    model.weights = logistic(np.array([model.features(t) for t, _ in check]),
                             np.array([y for _, y in check], dtype=float))
    _seen.pop(model.name, None)                    # texts are scored elsewhere
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS) -> Model:
    """Fit on at most ``per_class`` labelled rows of each label, of the folds that are not
    held out (crc32 of the id modulo 3 is not 1). Without labels every score is 0.5."""
    return fit_texts(examples(docs, labels, "toxic", remainder(3) != 1, per_class))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, held_out, score (0 to 1) and predicted (score >= 0.7) of each row.

    Only the whole text is looked at; null and empty texts get the score of a text
    without windows. Ids may be null or repeat; other columns are not read. An empty
    table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = [model.score(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(scores, pa.float64())],
                    names=["row", "doc_id", "score"])

    ship_code(docs.sparkSession)
    scored = docs.select(row_of(docs).alias("row"), "doc_id", "text").mapInArrow(
        run, T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"],
                           T.StructField("score", T.DoubleType())]))
    return scored.select("row", "doc_id", (remainder(3) == 1).alias("held_out"), "score",
                         (F.col("score") >= REJECTED).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; the rows
    pass through the task that scores them, so nothing is stored or joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array([model.score(t) < REJECTED
                                            for t in part.column("text").to_pylist()], pa.bool_()))

    ship_code(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
