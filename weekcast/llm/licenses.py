"""License scans: which license notices a text holds.

Texts and notices are compared by word shingles; shorter notices have shorter shingles,
so that one edited word leaves enough of them. Words that a notice marks (names,
versions) have to match as they are. A text is read in overlapping windows a little
longer than a notice, stepped so that any occurrence lies in one window; the last ones
end with the text. MinHash bands (one value each) of a window retrieve notices, and
exact containment of the notice's shingles in the window verifies them. The number of
bands follows from the lowest Jaccard similarity that a window with enough shingles can
have, so that such a window is missed with a probability of ``MISS`` at most.

Windows are only made around words without which no window can match: a marked word of
each notice, or so many words that more shingles hold one of them than may be missing.

Only DataFrame functions are used; notices are a list that the caller holds.
"""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import LOWER, UPPER, broadcast_if, let, row_number, words

SHINGLE = 5
CONTAINMENT = 0.8
PART = 60                          # words; longer notices are looked for in parts
MISS = 1e-6
BROADCAST_ROWS = 50_000            # bands of notices, each with up to PART hashes
NOTICES_FILE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "notices.txt")
# Marked words that many notices have; a window is better looked for by another one.
USUAL = {"general", "license", "public", "version"}


def read_notices(path: str = NOTICES_FILE) -> list[tuple[str, str]]:
    """(license, notice) of a file in the format that ``notices.txt`` explains."""
    out: list[tuple[str, str]] = []
    with open(path, encoding="utf-8") as f:
        blocks = re.split(r"^== ", re.sub(r"^#.*\n", "", f.read(), flags=re.M), flags=re.M)
    for block in blocks[1:]:
        head, _, body = block.partition("\n")
        name, *flags = head.split()
        out += [(name, " ".join(n.split())) for n in re.split(r"\n\s*\n", body) if n.strip()]
        if "spdx" in flags:
            out.append((name, f"[SPDX-License-Identifier: {name}]"))
    return out


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                      text.translate(str.maketrans(UPPER, LOWER)))


def shingle_of(length: int) -> int:
    """Words of a shingle: of a notice of 5 words or more, at most a fifth of the shingles
    hold one given word. A shorter notice is one shingle."""
    return length if length < SHINGLE else max(1, min(SHINGLE, (length + 1) // 6))


def step_of(length: int) -> int:
    return max(1, length // 4)


def window_of(length: int) -> int:
    """A fifth more than the notice, for inserted words."""
    return length + length // 5 + step_of(length) - 1


def needed(shingles: int, containment: float) -> int:
    return math.ceil(containment * shingles - 1e-9)


@dataclass(frozen=True)
class Part:
    license: str
    number: int
    words: tuple[str, ...]
    must: tuple[str, ...]              # marked phrases
    decisive: bool                     # whether it tells the license by itself

    @property
    def size(self) -> int:
        return shingle_of(len(self.words))

    @cached_property
    def shingles(self) -> list[tuple[str, ...]]:
        n = self.size
        return list(dict.fromkeys(self.words[i:i + n] for i in range(len(self.words) - n + 1)))

    def anchors(self, containment: float) -> set[str]:
        """Words of which every window that holds the part has one."""
        if self.must:
            marked = {w for m in self.must for w in m.split()}
            return {max(marked - USUAL or marked, key=lambda w: (len(w), w))}
        spare = len(self.shingles) - needed(len(self.shingles), containment)
        chosen: set[str] = set()
        for w in sorted(set(self.words), key=lambda w: (-len(w), w)):
            if sum(not chosen.isdisjoint(s) for s in self.shingles) > spare:
                break
            chosen.add(w)
        return chosen


def parts_of(notices: list[tuple[str, str]]) -> list[Part]:
    """Parts of about equal length that share ``SHINGLE - 1`` words; those of a license are
    numbered over all its notices. Of a notice with marks, parts without one only support
    the others."""
    out, number = [], {}
    for name, text in notices:
        pieces = [split_words(p) for p in re.split(r"\[([^\]]*)\]", text or "")]
        w = [x for p in pieces for x in p]
        marks, at = [], 0
        for i, p in enumerate(pieces):
            if i % 2 and p:
                marks.append((at, at + len(p)))
            at += len(p)
        shared = SHINGLE - 1
        count = max(1, math.ceil((len(w) - shared) / (PART - shared))) if w else 0
        for k in range(count):
            first = k * (len(w) - shared) // count if k else 0
            last = (k + 1) * (len(w) - shared) // count + shared if k + 1 < count else len(w)
            must = tuple(" ".join(w[a:b]) for a, b in marks if first <= a and b <= last)
            number[name] = number.get(name, -1) + 1
            out.append(Part(name, number[name], tuple(w[first:last]), must, bool(must) or not marks))
    return out


def bands_of(length: int, own: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands that a window needs to meet a notice of this length and ``own`` shingles."""
    window, shared = window_of(length) - shingle_of(length) + 1, needed(own, containment)
    jaccard = shared / (own + window - shared)
    return 1 if jaccard >= 1 else math.ceil(math.log(miss) / math.log(1 - jaccard))


def shingle_hashes(tokens: Column, n: Column) -> Column:
    """``tokens`` is a column or lambda variable."""
    return F.when(F.size(tokens) >= n, F.transform(
        F.sequence(F.lit(1), F.size(tokens) - n + 1),
        lambda i: F.xxhash64(F.slice(tokens, i, n)))).otherwise(F.array().cast("array<bigint>"))


def minima(hashes: Column, bands: Column) -> Column:
    """The smallest hash of each band's hash function."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda band: F.array_min(
        F.transform(hashes, lambda h: F.xxhash64(h, band))))


def banded(tokens: Column, n: Column, bands: Column) -> Column:
    """(shingles, bands) of a run of words."""
    return let(shingle_hashes(tokens, n), lambda h: F.struct(
        F.array_distinct(h).alias("shingles"), minima(h, bands).alias("bands")))


def _around(tokens: Column, classes: Column, anchors: list[str]) -> Column:
    """(length, size, bands, start, view) of the windows that hold an anchor."""
    places = F.filter(F.transform(tokens, lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
                      lambda p: p["word"].isin(anchors))

    def grid(at: Column, c: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((at - c["span"] + 1) / c["step"]).cast("int"))
        return F.sequence(first, F.floor(at / c["step"]).cast("int"))

    def of_class(c: Column, found: Column) -> Column:
        mine = F.filter(found, lambda p: F.array_contains(c["anchors"], p["word"]))
        steps = F.array_distinct(F.flatten(F.transform(mine, lambda p: grid(p["at"], c))))
        return F.transform(steps, lambda k: F.struct(
            c["length"].alias("length"), c["size"].alias("size"), c["bands"].alias("bands"),
            (k * c["step"]).alias("start"),
            F.slice(tokens, k * c["step"] + 1, c["span"]).alias("view")))

    return let(places, lambda found: F.flatten(F.transform(
        classes, lambda c: of_class(c, found))))


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None,
         containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs`` and license found in it: row, doc_id, license, parts
    (of its notices that were found), windows (that hold enough of a part), containment
    (the highest) and start (the first such window, in words).

    ``notices``: (license, text), default those of ``notices.txt``; marked words stand in
    square brackets. Null and empty texts hold nothing. Ids may be null or repeat: each
    row is scanned. A window at the end of a text is shorter, and a text may be shorter
    than a notice. Notices without words are passed over. Other columns are not read. An
    empty table gives no rows.
    """
    spark, parts = docs.sparkSession, parts_of(read_notices() if notices is None else notices)
    of_length: dict[int, list[Part]] = {}
    for p in parts:
        of_length.setdefault(len(p.words), []).append(p)
    bands = {n: max(bands_of(n, len(p.shingles), containment) for p in ps)
             for n, ps in of_length.items()}
    anchored = {n: sorted(set().union(*(p.anchors(containment) for p in ps)))
                for n, ps in of_length.items()}
    anchors = sorted(set().union(*anchored.values()))
    table = spark.createDataFrame(
        [(p.license, p.number, len(p.words), p.size, bands[len(p.words)], list(p.words),
          list(p.must), p.decisive) for p in parts],
        "license string, part int, length int, size int, bands int, tokens array<string>, "
        "must array<string>, decisive boolean")
    known = (table.select("license", "part", "length", "must", "decisive",
                          banded(F.col("tokens"), F.col("size"), F.col("bands")).alias("own"))
             .select("license", "part", "length", "must", "decisive", F.col("own.shingles").alias("own"),
                     F.posexplode("own.bands").alias("band", "value")))
    known = broadcast_if(known, sum(bands[len(p.words)] for p in parts), BROADCAST_ROWS)
    if not parts:
        classes = F.from_json(F.lit("[]"), "array<struct<length int, size int, span int, step int, "
                                           "bands int, anchors array<string>>>")
    else:
        classes = F.array(*[F.struct(
            F.lit(n).alias("length"), F.lit(shingle_of(n)).alias("size"),
            F.lit(window_of(n)).alias("span"), F.lit(step_of(n)).alias("step"),
            F.lit(bands[n]).alias("bands"),
            F.array(*[F.lit(w) for w in anchored[n]]).alias("anchors")) for n in sorted(of_length)])

    some = "|".join(re.escape(w) for w in anchors) or "(?!)"
    inside = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    windows = (docs.select(row_number().alias("row"), "doc_id", "text")
               .where(F.col("text").rlike(f"(?<!{inside})(?i:{some})(?!{inside})"))
               .select("row", "doc_id", F.inline(let(
                   words(F.col("text")), lambda t: _around(t, classes, anchors))))
               .select("row", "doc_id", "length", "start", "view",
                       banded(F.col("view"), F.col("size"), F.col("bands")).alias("has")))
    met = (windows.select("row", "doc_id", "length", "start", "view", "has.shingles",
                          F.posexplode("has.bands").alias("band", "value"))
           .join(known, ["length", "band", "value"]))
    share = F.size(F.array_intersect("own", "shingles")) / F.size("own")
    whole = F.concat(F.lit(" "), F.array_join("view", " "), F.lit(" "))
    marked = F.forall("must", lambda m: F.contains(whole, F.concat(F.lit(" "), m, F.lit(" "))))
    return (met.withColumn("share", share).where((F.col("share") >= containment) & marked)
            .groupBy("row", "doc_id", "license", "part", "start")
            .agg(F.max("share").alias("share"), F.bool_or("decisive").alias("decisive"))
            .groupBy("row", "doc_id", "license").agg(
                F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("windows"),
                F.max("share").alias("containment"), F.min("start").alias("start"),
                F.bool_or("decisive").alias("decisive"))
            .where("decisive").drop("decisive"))
