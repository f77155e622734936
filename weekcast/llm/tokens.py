"""Token ids of texts, with a bounded cache of words per Python worker."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

CACHED_WORDS = 400_000         # of two generations each
# White space for str.split() but not for the tokenizer: such texts are encoded whole.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WIDE = re.compile("[̀-\U0010ffff]")
# Lower-case letters that no normalisation changes, and a full stop or comma, which is a
# token of its own behind them.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: visible ones of Latin-1 as themselves, the
    others, in order, from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()


class Encoder:
    """Ids as little-endian bytes of ``dtype``; the tokenizer must drop white space
    and lower-case (ids of a text are then those of its words, one after another)."""

    def __init__(self, path: str, dtype: str = "<u4"):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype(dtype)
        self.code = {1: "B", 2: "H", 4: "I", 8: "Q"}[self.dtype.itemsize]
        if self.tokenizer.get_vocab_size() > 1 << (8 * self.dtype.itemsize):
            raise ValueError(f"ids do not fit in {dtype}")
        self.cache = _Cache(self)
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.marks = {m: self._whole(m) for m in ".,"}
        # Only if this vocabulary agrees that letters can be spelled on their own.
        self.by_letters = all(
            self._whole(f"{w}{m} {w}") == self._spelled(w) + (self.marks[m] if m else b"")
            + self._spelled(w) for w in ("the", "été", "straße", "zzyqx", "ÿß") for m in ("", *".,"))

    def _whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _pieces(self, text: str) -> list[str] | None:
        if any(s in text for s in _SEPARATORS):
            return None
        return text.lower().split() if text.isascii() or not _WIDE.search(text) else text.split()

    def _spelled(self, word: str) -> bytes:
        """The ids of lower-case letters, straight from the vocabulary's merges."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return self.pack([t.id for t in self.model.tokenize(letters)])

    def _found(self, word: str) -> bytes | None:
        """The ids of a word that is not in the cache: those of the older generation, or of
        its letters; none if the tokenizer has to be asked."""
        ids = self.older.get(word)
        if ids is None and self.by_letters and (plain := _PLAIN.fullmatch(word)):
            stem, mark = plain.groups()
            if mark:
                ids = (self.cache.get(stem) or self.older.get(stem)
                       or self._spelled(stem)) + self.marks[mark]
            else:
                ids = self._spelled(word)
        return ids

    def _learn(self, words: list[str]) -> None:
        """Put words into the cache, in calls for many, told apart by their places."""
        for i in range(0, len(words), 5000):
            some = words[i:i + 5000]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.dtype)
            begins = np.array([o[0] for o in found.offsets] or [0], dtype=np.int64)
            words_begin = np.cumsum([0] + [len(w) + 1 for w in some])
            ends = np.searchsorted(begins[:len(ids)], words_begin).tolist()
            self.cache.update((w, ids[a:b].tobytes())
                              for w, a, b in zip(some, ends[:-1], ends[1:], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null has none."""
        if len(self.cache) > CACHED_WORDS:            # words in use come back from there
            self.older, self.cache = self.cache, _Cache(self)
        cache, out = self.cache, []
        for text in texts:
            pieces = self._pieces(text or "")
            if pieces is None:
                out.append(self._whole(text))
                continue
            known = list(map(cache.__getitem__, pieces))
            out.append(pieces if None in known else b"".join(known))
        self._learn(list(cache.unknown))
        cache.unknown.clear()
        return [o if isinstance(o, bytes) else b"".join(map(cache.__getitem__, o)) for o in out]


class _Cache(dict):
    """Ids of words, worked out when they are first asked for; words of which there are none
    yet are noted in ``unknown``."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.unknown = encoder, {}

    def __missing__(self, word: str) -> bytes | None:
        ids = self.encoder._found(word)
        if ids is None:
            self.unknown[word] = None
        else:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """The encoder of this Python worker; it keeps its cache between tasks."""
    return Encoder(path, dtype)
