"""The words that the tokenizer's cache learns."""

from __future__ import annotations

from weekcast.llm.queries import tokenizer_file
from weekcast.llm.tokens import Encoder


def test_words_are_learned_as_they_come():
    encoder = Encoder(tokenizer_file(), "<u2")
    learned = encoder.cache["straße,"]
    assert learned == encoder._whole("straße,")
    assert encoder.cache["x9"] is None and list(encoder.cache.unknown) == ["x9"]
    assert encoder.encode(["x9 straße, a\x1cb", None]) == [encoder._whole("x9 straße, a\x1cb"), b""]
    assert encoder.encode(["x9 Straße,"]) == [encoder._whole("x9") + learned]
    assert encoder.cache["x9"] == encoder._whole("x9") and not encoder.cache.unknown
