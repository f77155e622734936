"""Packing and token shards against the tokenizer applied to whole texts."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weekcast.llm import packing, token_shards
from weekcast.llm.queries import tokenizer_file
from weekcast.llm.tokens import Encoder

TEXTS = [
    "Hello, world. It's a test.", None, "", "   ", "A.\x1cB", "ΑΣ ΑΣ'Β. Ω", "x" * 5000,
    "naïve İstanbul Été, J̌ ½ 3.5 ok.\n\nA B\x85C", "they'll we've I'm '' 's 'S don't.",
    "<|endoftext|> <|startoftext|>x", "日本語 テキスト。 emoji 😀!!, ok.", "word " * 9000,
    "THE!! AND,!! a*** b,%%% c.### | d |", "Hello, world. It's a test.", "é, É.",
    "ſ, K. ﬁ, ß. ǅ. o​x.", "a,b a, b ,c . .. , ...",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_cached_words_give_the_ids_of_the_whole_text(plain):
    for dtype in ("<u4", "<u2"):
        encoded = Encoder(tokenizer_file(), dtype).encode(TEXTS)
        assert [np.frombuffer(b, dtype).tolist() for b in encoded] == [plain(t) for t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "x", 7) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, sequence_id string, ids int").repartition(3).cache()


def test_pieces_rebuild_every_document_and_fill_sequences(docs, plain):
    rows = packing.pack(docs, tokenizer_file(), size=256, task_bytes=1 << 10).collect()
    want = sorted(bytes(np.array(plain(r.text) + [1], "<u4")) for r in docs.collect())
    by_doc, got = {}, []
    for r in rows:                                   # pieces of a row come one after another
        assert r.length * 4 == len(r.ids)
        if r.piece == 0:
            got.append(b"")
        assert r.start * 4 == len(got[-1])
        got[-1] += r.ids
        by_doc.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(got) == want
    for places in by_doc.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256


def test_few_sequences_and_bounded_open_bins():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6.3, 1.1, 20_000).astype(int) + 1)
    bins = packing.BestFit(4096)
    fill = {}
    for n in lengths.tolist():
        s, at = bins.place(n)
        assert fill.get(s, 0) == at
        fill[s] = at + n
        assert bins.open <= packing.OPEN
    assert max(fill.values()) <= 4096
    assert bins.sequences <= 1.01 * np.ceil(lengths.sum() / 4096)
    small = packing.BestFit(10, open_bins=1)
    assert [small.place(n) for n in (6, 5, 4, 5, 10)] == [(0, 0), (1, 0), (1, 5), (2, 0), (3, 0)]


def test_empty_tables(spark, docs):
    none = docs.where("doc_id < -1")
    assert packing.pack(none, tokenizer_file()).count() == 0
    path = token_shards.write_token_shards(none, tokenizer_file())
    assert token_shards.read_token_shards(spark, path).count() == 0


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 64, 1000, 65_537):
        out = token_shards.feistel(np.arange(n), n, key=9)
        assert sorted(out.tolist()) == list(range(n))
    assert (token_shards.feistel(np.arange(1000), 1000, 9)
            != token_shards.feistel(np.arange(1000), 1000, 8)).any()


def test_shards_hold_every_token_once_and_resume(spark, docs, plain):
    size = dict(length=64, shard_bytes=4000)
    path = token_shards.write_token_shards(docs, tokenizer_file(), key=5, **size)
    rows = sorted(token_shards.read_token_shards(spark, path, **size).collect())
    per = 4000 // token_shards.stride(64)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all((r.shard, r.place) == divmod(r.slot, per) for r in rows)
    streams = {}
    for r in sorted(rows, key=lambda r: (r.stream, r.number)):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 2 * r.n_tokens
        streams[r.stream] = streams.get(r.stream, b"") + r.ids
    tokens = np.concatenate([np.frombuffer(b, "<u2") for b in streams.values()])
    cut = lambda ids: [tuple(x) for x in np.split(ids, np.flatnonzero(ids == 1) + 1) if len(x)]
    want = np.concatenate([np.array(plain(r.text) + [1], "<u2") for r in docs.collect()])
    assert sorted(cut(tokens)) == sorted(cut(want))
    later = token_shards.read_token_shards(spark, path, start=per + 3, **size).collect()
    assert sorted(r.slot for r in later) == list(range(per + 3, len(rows)))
    numbers = [(r.stream, r.number) for r in rows]
    assert numbers != sorted(numbers)
