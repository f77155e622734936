"""What a fit leaves on the driver, and plans that are made once."""

from __future__ import annotations

from weekcast.llm import exact_dedup, toxicity
from weekcast.llm.common import write_stage


def test_a_fit_leaves_no_words_behind():
    toxicity._seen.clear()
    words = [f"word{i}" for i in range(40)]
    model = toxicity.fit_texts([(" ".join(words[i % 7:] + ["vile"] * (i % 2)), i % 2)
                                for i in range(30)])
    assert 0 <= model.score("a vile word") <= 1
    toxicity._seen.pop(model.name)
    assert not toxicity._seen


def test_identities_are_stored_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(exact_dedup, "write_stage",
                        lambda df, name, **more: stored.append(name) or write_stage(df, name, **more))
    docs = spark.createDataFrame([(1, "a" * 9000), (2, "A" * 9000), (3, None)],
                                 "doc_id long, text string")
    found = exact_dedup.exact_duplicates(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == [
        (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert stored.count("identities") == 1
