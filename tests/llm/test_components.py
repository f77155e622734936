"""Connected components, few edges and many."""

from __future__ import annotations

import random

import pytest
from weekcast.llm import near_dup
from weekcast.llm.common import write_stage


def roots(edges: list[tuple[int, int]]) -> dict[int, int]:
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return {x: r for x, r in root.items() if x != r}


@pytest.mark.parametrize("few", [True, False])
def test_components_of_few_edges_are_one_task(spark, monkeypatch, few):
    pick = random.Random(3)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(9, 9), (70, 71)]
    before = {k: spark.conf.get(k) for k in (
        "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    if not few:
        monkeypatch.setattr(near_dup, "EDGES_OF_A_TASK", 0)
    try:
        for k, v in zip(before, ("5", "false"), strict=True):
            spark.conf.set(k, v)
        stored = write_stage(spark.createDataFrame(edges, "a long, b long").repartition(3), "made")
        found = near_dup.components(stored)
        assert {r.row: r.root for r in found.collect()} == roots(edges)
        assert (len(found.inputFiles()) == 1) == few
        more = write_stage(spark.createDataFrame([(0, 71), (70, 99)], "a long, b long"), "more")
        again = near_dup.grown(found, more)
        assert {r.row: r.root for r in again.collect()} == roots([*edges, (0, 71), (70, 99)])
        assert near_dup.grown(found, more.where("a < 0")) is found
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
