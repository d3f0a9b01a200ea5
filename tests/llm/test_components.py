import random

import pytest

from lodestar.llm import common


@pytest.mark.parametrize("held", [200_000, 40])
def test_components(spark, monkeypatch, held):
    """By one forest, and by stars over many small forests."""
    monkeypatch.setattr(common, "FOREST", held)
    rng = random.Random(held)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(90)] + [(7, 7), (5, 4)]
    up = {x: x for e in links for x in e}
    for _ in range(len(links)):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {x: c for x, c in up.items() if sum(v == c for v in up.values()) > 1}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
