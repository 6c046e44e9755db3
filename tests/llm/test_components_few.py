"""Components of few links in one task, of many by rounds."""

import random

import numpy as np
import pytest

from netloom.llm import components


def brute(links):
    label = {x: x for ab in links for x in ab}
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = {x: low if y == high else y for x, y in label.items()}
    return label


@pytest.mark.parametrize("shape", ["random", "chain", "star", "pairs"])
def test_roots_of(shape):
    r = random.Random(shape)
    names = [r.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
    links = {"random": [tuple(r.sample(names, 2)) for _ in range(200)], "chain": list(zip(names, names[1:], strict=False)), "star": [(max(names), x) for x in names if x != max(names)], "pairs": list(zip(names[::2], names[1::2], strict=True))}[shape]
    u, v = (np.array(x, "i8") for x in zip(*links, strict=True))
    assert dict(zip(*(x.tolist() for x in components.roots_of(u, v)), strict=True)) == brute(links)


def test_both_ways(spark, monkeypatch):
    r = random.Random(3)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(7, 7), (None, 5)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = brute([x for x in links if None not in x and x[0] != x[1]])
    assert sorted(map(tuple, components.connected(frame, few=0).collect())) == sorted(want.items())
    # Few links need no round: each would be some ten stages of the driver's.
    monkeypatch.setattr(components, "_large_star", lambda links: pytest.fail("a round"))
    assert sorted(map(tuple, components.connected(frame).collect())) == sorted(want.items())
