"""Tables whose vectors are all alike: fewer than two pivots by similarity."""

import numpy as np
import pytest

from netloom.llm import pivot_index


def clouds():
    r = np.random.default_rng(5)
    base = r.normal(size=16)
    near = 0.97 * np.array([1.0, 0.0]) + np.sqrt(1 - 0.97**2) * np.array([0.0, 1.0])
    return {
        "tight": base + r.normal(size=(300, 16)) * 0.25 * np.abs(base).mean(),
        "two": np.array([[1.0, 0.0], near]),
        "multiples": np.array([[1.0, 2.0], [2.0, 4.0]]),
        "one": np.array([[1.0, 2.0]]),
    }


@pytest.mark.parametrize("name", ["tight", "two", "multiples", "one"])
def test_alike_vectors_equal_brute_force(spark, name):
    x = clouds()[name]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    assert name != "tight" or ((unit @ unit[:1].T).min() >= 0.8 and 0 < (~linked).sum())
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.where(linked, label[None, :], len(x)).min(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivot_index.near_duplicates(rows, block=100).collect()}
    assert got == {i: (int(linked[i].sum()) - 1, int(label[i])) for i in range(len(x))}


@pytest.mark.parametrize("pivots", [124, 547, 4096])
def test_recall_at_the_threshold(spark, pivots):
    """Pairs at cosines from 0.95 to 0.96, and a dense group, at as many pivots as large tables have; nothing below is linked."""
    r = np.random.default_rng(pivots)
    base = r.normal(size=(4600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = r.normal(size=(700, 64))
    turn -= (turn * base[:700]).sum(1, keepdims=True) * base[:700]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    c = r.uniform(0.95, 0.96, size=(700, 1))
    group = base[4000] + r.normal(size=(300, 64)) * 0.028
    x = np.concatenate([base, c * base[:700] + np.sqrt(1 - c * c) * turn, group])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {q["vec_id"]: q["n_links"] for q in pivot_index.near_duplicates(rows, pivots=pivots, block=2000).collect()}
    n = np.array([got[i] for i in range(len(x))])
    assert (n <= linked.sum(1)).all() and n[4600:5300].sum() >= 0.9 * linked[4600:5300].sum() and n.sum() >= 0.9 * linked.sum()


def test_each_length_is_indexed(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(50)]
    near = lambda v: [x + 0.01 * (i % 2) for i, x in enumerate(v)]
    rows += [(100, [1.0, 2.0, 3.0]), (101, near([1.0, 2.0, 3.0])), (102, [-1.0, 2.0, 3.0]), (200, rows[0][1]), (201, near(rows[1][1])), (None, rows[2][1])]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, n int, class int")
    for pivots in (None, 2):
        got = {q["vec_id"]: (q["n_links"], q["component_id"]) for q in pivot_index.near_duplicates(frame, pivots=pivots).collect()}
        assert got[100] == got[101] == (1, 100) and got[102] == (0, 102) and got[200] == (1, 0) and got[201][1] == 1 and got[None] == (1, 2)
