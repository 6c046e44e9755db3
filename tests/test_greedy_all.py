"""q_greedy_topk and q_tree_rules over all 64 features; the first against a selection by pandas' rank correlations."""

import re

from netloom.operators import selection
from netloom.plans import binding, matrix_queries


def test_greedy_takes_from_all_features(spark, sf):
    m = binding.matrix(spark, sf)
    rho = m.select("id", "feature", "x").toPandas().pivot(index="id", columns="feature", values="x").corr("spearman").abs()
    scores = {r["feature"]: round(r["mi"], 9) for r in selection.mutual_information(m).collect()}
    assert len(scores) == len(rho) == 64
    want = []
    for f in sorted(scores, key=lambda f: (-scores[f], f)):
        if len(want) < 12 and all(rho.loc[f, g] <= 0.08 for g in want):
            want.append(f)
    want += [f for f in sorted(scores, key=lambda f: (-scores[f], f)) if f not in want][: max(0, 4 - len(want))]
    got = [r["feature"] for r in matrix_queries.q_greedy_topk(spark, sf).orderBy("place").collect()]
    assert got == want and max(got) >= 24


def test_tree_rules_split_on_all_features(spark, sf):
    text = " ".join(r["text"] for r in matrix_queries.q_tree_rules(spark, sf).collect())
    assert max(map(int, re.findall(r"\bf(\d+) ", text))) >= 16
