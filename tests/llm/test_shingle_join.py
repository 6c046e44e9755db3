"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
import pytest

from netloom.llm import shingle_join


def brute(rows):
    """Smallest id of each row's component."""
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(i, grams(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                low, high = sorted((label[i], label[j]))
                label = {x: low if y == high else y for x, y in label.items()}
    return label


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(n)] for n in (150, 90, 40, 14, 9)]
    rows = []
    for i in range(220):  # changed words give similarities on both sides of 0.8
        w = list(base[i % 5] if i % 3 else base[0])
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    return rows + [(300, None), (301, ""), (302, " \n"), (303, "two words"), (304, "Two  words"), (305, "two others")]


@pytest.mark.parametrize("hot", [2, 10, 64])
def test_components_equal_brute_force(spark, hot):
    rows = corpus(hot)
    want = brute(rows)
    assert 20 < len(set(want.values())) < 200
    got = shingle_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_stage_keeps_one_of_each_similar_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set(brute([(r["doc_id"], r["text"]) for r in docs.collect()]).values())
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, sf).collect()} == want


def test_dense_groups_make_few_pairs(spark, monkeypatch):
    """Near copies around the threshold: what is verified grows with the texts, not with their pairs, and no link is lost."""
    r = random.Random(5)
    base = [f"w{r.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"v{r.randrange(60)}"
        rows.append((i, " ".join(w)))
    looked_at = []
    verified = shingle_join.verified
    monkeypatch.setattr(shingle_join, "verified", lambda pairs, *more: looked_at.append(pairs.count()) or verified(pairs, *more))
    got = shingle_join.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == brute(rows)
    assert len(set(brute(rows).values())) > 100
    assert sum(looked_at) < 20 * len(rows)


def test_close_fingerprints_are_candidates(spark):
    """The pigeonring search gives the components of fingerprints within 2 bits in one half, small and large groups alike."""
    r = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = []
    for size in (1, 1, 2, 5, 40, 300):
        f, g = r.getrandbits(64), r.getrandbits(64)
        for _ in range(size):
            flips = [1 << r.randrange(64) for _ in range(r.randrange(4))]
            prints.append((f ^ sum(set(flips)), r.getrandbits(64)) if r.random() < 0.5 else (r.getrandbits(64), g ^ sum(set(flips))))
    classes = [(i * 7 - 900, 10, signed(f), signed(g)) for i, (f, g) in enumerate(prints)]
    near = lambda x, y: min(((x[k] ^ y[k]) & (2**64 - 1)).bit_count() for k in (2, 3)) <= 2
    want = {c[0]: c[0] for c in classes}
    for i, x in enumerate(classes):
        for y in classes[:i]:
            if near(x, y) and want[x[0]] != want[y[0]]:
                low, high = sorted((want[x[0]], want[y[0]]))
                want = {c: low if z == high else z for c, z in want.items()}
    frame = spark.createDataFrame([*classes, (5000, 0, 0, 0), (5001, 0, 0, 0)], "class long, m int, f long, g long")
    found = shingle_join.by_print(frame)
    assert found.filter("a >= 5000 or b >= 5000").isEmpty()
    roots = {x["node"]: x["root"] for x in shingle_join.connected(found).collect()}
    assert {c: roots.get(c, c) for c in want} == want


def test_stage_searches_by_fingerprints(spark, monkeypatch):
    """Both halves of the fingerprints go through the pigeonring search."""
    called = []
    links = shingle_join.links
    monkeypatch.setattr(shingle_join, "links", lambda prints, *more: called.append(prints.columns) or links(prints, *more))
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g "), (3, "h")], "doc_id long, text string")
    assert {x["doc_id"] for x in stage(spark, docs, "").collect()} == {1, 3}
    assert called == [["fp"], ["fp"]]
