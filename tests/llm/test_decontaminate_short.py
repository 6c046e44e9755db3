"""Documents shorter than an item against brute force."""

import random

from test_llm import windows_brute

from netloom.llm import decontaminate


def test_truncated_items_equal_brute_force(spark):
    r = random.Random(8)
    items = [" ".join(f"w{r.randrange(5000)}" for _ in range(n)) for n in range(9, 21) for _ in range(4)]
    docs = [(100 * j + cut + 50 * head, " ".join(w[cut:] if head else w[: len(w) - cut])) for j, w in enumerate(map(str.split, items)) for cut in range(5) for head in (0, 1)]
    want = {(a, j) for a, t in docs for j, item in enumerate(items) if windows_brute(t, item) >= 0.8}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(d, b).collect()}
    assert got == want and len(want) > 150


def test_many_short_truncated_items(spark):
    """Similarities of exactly 4/5 over few shingles, where fingerprints differ most."""
    r = random.Random(9)
    items = [" ".join(f"v{r.randrange(9000)}" for _ in range(n)) for n in range(6, 13) for _ in range(72)]
    docs = [(j, " ".join(w[1:] if j % 2 else w[:-1])) for j, w in enumerate(map(str.split, items))]
    want = {(j, j) for j, t in docs if windows_brute(t, items[j]) >= 0.8}
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(want) > 280


def test_items_that_repeat_an_id_or_have_none(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    items = spark.createDataFrame([(1, a), (1, b), (None, c)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (2, b), (3, c), (None, c), (None, "nothing of the kind"), (3, "of its own")], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, None), (None, None)}
    kept = {(x["doc_id"], x["text"]) for x in decontaminate.clean(docs, items).collect()}
    assert kept == {(None, "nothing of the kind"), (3, "of its own")}
