"""Near-duplicate texts: SimHash fingerprints find and prune candidates, the exact Jaccard similarity of word shingles decides.

Two texts are linked if their sets of `width`-word shingles have a similarity of `least` or more. Candidates come from two searches, and
sets decide on all of them. The first is that of simhash.links: pigeonring chains, on both halves of fingerprints of 128 bits, which finds every pair
that differs in up to 5 of them (then one half differs in 2 bits at most). At a similarity of 0.8 they differ in 19 on average (deviation 4); for a radius that
covers this, pigeonring segments that must agree have few bits and are of no use as keys. What lies beyond comes from shared shingles, where fingerprints
prune candidates before any set is looked at.

1. Classes. Texts with equal sets are one class. Those within 2 bits of 64 in one half of their fingerprints are candidates (of large groups, stars).
2. Prefixes. Of m shingles in any order that all texts share, two similar sets have one in common
   among their first m - ceil(least * m) + 1. Shingles go by how often a sample holds them, rare ones first, then by
   their hash: the sample decides how long lists get, never what is found.
3. Lists. Classes that share a shingle in their prefixes are paired if sizes and places allow the similarity and their fingerprints
   differ in at most `RADIUS` of 128 bits (two sets at 0.8 lie beyond with a probability of under 1e-6). In lists of over `hot`
   classes, all are paired with a few leaders first: those with the fewest rare shingles, which most others are near to, and any. Components
   don't need pairs that are connected already, so further leaders come from other components, and at last only pairs between
   components are looked at: those whose sets differ in few enough shingles by the parities of `PARITIES` groups of shingles, which
   never count more than there are. So a dense group makes few pairs, also where most of its members are just not similar.
4. Pairs are verified by their sets, which are read again from the texts that occur in lists.

Texts move once, and only those that may be in a pair.

Defined results: words are as in simhash.fingerprint; texts with fewer words than `width` are one shingle; null and
empty texts and those of white space are one class; null ids belong to their component, whose id is its smallest id that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.components import connected
from netloom.llm.shared import bitmap, dropped, lean, passes, text_key, written
from netloom.llm.simhash import links, majority

WIDTH, LEAST = 5, 0.8
#: Classes in a list, beyond which leaders go first; leaders of a list at once; rounds of them.
HOT, LEADERS, ROUNDS = 64, 4, 2
#: One text in so many is looked at for common shingles; how many of these are common; at most so many are known.
SAMPLED, COMMON, KNOWN = 16, 4, 500_000
#: Differing bits of 128, beyond which a pair isn't looked at.
RADIUS = 46
#: Groups of shingles, by hash, whose parities are compared.
PARITIES = 512


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, "i8")
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, runs, repeat(7))), "i8"))


def _class(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(hashes.tobytes(), 11)
    return x - (1 << 64) if x >> 63 else x


def _prints(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits; a bit is 1 if it is set in over half the hashes or, for the second half, in their products with an odd number."""
    with np.errstate(over="ignore"):
        more = hashes.view("u8") * np.uint64(0x9E3779B97F4A7C15)
        more ^= more >> np.uint64(29)
        more *= np.uint64(0xBF58476D1CE4E5B9)
        more ^= more >> np.uint64(32)
    return majority(hashes.view("u1").reshape(-1, 8)), majority(more.view("u1").reshape(-1, 8))


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Bits, as longs: whether a group has an odd number of hashes. Two sets differ in as many hashes as bits, or more."""
    odd = np.bincount(hashes & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype("u1")).view("i8")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, "i8"), *parts])))


def by_print(classes: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: classes (columns class, m, f, g) within so many bits in one half of their fingerprints, as simhash.links gives them; those of one fingerprint go with the first of them."""
    found = []
    for half in ("f", "g"):
        holders = classes.filter("m > 0").select(F.col(half).alias("fp"), "class")
        firsts = written(holders.groupBy("fp").agg(F.min("class").alias("class"), F.count("*").alias("n")), "prints", short=True)
        one = lambda end: firsts.select(F.col("fp").alias(end), F.col("class").alias(f"{end}_class")).hint("merge")  # noqa: E731, B023
        near = links(firsts.select("fp"), radius).join(one("a"), "a").join(one("b"), "b").select("a_class", "b_class")
        same = holders.join(firsts.filter("n > 1").select("fp", F.col("class").alias("a_class")).hint("merge"), "fp").filter("class <> a_class").select("a_class", F.col("class").alias("b_class"))
        found.append(near.unionAll(same))
    return found[0].unionAll(found[1]).select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b: classes) whose sets are similar."""
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    in_common = F.size(F.array_intersect("x", "y"))
    return written(both.filter(in_common >= (F.size("x") + F.size("y") - in_common) * F.lit(least) - 1e-9).select("a", "b"), "links", short=True)


def rows_of(docs: DataFrame, least: float = LEAST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, key (hash of the text), root (of the component, whatever it is) of each row."""
    src = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in sets], pa.int64()), _lists(sets)], names=["class", "set"])

    some = src.filter(F.pmod("key", F.lit(SAMPLED)) == 0).select("text").mapInArrow(sampled, "class long, set array<long>").dropDuplicates(["class"])
    often = some.select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").cast("int").alias("n")).filter(F.col("n") >= COMMON)
    known = sorted((r["h"], r["n"]) for r in often.orderBy(F.desc("n"), "h").limit(KNOWN).collect())
    common, count = np.array([h for h, _ in known], "i8"), np.array([n for _, n in known], "i4")

    def prefix(x: np.ndarray) -> np.ndarray:
        n = len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1
        if not len(x) or not len(common):
            return x[:n] if len(x) else x
        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
        late = np.where(common[at] == x, count[at], 0)
        return x[np.argsort(late, kind="stable")[:n]] if late.any() else x[:n]

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            keys, sizes, prints, heads = [], [], [], []
            for t in b.column(2):
                x = shingles(t.as_py(), width)
                keys.append(_class(x))
                sizes.append(len(x))
                prints.append(_prints(x) if len(x) else (0, 0))
                heads.append(prefix(x))
            f, g = zip(*prints, strict=True) if prints else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), _lists(heads)], names=["id", "key", "class", "m", "f", "g", "head"])

    rows = written(src.mapInArrow(classed, f"id {kind}, key long, class long, m int, f long, g long, head array<long>"), "classed")
    classes = written(rows.groupBy("class").agg(F.any_value("m").alias("m"), F.any_value("f").alias("f"), F.any_value("g").alias("g"), F.any_value("key").alias("key")), "classes", short=True)
    heads = rows.select("class", "head").dropDuplicates(["class"])
    entries = heads.select("class", F.posexplode("head").alias("at", "h")).repartition("h").withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter("n > 1")
    met = written(entries.join(classes.select("class", "m", "f", "g").hint("merge"), "class"), "met", short=True)
    few, many = met.filter(F.col("n") <= hot), met.filter(F.col("n") > hot)

    def near(a: str, b: str) -> Column:
        """Sizes and places allow it, if this is the first shingle that both share, and so do fingerprints."""
        m = F.col(f"{a}.m") + F.col(f"{b}.m")
        left = F.least(F.col(f"{a}.m") - F.col(f"{a}.at"), F.col(f"{b}.m") - F.col(f"{b}.at"))
        bits = F.bit_count(F.col(f"{a}.f").bitwiseXOR(F.col(f"{b}.f"))) + F.bit_count(F.col(f"{a}.g").bitwiseXOR(F.col(f"{b}.g")))
        return (left * (1 + least) + 1e-6 >= m * least) & (bits <= RADIUS)

    def few_apart(a: str, b: str) -> Column:
        """No similar sets differ in more shingles than this allows."""
        bits = reduce(Column.__add__, [F.bit_count(F.get(f"{a}.odd", F.lit(i)).bitwiseXOR(F.get(f"{b}.odd", F.lit(i)))) for i in range(PARITIES // 64)])
        return bits * (1 + least) <= (F.col(f"{a}.m") + F.col(f"{b}.m")) * (1 - least) + 1e-6

    def ends(x: DataFrame) -> DataFrame:
        return x.select(F.least("a.class", "b.class").alias("a"), F.greatest("a.class", "b.class").alias("b"))

    def apart(some: DataFrame, lists: DataFrame) -> DataFrame:
        """Pairs of the same list in different components."""
        may = (F.col("a.h") == F.col("b.h")) & (F.col("a.root") != F.col("b.root")) & near("a", "b")
        return ends(some.alias("a").join(lists.alias("b"), may & few_apart("a", "b") if "odd" in some.columns else may)).distinct()

    def led(lists: DataFrame, seed: int) -> DataFrame:
        """Pairs of the classes of each list with its leaders, where they aren't connected."""
        of = F.struct(*[c for c in lists.columns if c not in ("h", "n")])
        any_ = [F.struct(F.xxhash64("root", F.lit(seed * LEADERS + i)), "at", F.xxhash64("class", F.lit(i))) for i in range(LEADERS // 2)]
        central = [F.struct("at", F.xxhash64("class", F.lit(seed * LEADERS + i))) for i in range(LEADERS // 2, LEADERS)]
        leaders = lists.groupBy("h").agg(*[F.min_by(of, by).alias(f"l{i}") for i, by in enumerate(any_ + central)])
        leaders = leaders.select("h", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("l")).select("h", "l.*")
        return apart(lists, leaders)

    pairs = few.alias("a").join(few.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.class") < F.col("b.class")) & near("a", "b"))
    near_prints = written(by_print(classes), "near", short=True)
    first = written(ends(pairs).unionAll(led(many.withColumn("root", F.col("class")), 0)).unionAll(near_prints).distinct(), "pairs", short=True)

    # Sets of all classes that may be in a pair, from one text of each.
    wanted = first.select(F.col("a").alias("class")).unionAll(first.select(F.col("b").alias("class"))).unionAll(many.select("class")).distinct()
    wanted = written(classes.join(wanted, "class", "left_semi").select("key"), "wanted", short=True)
    bits = bitmap(wanted, F.col("key"))
    texts = src.select("key", "text").withColumn("bitmap", bits.scalar()).filter(passes(F.col("key"), F.col("bitmap"))).select("key", "text")

    def set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in sets], pa.int64()), _lists(sets), _lists([_parities(x) for x in sets])], names=["class", "set", "odd"])

    # Copies fall before they are dealt out.
    once = texts.groupBy("key").agg(F.any_value("text").alias("text")).join(wanted.hint("merge"), "key", "left_semi").select("key", "text")
    sets = written(once.mapInArrow(set_of, "class long, set array<long>, odd array<long>").dropDuplicates(["class"]), "sets", short=True)

    roots = connected(verified(first, sets, least))

    def mixed() -> DataFrame:
        """Long lists that hold several components."""
        x = many.join(roots.hint("merge"), many["class"] == roots["node"], "left").select("h", "class", "m", "at", "f", "g", F.coalesce("root", "class").alias("root"))
        open_ = x.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h")
        return written(x.join(open_, "h", "left_semi").join(sets.select("class", "odd").hint("merge"), "class"), "mixed", short=True)

    lists = mixed() if not many.isEmpty() else many.limit(0)
    for i in range(1, ROUNDS + 1):
        if lists.isEmpty():
            break
        if i < ROUNDS:
            more = verified(led(lists, i), sets, least)
        else:  # what is left, component against component
            parts = lists.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
            small = lists.join(parts, "h").filter("root <> most")
            more = verified(apart(small, lists), sets, least)
        if not more.isEmpty():
            # What is connected already is a star around each root.
            roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
            dropped(lists)
            lists = mixed() if i < ROUNDS else lists
    dropped(sets)
    dropped(met)
    return written(rows.select("id", "key", "class").join(roots.hint("merge"), F.col("class") == F.col("node"), "left").select("id", "key", F.coalesce("root", "class").alias("root")), "rooted", short=True)


def similar(docs: DataFrame, least: float = LEAST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id_col and component_id (smallest id reachable) of each row."""
    rows = rows_of(docs, least, width, id_col, text_col, hot)
    smallest = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(smallest, "root").select(F.col("id").alias(id_col), "component_id")
