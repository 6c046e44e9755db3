"""SimHash near-duplicates: fingerprints, pigeonring search, components.

Fingerprints at up to `radius` differing bits are found by the pigeonring principle
(Qin and Xiao, 2018). The bits form a ring of m segments with radius/m of the allowed
difference each. Two fingerprints within the radius have a segment from which on, for
every number l of consecutive segments, at most l * radius / m bits differ. For the first
segments that budget is below one bit, so they agree: they are the key of an equality join
(with m = 2 * radius + 1, nearly half of all bits). A candidate must keep within
the budgets of the whole chain before all its bits are compared, and it counts only at the first
chain that holds, so no pair is made twice.

Keys that more than `hot` fingerprints share (groups of near copies) are not paired: there,
each fingerprint is listed under itself and under each one that differs in one bit outside
the key. Two fingerprints lie within two bits if and only if they have such a
point in common, and a point has at most one fingerprint for each bit, so stars around the
points give the same components from a number of rows that grows in proportion.

Defined results: null and empty texts, and those of white space, have fingerprint zero and are linked like any other;
equal rows stay, as many as there are; null ids belong to the component of their
fingerprint, whose id is its smallest id that isn't null; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import connected
from netloom.llm.shared import split_off, text_key, thinned, without, written

BITS = 64
#: Fingerprints that share a key, beyond which they are linked by stars.
HOT = 128


def majority(raw: np.ndarray) -> int:
    """Of hashes as rows of 8 bytes: a signed number whose bits are those set in over half of them."""
    ones = np.zeros(BITS, "i8")
    for i in range(0, len(raw), 65535):
        bits = np.unpackbits(raw[i : i + 65535], axis=1)
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype="u1").sum(axis=0, dtype="i8") + bits[whole:].sum(axis=0, dtype="u1")
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, signed; a bit is 1 if it is in over half the shingles' hashes."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return majority(np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(42))), "u1").reshape(-1, 8))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id, key (text_key of the text) and fp (long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t.as_py(), width) for t in b.column(2)], pa.int64())], names=["id", "key", "fp"])

    src = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def ring(radius: int) -> tuple[list[list[int]], list[int], int]:
    """masks[i][l-1] of l segments from i on; the budget of l segments; how many have a budget of zero."""
    m = 2 * radius + 1
    edges = [round(BITS * i / m) for i in range(m + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    masks = [[_signed(reduce(int.__or__, (part[(i + j) % m] for j in range(n)))) for n in range(1, m + 1)] for i in range(m)]
    budgets = [n * radius // m for n in range(1, m + 1)]
    return masks, budgets, sum(b == 0 for b in budgets)


def links(prints: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """a, b: links that give the components of distinct fingerprints (column fp) at up to radius differing bits."""
    if radius != 2:
        hot = None  # a star's two ends differ in two bits at most, no more and no less; otherwise all keys are paired
    masks, budgets, zero = ring(radius)
    m = len(masks)
    keys = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(masks[i][zero - 1])).alias("key")) for i in range(m)])).alias("k")).select("fp", "k.at", "k.key")
    shared = keys.groupBy("at", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keys.join(shared, ["at", "key"])

    def chain(i: int) -> Column:
        x = F.col("a").bitwiseXOR(F.col("b"))
        return reduce(Column.__and__, [F.bit_count(x.bitwiseAND(F.lit(masks[i][n - 1]))) <= budgets[n - 1] for n in range(zero + 1, m + 1)] if m > zero else [F.lit(True)])

    def agrees(i: int) -> Column:
        return F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(masks[i][zero - 1])) == 0

    first = F.coalesce(*[F.when(agrees(i) & chain(i), F.lit(i)) for i in range(m)])
    few = met.filter(F.col("n") <= hot) if hot else met
    pairs = few.select("at", "key", F.col("fp").alias("a")).join(few.select("at", "key", F.col("fp").alias("b")), ["at", "key"]).filter("a < b").filter(first == F.col("at")).select("a", "b")
    if not hot:
        return pairs
    outside = [[b for b in range(BITS) if not masks[i][zero - 1] >> b & 1] for i in range(m)]
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)).cast("long") for b in bits]) for bits in outside]), F.col("at") + 1)
    points = met.filter(F.col("n") > hot).select("at", "fp", F.explode(flips).alias("flip")).select("at", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    stars = points.groupBy("at", "point").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
    return pairs.unionAll(stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b"))


def rows_of(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = 3, hot: int = HOT) -> DataFrame:
    """id, key, fp and root (of the component, whatever it is) of each row."""
    prints = written(fingerprints(docs, id_col, text_col, width), "prints")
    classes = written(prints.select("fp").distinct(), "classes", short=True)
    roots = connected(links(classes, radius, hot))
    return prints.join(roots, prints.fp == roots.node, "left").select("id", "key", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (smallest id reachable) of each row."""
    rows = written(rows_of(docs, radius, id_col, text_col, hot=hot), "rooted", short=True)
    least = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(least, "root").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest id (rows without an id come last), then the smallest hash of its text; of equal such rows, any one."""
    return firsts(docs, written(rows_of(docs, radius, id_col, text_col), "rooted", short=True), id_col, text_col)


def firsts(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """one_of_each, of rows (id, key, root). Rows that go, and those that are there several times, are few: only rows that may be among them are dealt out anew."""
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("one")).select("root", "one.*")
    first = first.select("root", F.col("id").alias("first_id"), F.col("key").alias("first_key"))
    counts = rows.groupBy("root", "id", "key").agg(F.count("*").alias("n")).join(first, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
    gone = written(counts.filter("not stays or n > 1").select("id", "key", "stays"), "gone", short=True)
    out = without(docs, gone.select("id", "key").distinct(), id_col, text_col)
    again = gone.filter("stays").select("id", "key")
    if again.isEmpty():
        return out
    _, rest, one, same = split_off(docs, again, id_col, text_col)
    whole = rest.join(one, same, "left_semi").select(F.struct(*[F.col(f"doc.`{c}`") for c in docs.columns]).alias("doc"))
    each = whole.groupBy(F.col(f"doc.`{id_col}`").alias("id"), text_key(F.col(f"doc.`{text_col}`")).alias("key")).agg(F.any_value("doc").alias("doc"))
    return out.unionAll(thinned(each.select("doc.*"), 8))
