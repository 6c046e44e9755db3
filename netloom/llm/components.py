"""Connected components of a graph given by its links, on executors only.

Large-star and small-star rounds alternate (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): each node's larger neighbours are linked to the smallest
node around it, then its smaller ones. Links never get more, every round is a minimum by key and
a join, and their number is logarithmic in the longest chain. Each round's links are written to the shared
folder, so that neither lineage nor a lost executor adds up. A node with very many links
meets partial minima first; its join is one that adaptive execution can split.

As soon as links are at most `few` (at the start, or after a round), one task of an executor reads that table and finds all components in arrays of
that bounded size, by the same minima. Rounds cost a driver some ten stages each, however few links there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import dropped, written

#: Links up to which one task finds the components: about 30 MB of arrays.
FEW = 1 << 18


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """links: u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    met = links.join(least, "u")
    return met.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, in order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while ((up := root[root]) != root).any():
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[root]


def _at_once(links: DataFrame) -> DataFrame:
    """(node, root) of few links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0), b.column(1)) for b in batches]
        if ends:
            u, v = (pa.chunked_array(x).to_numpy() for x in zip(*ends, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots_of(u, v)], names=["node", "root"])

    return written(links.coalesce(1).mapInArrow(run, "node long, root long"), "roots", short=True)


def connected(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, root) of every node that has a link to another; root is the smallest node reachable. Loops and repeated links do no harm."""
    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links", short=True)
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        if sign[0] <= few and now.schema["u"].dataType.simpleString() == "bigint":
            out = _at_once(now.select("u", "v"))
            dropped(now)
            return out
        seen = sign
        large = _large_star(now).distinct()
        after = written(_small_star(large).distinct(), "links", short=True)
        dropped(now)
        now = after
