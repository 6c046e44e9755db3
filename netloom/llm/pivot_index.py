"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of vectors gives pivots, no two of which are alike (or two, if all are). Each vector is
described by its nearest pivots, in order of nearness. Close vectors see pivots in nearly the same order. An inverted list
for each pivot holds the vectors that have it among their first `heads`; two vectors of a list are candidates if
their first `prefix` pivots have `shared` in common, and only candidates' cosines are looked at, in double precision.
A pair counts only in the list of the smallest pivot among both's heads, so it counts once.

More pivots come with more vectors, up to MAX_PIVOTS, which keeps lists short. Equal vectors are one
class and take part once, with their number as weight. How long lists are is known before anything is dealt out (one number a pivot), so
that a vector moves `heads` times, as it came. Lists of more than `block` classes are cut into blocks, and
each pair of blocks is a task's work of bounded memory: a vector of a list that long moves once for each block. What leaves a list is a count
of links for each class and one link to the smallest member of its part of the list, never the pairs themselves.

Recall depends on the sample and the parameters; tests measure it against brute force.
The pivots come from at most SAMPLE vectors (those with the smallest hash, as many as SAMPLE_BYTES hold); every vector is indexed, whatever its length: each
length has pivots of its own, and one whose sample is empty has a single list.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own component, and so
do vectors of different lengths with each other; repeated rows are vectors of their own; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import connected
from netloom.llm.shared import dropped, written

SAMPLE, SAMPLE_BYTES, MAX_PIVOTS, MIN_PIVOTS = 16_384, 64 << 20, 8192, 64
#: Pivots are less alike than this.
ALIKE = 0.8
HEADS, PREFIX, SHARED, BLOCK = 3, 6, 2, 4096


def usable(vectors: pa.Array) -> list[np.ndarray | None]:
    """Components as float64 of each vector that can link, else None."""
    out: list[np.ndarray | None] = [None] * len(vectors)
    at, valid = vectors.offsets.to_numpy(), vectors.is_valid().to_numpy(zero_copy_only=False)
    values = vectors.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        x = values[a:b]
        if valid[i] and b > a and np.isfinite(x).all() and x.any():
            out[i] = x
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def choose_pivots(sample: list[np.ndarray], n: int) -> np.ndarray:
    """At most n (2 at least) unit vectors, none alike; where all are alike, any two. All of sample have one length."""
    all_ = _unit(np.array(sample))
    out = np.empty((0, all_.shape[1]))
    n = max(n, 2)
    for i in range(0, len(all_), 256):
        for x in all_[i : i + 256][(all_[i : i + 256] @ out.T < ALIKE).all(1)] if len(out) else all_[i : i + 256]:
            if not len(out) or (out @ x).max() < ALIKE:
                out = np.vstack([out, x])
                if len(out) == n:
                    return out
    return out if len(out) > 1 else all_[:2]  # with two pivots, every vector is in their lists


class Pivots:
    """Pivots by length of vector; they are numbered through, and lengths without any have a number below zero."""

    def __init__(self, sample: list[np.ndarray], n: int):
        by = defaultdict(list)
        for x in sample:
            by[len(x)].append(x)
        self.points, self.first, at = {}, {}, 0
        for size in sorted(by):
            self.points[size], self.first[size] = choose_pivots(by[size], max(2, n * len(by[size]) // len(sample))), at
            at += len(self.points[size])

    def nearest(self, vectors: list[np.ndarray], prefix: int) -> np.ndarray:
        """The first `prefix` pivots of each, nearest first; -1 where there are no more."""
        out = np.full((len(vectors), prefix), -1, "i4")
        size = np.array([len(x) for x in vectors])
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            if n in self.points:
                for part in np.array_split(rows, max(1, len(rows) * len(self.points[n]) >> 22)):
                    near = _unit(np.array([vectors[i] for i in part])) @ self.points[n].T
                    k = min(prefix, near.shape[1])
                    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    order = np.lexsort((best, -np.take_along_axis(near, best, 1)), axis=1)
                    out[part, :k] = np.take_along_axis(best, order, 1) + self.first[n]
            else:
                out[rows, 0] = -1 - n
        return out


def cell_links(unit: np.ndarray, weight: np.ndarray, near: np.ndarray, side: np.ndarray, pivot: int, same: bool, least: float, heads: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the classes in a cell of a pivot's list: summed weights of their links, and the first member (in the given order) of each one's part of the links."""
    n = len(unit)
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    counts, label = np.zeros(n, "i8"), np.arange(n)
    known, where = np.unique(near, return_inverse=True)
    where = where.reshape(near.shape)
    has, leads = np.zeros((n, len(known)), "f4"), np.zeros((n, len(known)), "f4")
    for k in range(near.shape[1]):
        has[np.arange(n), where[:, k]] = near[:, k] != -1
        if k < heads:
            leads[np.arange(n), where[:, k]] = (near[:, k] != -1) & (near[:, k] < pivot)
    need = np.minimum(shared, (near != -1).sum(1))
    found = []
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        # Shared pivots first, then pairs that no list before this one has, then cosines of what is left.
        may = has[rows] @ has[right].T >= np.minimum(need[rows][:, None], need[right][None])
        may &= leads[rows] @ leads[right].T == 0
        if same:
            may &= rows[:, None] < right[None]
        if not may.any():
            continue
        if may.mean() < 0.02:
            a, b = np.nonzero(may)
            ok = np.concatenate([(unit[rows[a[j : j + 20_000]]] * unit[right[b[j : j + 20_000]]]).sum(1) >= least for j in range(0, len(a), 20_000)])
            a, b = a[ok], b[ok]
        else:
            a, b = np.nonzero(may & (unit[rows] @ unit[right].T >= least))
        x, y = rows[a], right[b]
        counts += np.bincount(x, weight[y], n).astype("i8") + np.bincount(y, weight[x], n).astype("i8")
        found.append((x.astype("i4"), y.astype("i4")))
    moved = bool(found)
    while moved:
        before = label.copy()
        for x, y in found:
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
        label = label[label]
        moved = not np.array_equal(before, label)
    return counts, label


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", heads: int = HEADS, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """id_col, n_links, component_id, kept of each row."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = "<f4" if src.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"  # vectors move as they came

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = usable(b.column(1))
            raw = [None if x is None else (x + 0.0).astype(kind).tobytes() for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "digest", "v"])

    rows = src.mapInArrow(digested, "id long, digest binary, v binary")
    members = written(rows.select("id", "digest"), "members")
    # Equal vectors once; a class has a number, fixed when it is written.
    grouped = rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = written(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    total, longest = classes.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    limit = max(2, min(SAMPLE, SAMPLE_BYTES // max(longest or 1, 1)))
    sample = [np.frombuffer(r["v"], kind).astype("f8") for r in classes.orderBy(F.xxhash64("digest"), "digest").limit(limit).select("v").collect()]
    points = Pivots(sample, pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(3 * total))))
    del sample

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = points.nearest([np.frombuffer(x.as_buffer(), kind).astype("f8") for x in b.column(2)], prefix)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype="i4") * prefix), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["class", "n", "v", "near"])

    index = written(classes.select("class", "n", "v").mapInArrow(described, "class long, n long, v binary, near array<int>"), "index")
    entries = index.withColumn("p", F.explode(F.filter(F.slice("near", 1, heads), lambda x: x != -1)))
    # One number for each pivot.
    long = {r["p"]: -(-r["size"] // block) for r in entries.groupBy("p").agg(F.count("*").alias("size")).filter(F.col("size") > block).collect()}
    blocks = F.coalesce(*[F.when(F.col("p") == p, F.lit(k)) for p, k in sorted(long.items())], F.lit(1)) if len(long) <= 64 else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in sorted(long) for x in (p, long[p])]), "p"), F.lit(1))
    placed = entries.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("b")).alias("i"), F.greatest(j, F.col("b")).alias("j"), F.when(j < F.col("b"), 1).otherwise(0).alias("side")))
    dealt = placed.select("class", "n", "p", "near", "v", F.explode(cells).alias("cell")).select("p", "cell.i", "cell.j", "cell.side", "class", "n", "near", "v")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            if len(t) < 2:
                return
            names = t["class"].to_numpy()
            unit = _unit(np.array([np.frombuffer(x.as_buffer(), kind) for x in t["v"]], "f8"))
            near = t["near"].combine_chunks().flatten().to_numpy().reshape(len(names), -1)
            counts, label = cell_links(unit, t["n"].to_numpy(), near, t["side"].to_numpy(), now[0], now[1] == now[2], least, heads, shared)
            hit = np.flatnonzero(counts)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(names[hit]), pa.array(counts[hit]), pa.array(names[label[hit]])], names=["class", "links", "root"])

        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                key = tuple(keys[i].tolist())
                if key != now:
                    if held:
                        yield from out()
                    held, now = [], key
                held.append(b.slice(i, j - i))
        if held:
            yield from out()

    links = written(dealt.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j", "class").mapInArrow(linked, "class long, links long, root long"), "links")
    dropped(index)
    roots = connected(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    # Classes without a link to another need no join on their component.
    apart = classes.select("class", "digest", "id", "n").join(roots, F.col("class") == F.col("node"), "left").select("class", "digest", "id", "n", "root")
    named = written(apart, "rooted")
    smallest = named.filter("root is not null").groupBy("root").agg(F.min("id").alias("component"))
    counts = links.groupBy("class").agg(F.sum("links").alias("links"))
    joined = named.filter("root is not null").join(smallest, "root").join(counts, "class", "left").select("digest", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    done = joined.unionAll(named.filter("root is null").select("digest", F.col("id").alias("component"), (F.col("n") - 1).alias("links")))
    own = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    return members.join(done, "digest", "left").select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
