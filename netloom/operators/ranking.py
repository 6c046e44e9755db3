"""Splits, quotas and ranked picks, with an order that depends only on ids and a seed (by md5, the same in any engine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.order import numbered


def seeded(seed: str, *ids: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[i.cast("string") for i in ids]))


def group_split(rows: DataFrame, group: str, seed: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Adds split: whole groups, in seeded order, to train, validation and test by their number."""
    g = numbered(rows.select(F.col(group).alias("_g")).distinct().withColumn("_o", seeded(seed, F.col("_g"))), [], ["_o", "_g"], "_i", "_n")
    upto = lambda share: F.bround(F.col("_n") * share)  # noqa: E731  halves to even
    named = g.select("_g", F.when(F.col("_i") <= upto(train), "train").when(F.col("_i") <= upto(train + validation), "validation").otherwise("test").alias("split"))
    return rows.join(named, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def stratified_split(rows: DataFrame, stratum: str, id_: str, seed: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Adds split, by the seeded place of a row within its stratum, however few strata there are."""
    r = numbered(rows.withColumn("_o", seeded(seed, F.col(stratum), F.col(id_))), [stratum], ["_o", id_], "_i", "_n")
    share = (F.col("_i") - 1) / F.col("_n")
    return r.withColumn("split", F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")).drop("_o", "_i", "_n")


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in several splits; empty if the splits are clean."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.array_join(F.sort_array(F.collect_set(split)), "+").alias("splits")).filter("n_splits > 1")


def round_robin(rows: DataFrame, pool: str, order: list[str], n: int) -> DataFrame:
    """n rows in turn from the pools (first of each pool, then second ones...)."""
    r = rows.withColumn("turn", F.row_number().over(Window.partitionBy(pool).orderBy(*order)))
    return r.orderBy("turn", pool).limit(n)


def heads(rows: DataFrame, stratum: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter(F.col("place") <= n)


def top_support(scores: DataFrame, k: int) -> DataFrame:
    """Of scores by dataset and feature: how many datasets have a feature among their best k; mean, population deviation, extremes."""
    r = scores.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(F.round("score", 9)), "feature")))
    return r.groupBy("feature").agg(F.count_if(F.col("place") <= k).alias("support"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))


def jaccard(scores: DataFrame, k: int) -> DataFrame:
    """a < b, jaccard of two datasets' best k features (one short list a dataset)."""
    r = scores.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(F.round("score", 9)), "feature"))).filter(F.col("place") <= k)
    sets = r.groupBy("dataset").agg(F.collect_set("feature").alias("s"))
    p = sets.select(F.col("dataset").alias("a"), F.col("s").alias("x")).join(sets.select(F.col("dataset").alias("b"), F.col("s").alias("y")), F.col("a") < F.col("b"))
    return p.select("a", "b", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


def oversample(rows: DataFrame, label: str, id_: str) -> DataFrame:
    """Rows of classes below the median size are repeated until they reach it; adds copy (0 for the originals)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    median = sizes.agg(F.percentile("_n", 0.5)).first()[0]  # a number a class
    j = numbered(rows, [label], [id_], "_p", "_n")
    extra = F.greatest(F.floor((F.lit(median) - F.col("_p")) / F.col("_n")), F.lit(0))
    return j.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), extra.cast("bigint")))).drop("_n", "_p")


def shuffled(rows: DataFrame, cls: str, file: str, id_: str, seed: str) -> DataFrame:
    """Distinct observations with their place in their file, in an order that depends on the seed, class, file and id alone."""
    d = rows.select(cls, file, id_).distinct().withColumn("_o", seeded(seed, F.col(cls), F.col(file), F.col(id_)))
    return numbered(d, [cls, file], ["_o", id_], "place").drop("_o")
