"""Feature statistics and selection on a long matrix (id, label, feature, x), so that features are rows, not columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.order import numbered


def basic_filter(long: DataFrame, most_missing: float = 0.5, least_std: float = 1e-10) -> DataFrame:
    """feature, missing, std of features that are neither mostly missing nor constant."""
    s = long.groupBy("feature").agg(F.avg(F.col("x").isNull().cast("double")).alias("missing"), F.stddev_samp("x").alias("std"))
    return s.filter((F.col("missing") <= most_missing) & (F.coalesce("std", F.lit(0.0)) >= least_std))


def ranks(long: DataFrame) -> DataFrame:
    """Adds r: rank within the feature, ties at their mean. Rows are numbered by ranges, so few features are no few tasks."""
    n = numbered(long.filter("x IS NOT NULL"), ["feature"], ["x", "id"], "_i")
    # Equal values are neighbours: a value's rank is the mean of its first and last place.
    places = n.groupBy("feature", "x").agg(((F.min("_i") + F.max("_i")) / 2.0).alias("r"))
    return n.drop("_i").join(places, ["feature", "x"])


def products(long: DataFrame, value: str) -> DataFrame:
    """a <= b, n, and sums of p, q, p*p, q*q, p*q over rows of each two features. A row's features meet in the row; sums are taken before anything moves."""
    rows = long.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("feature", F.col(value).alias("x")))).alias("v"))
    met = F.transform("v", lambda x, i: F.transform(F.slice(F.col("v"), i + 1, F.size("v")), lambda y: F.struct(x["feature"].alias("a"), y["feature"].alias("b"), x["x"].alias("p"), y["x"].alias("q"))))
    pairs = rows.select(F.explode(F.flatten(met)).alias("z")).select("z.*")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("p", "q").alias("corr"), F.covar_samp("p", "q").alias("cov"))


def spearman(long: DataFrame, least: float = 0.0) -> DataFrame:
    """a < b, rho of features whose absolute rank correlation is over least."""
    return products(ranks(long), "r").filter("a < b").select("a", "b", F.col("corr").alias("rho")).filter(F.abs("rho") > least)


def anova_f(long: DataFrame) -> DataFrame:
    """feature, f: between-class over within-class variance, from sums by class."""
    g = long.groupBy("feature", "label").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    by = g.withColumn("grand", grand).groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return by.select("feature", F.when(F.col("within") > 0, (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).otherwise(0.0).alias("f"), "k", "n")


def binned(long: DataFrame, bins: int = 8) -> DataFrame:
    """Adds bin: equal-width bins between a feature's extremes."""
    ends = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    return long.join(ends, "feature").withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / width * bins), F.lit(bins - 1)))


def mutual_information(long: DataFrame, bins: int = 8) -> DataFrame:
    """feature, mi (natural) of its bins and the label."""
    c = binned(long, bins).groupBy("feature", "bin", "label").agg(F.count("*").alias("c"))
    f, fb, fl = Window.partitionBy("feature"), Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "label")
    p = c.withColumn("n", F.sum("c").over(f)).withColumn("cb", F.sum("c").over(fb)).withColumn("cl", F.sum("c").over(fl))
    return p.groupBy("feature").agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cb") * F.col("cl")))).alias("mi"))


def conditional_information(long: DataFrame, given: int, bins: int = 4) -> DataFrame:
    """feature, cmi: information about the label that a feature adds to another one's bins."""
    b = binned(long, bins)
    z = b.filter(F.col("feature") == given).select("id", F.col("bin").alias("z"))
    c = b.filter(F.col("feature") != given).join(z, "id").groupBy("feature", "z", "bin", "label").agg(F.count("*").alias("c"))
    w = lambda *k: F.sum("c").over(Window.partitionBy("feature", *k))
    p = c.withColumn("n", w()).withColumn("cz", w("z")).withColumn("cbz", w("z", "bin")).withColumn("clz", w("z", "label"))
    return p.groupBy("feature").agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("cz") / (F.col("cbz") * F.col("clz")))).alias("cmi"))


def discriminative_power(long: DataFrame) -> DataFrame:
    """feature, power: population variance of class means over the variance of all values."""
    total = long.groupBy("feature").agg(F.var_samp("x").alias("v"))
    means = long.groupBy("feature", "label").agg(F.avg("x").alias("m")).groupBy("feature").agg(F.var_pop("m").alias("vm"))
    return means.join(total, "feature").select("feature", (F.col("vm") / (F.col("v") + 1e-10)).alias("power"))


def scaled(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Scores from 0 to 1 by their extremes; 1 where all are equal. One row a feature."""
    ends = scores.agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    out = scores.join(F.broadcast(ends))
    for c in columns:
        lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        out = out.withColumn(c, F.when(hi - lo < 1e-10, 1.0).otherwise((F.col(c) - lo) / (hi - lo)))
    return out.select(*scores.columns)


def fused(a: DataFrame, b: DataFrame, weight: float = 0.6) -> DataFrame:
    """feature, score: weighted sum of two scaled scores (columns score)."""
    both = scaled(a.select("feature", F.col("score").alias("a")).join(b.select("feature", F.col("score").alias("b")), "feature"), ["a", "b"])
    return both.select("feature", (F.col("a") * weight + F.col("b") * (1 - weight)).alias("score"))


def greedy(scores: DataFrame, correlated: DataFrame, most: int = 30, least: int = 4) -> list:
    """Best features first, skipping those correlated to one taken before; if fewer than `least` stay, the best skipped ones too. Both tables have a row a feature (or pair of features)."""
    order = [r["feature"] for r in scores.orderBy(F.desc(F.round("score", 9)), "feature").collect()]
    near: dict = {}
    for r in correlated.select("a", "b").collect():
        near.setdefault(r["a"], set()).add(r["b"])
        near.setdefault(r["b"], set()).add(r["a"])
    taken: list = []
    for f in order:
        if len(taken) < most and not near.get(f, set()) & set(taken):
            taken.append(f)
    return taken + [f for f in order if f not in taken][: max(0, least - len(taken))]


def transform(rows: DataFrame, selected: list[str]) -> DataFrame:
    """The selected columns that there are, after those that describe the observation."""
    return rows.select(*[c for c in rows.columns if c.startswith("_")], *[c for c in selected if c in rows.columns])


def select(long: DataFrame, importances: DataFrame, most: int = 64, least: int = 4, correlated: float = 0.95, weight: float = 0.6) -> tuple[list, DataFrame]:
    """The whole selection: features that are neither mostly missing nor constant, scored by importance and mutual information, greedily without correlated ones; and all scores. importances: feature, score."""
    kept = long.join(F.broadcast(basic_filter(long).select("feature")), "feature")  # a row a feature
    scores = fused(importances, mutual_information(kept).select("feature", F.col("mi").alias("score")), weight)
    return greedy(scores, spearman(kept, correlated), most, least), scores


def aggregated(long: DataFrame, by: list[str]) -> DataFrame:
    """by, feature, and mean, population deviation, median, sum and count of a matrix's columns."""
    return long.groupBy(*by, "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.percentile("x", 0.5).alias("median"), F.sum("x").alias("sum"), F.count("x").alias("n"))
