"""Predictions against truth: joins that lose nothing, confusion, metrics, matching of events.

Rejected (null or below threshold), unknown and missing predictions stay in the denominators.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = -1


def vocabulary(labels: DataFrame, label: str) -> DataFrame:
    """Distinct labels in order, numbered from 0."""
    names = labels.select(F.col(label).alias("label")).filter("label IS NOT NULL AND label <> ''").distinct()
    return names.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("label_id"))


def with_ids(rows: DataFrame, label: str, vocab: DataFrame, out: str) -> DataFrame:
    """Adds the number of a label; -1 where it isn't in the vocabulary."""
    v = vocab.select(F.col("label").alias("_l"), F.col("label_id").alias("_i"))
    return rows.join(v, F.col(label) == F.col("_l"), "left").withColumn(out, F.coalesce("_i", F.lit(UNKNOWN))).drop("_l", "_i")


def first_predictions(predictions: DataFrame, key: str, order: str) -> DataFrame:
    """The first prediction of each observation, and how many there were."""
    w = Window.partitionBy(key)
    return predictions.withColumn("n_predictions", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(order))).filter("_r = 1").drop("_r")


def align(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every observation of truth, with its prediction or -1 and whether one is missing."""
    joined = truth.join(predictions, key, "left")
    return joined.withColumn("is_missing", F.col("predicted").isNull()).withColumn("predicted", F.coalesce("predicted", F.lit(UNKNOWN)))


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def confusion(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return pairs.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def by_class(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """label, tp, fp, fn, tn from a confusion table; classes: label. All small: at most classes squared."""
    total = counts.agg(F.sum("n").alias("total"))
    tp = counts.filter("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    rows = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    cols = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    joined = classes.join(tp, "label", "left").join(rows, "label", "left").join(cols, "label", "left").fillna(0, ["tp", "support", "n_predicted"]).join(F.broadcast(total))
    return joined.select("label", "support", "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), (F.col("total") - F.col("support") - F.col("n_predicted") + F.col("tp")).alias("tn"))


def rates(classes: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, fpr; 0 where undefined."""
    div = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1e-12))).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = classes.withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn)).withColumn("fpr", div(fp, fp + tn))
    return out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(classes: DataFrame) -> DataFrame:
    """One row: accuracy over all observations, macro precision, recall, F1, FPR, the largest FPR of a class, and the smallest slack to the targets."""
    m = rates(classes).agg(
        F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg("fpr"), 6).alias("macro_fpr"), F.round(F.max("fpr"), 6).alias("max_fpr"), F.count("*").alias("n_classes"),
    )
    return m.withColumn("slack", F.round(slack(F.col("accuracy"), F.col("macro_precision"), F.col("macro_recall"), F.col("max_fpr")), 6))


#: What accuracy, precision and recall must reach, and what no class's FPR may pass.
TARGETS = {"accuracy": 0.95, "precision": 0.95, "recall": 0.98, "max_fpr": 0.05}


def slack(accuracy: Column, precision: Column, recall: Column, max_fpr: Column) -> Column:
    return F.least(accuracy - TARGETS["accuracy"], precision - TARGETS["precision"], recall - TARGETS["recall"], TARGETS["max_fpr"] - max_fpr)


def thresholds(pairs: DataFrame, values: list[float]) -> DataFrame:
    """Accuracy and share of rejects at each threshold of confidence; rejects count as wrong. pairs: truth, predicted, confidence."""
    aggs = []
    for i, t in enumerate(values):
        ok = F.col("confidence") >= t
        aggs += [F.count_if(ok & (F.col("truth") == F.col("predicted"))).alias(f"ok{i}"), F.count_if(~ok).alias(f"no{i}")]
    one = pairs.agg(F.count("*").alias("n"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"ok{i}").alias("ok"), F.col(f"no{i}").alias("rejected")) for i, t in enumerate(values)])).alias("x")
    return one.select("n", rows).select("x.threshold", F.round(F.col("x.ok") / F.col("n"), 6).alias("accuracy"), F.round(F.col("x.rejected") / F.col("n"), 6).alias("rejected_rate"))


def near_pairs(predicted: DataFrame, truth: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """Pairs of events (t) of equal keys at most tolerance apart: joined on time buckets of that width and their neighbours, not by comparing all."""
    p = predicted.withColumn("_b", F.explode(F.array(*[F.floor(F.col("t") / tolerance) + d for d in (-1, 0, 1)])))
    q = truth.withColumn("_b", F.floor(F.col("t") / tolerance)).withColumnRenamed("t", "truth_t")
    return p.join(q, [*keys, "_b"]).filter(F.abs(F.col("t") - F.col("truth_t")) <= tolerance).drop("_b")


def connected_runs(pairs: DataFrame, keys: list[str], time: str, tolerance: float) -> DataFrame:
    """Adds run: pairs whose times are further apart than any two that share an event can be are in different runs."""
    w = Window.partitionBy(*keys).orderBy(time)
    cut = (F.col(time) - F.lag(time).over(w)) > 2 * tolerance
    return pairs.withColumn("run", F.sum(F.coalesce(cut, F.lit(True)).cast("int")).over(w))


def match(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A largest set of pairs (predicted_id, truth_id) in which each id occurs once, within keys, by augmenting paths.

    Pairs are events close in time, so they fall apart into many small connected runs; where `run` is a column of pairs (connected_runs) it is a key too.
    """

    def augment(pdf: pd.DataFrame) -> pd.DataFrame:
        options: dict = {}
        for p, t in sorted(zip(pdf["predicted_id"], pdf["truth_id"], strict=True)):
            options.setdefault(p, []).append(t)
        taken: dict = {}
        mine: dict = {}  # what a prediction has, as taken says who has a truth event
        for start in options:
            # Breadth first: how each truth event can be reached by freeing others.
            came: dict = {}
            queue = [start]
            free = None
            while queue and free is None:
                p = queue.pop(0)
                for t in options[p]:
                    if t not in came:
                        came[t] = p
                        if t not in taken:
                            free = t
                            break
                        queue.append(taken[t])
            while free is not None:
                p = came[free]
                before = mine.get(p)
                taken[free], mine[p] = p, free
                free = before if p != start else None
        rows = [(p, t) for t, p in taken.items()]
        out = pd.DataFrame(rows, columns=["predicted_id", "truth_id"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    fields = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    p, t = (pairs.schema[c].dataType.simpleString() for c in ("predicted_id", "truth_id"))
    return pairs.select(*keys, "predicted_id", "truth_id").groupBy(*keys).applyInPandas(augment, f"{fields}, predicted_id {p}, truth_id {t}")


def kinds(aligned: DataFrame) -> DataFrame:
    """Why observations are wrong: no prediction, an unknown one, or another class."""
    kind = F.when(F.col("is_missing"), "unpaired_truth").when(F.col("predicted") == UNKNOWN, "miss_unknown").when(F.col("predicted") != F.col("truth"), "confusion")
    return aligned.withColumn("kind", kind).filter("kind IS NOT NULL")


def feed_lookup(rows: DataFrame, feed: DataFrame) -> DataFrame:
    """label of the exact address, else of its /24 net, else null; the first row of the feed wins. rows: ip_u32; feed: ip_u32, label, row."""
    from netloom.functions.exprs import slash24

    exact = feed.groupBy("ip_u32").agg(F.min_by("label", "row").alias("exact"))
    net = feed.groupBy(slash24(F.col("ip_u32")).alias("net24")).agg(F.min_by("label", "row").alias("by_net"))
    return rows.withColumn("net24", slash24(F.col("ip_u32"))).join(exact, "ip_u32", "left").join(net, "net24", "left").withColumn("feed_label", F.coalesce("exact", "by_net"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Differences of two long tables: rows that one side lacks, and values that differ."""
    return a.select(*keys, F.col(value).alias("left")).join(b.select(*keys, F.col(value).alias("right")), keys, "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def required_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every left row with its right one; a row without one is an error that names its key."""
    marked = right.withColumn("_there", F.lit(True))
    lacking = F.raise_error(F.concat(F.lit("no match for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("boolean")
    return left.join(marked, keys, "left").withColumn("_there", F.when(F.col("_there").isNull(), lacking).otherwise(F.col("_there"))).filter("_there").drop("_there")


def merged(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Tables joined by keys; columns that several have get the table's name as a suffix."""
    seen: dict[str, int] = {}
    for t in tables.values():
        for c in t.columns:
            seen[c] = seen.get(c, 0) + (c not in keys)
    out = None
    for name, t in tables.items():
        own = t.select(*[F.col(c).alias(c if c in keys or seen[c] < 2 else f"{c}_{name}") for c in t.columns])
        out = own if out is None else out.join(own, keys)
    return out


def endpoints_of(sessions: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys and remote endpoint of the sessions that are asked for. wanted: keys, a row an observation."""
    return sessions.join(wanted.select(*keys).distinct(), keys, "left_semi").select(*keys, "remote_ip")
