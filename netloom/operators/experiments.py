"""What experiments do around models: rankings and subsets of features, quotas and split plans, thresholds, folds by capture, gates, sealed tests.

Inputs of the functions that work in the driver are small by nature: a row a feature, a class, a file or a candidate.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ranking import seeded

#: What a result must reach.
TARGETS = {"accuracy": 0.95, "macro_precision": 0.95, "macro_recall": 0.98, "max_fpr": 0.05}
#: Weights of the mean, worst and pooled score, of support and of deviation.
OBJECTIVES = {"consensus_mean": (1, 0, 0, 0, 0), "robust_worst": (0.42, 0.25, 0.18, 0.20, -0.05), "robust_stable": (0.35, 0.15, 0.20, 0.35, -0.05), "pooled": (0, 0, 1, 0, 0)}


def objective(variant: str, boost: float = 0.0) -> Column:
    """Of columns n_mean, n_min, n_pooled, n_support, n_std (from 0 to 1) and in_sequence."""
    weights = dict(zip(("n_mean", "n_min", "n_pooled", "n_support", "n_std"), OBJECTIVES[variant], strict=True))
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * w
    return total + F.col("in_sequence").cast("double") * boost if boost else total


def ranked(table: DataFrame, variant: str, boost: float = 0.0) -> DataFrame:
    """The table with objective and place; ties by support, then mean score, then name."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("objective", 9)), F.desc("support"), F.desc(F.round("mean", 9)), "feature")  # a row a feature
    return table.withColumn("objective", objective(variant, boost)).withColumn("place", F.row_number().over(w))


def hybrid(table: DataFrame, core: int, total: int = 64) -> DataFrame:
    """feature, place: first the stable features that at least two data sets support (filled up with others), then the pooled ranking."""
    from pyspark.sql import Window

    stable = ranked(table, "robust_stable").withColumn("weak", (F.col("support") < 2).cast("int"))
    first = stable.orderBy("weak", "place").limit(core).select("feature", F.lit(0).alias("part"), (F.col("weak") * 1_000_000 + F.col("place")).alias("at"))
    rest = ranked(table, "pooled").join(first.select("feature"), "feature", "left_anti").select("feature", F.lit(1).alias("part"), F.col("place").alias("at"))
    both = first.unionAll(rest).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("part", "at")))
    return both.filter(F.col("place") <= total).select("feature", "place")


def quotas(available: int, test: int = 100, validation: int = 100, least: int = 48) -> tuple[int, int, int]:
    """Rows for training, validation and test: 20 and 22 % for the latter two, within bounds; an error if too few are left to learn from."""
    t, v = min(test, max(30, round(available * 0.22))), min(validation, max(20, round(available * 0.20)))
    if available - t - v < least:
        raise ValueError(f"{available} rows leave {available - t - v} to learn from")
    return available - t - v, v, t


def split_plan(observations: DataFrame, target: int, seed: str, label: str = "label", file: str = "file", id_: str = "observation_id") -> DataFrame:
    """label, observation_id, file, split, mode. Files of their own for validation and test where three files have enough rows; a test file of its own where one file covers the rest; else all files mixed. Rows come in seeded order, from files in turn.

    Which way a class goes is decided from its files' counts, one row a file; rows are then numbered within files on executors.
    """
    from pyspark.sql import Window

    train, validation, test = target * 3 // 5, target // 5, target // 5
    plans = []
    by: dict = {}
    for r in observations.groupBy(label, file).agg(F.count_distinct(id_).alias("n")).collect():
        by.setdefault(r[label], []).append((-r["n"], r[file]))
    for cls in sorted(by):
        files = [(f, -n) for n, f in sorted(by[cls])]
        big = [f for f, n in files if n >= test]
        others = [f for f, _ in files if len(big) < 3 or f not in big[1:3]]
        if len(big) >= 3 and sum(n for f, n in files if f in others) >= train:
            plans += [(cls, f, "train", 0, train, "capture_group") for f in others] + [(cls, big[1], "validation", 0, validation, "capture_group"), (cls, big[2], "test", 0, test, "capture_group")]
        elif files[0][1] >= train + validation and any(n >= test for _, n in files[1:]):
            other = next(f for f, n in files[1:] if n >= test)
            plans += [(cls, files[0][0], "train", 0, train, "capture_group_test_only"), (cls, files[0][0], "validation", train, validation, "capture_group_test_only"), (cls, other, "test", 0, test, "capture_group_test_only")]
        else:
            plans += [(cls, f, s, at, n, "session_level") for f, _ in files for s, at, n in (("train", 0, train), ("validation", train, validation), ("test", train + validation, test))]
    plan = observations.sparkSession.createDataFrame(plans, "label string, file string, split string, begins long, take long, mode string")
    rows = observations.select(F.col(label).cast("string").alias("label"), F.col(file).alias("file"), F.col(id_).alias("observation_id")).distinct()
    inner = F.row_number().over(Window.partitionBy("label", "file").orderBy(seeded(seed, F.col("label"), F.col("file"), F.col("observation_id"))))
    turns = rows.withColumn("turn", inner).join(F.broadcast(plan), ["label", "file"])  # a few rows a file
    place = F.row_number().over(Window.partitionBy("label", "split").orderBy("turn", "file"))
    return turns.withColumn("at", place - 1).filter((F.col("at") >= F.col("begins")) & (F.col("at") < F.col("begins") + F.col("take"))).select("label", "observation_id", "file", "split", "mode")


def no_leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """The rows, if no key occurs in several splits; an error that names one otherwise."""
    from netloom.operators.ranking import leaks

    bad = leaks(rows, key, split).orderBy(key).first()
    if bad is not None:
        raise ValueError(f"{key} {bad[key]} is in {bad['splits']}")
    return rows


def tiers(survey: Callable[[int | None], DataFrame], caps: list[int | None], least: int) -> tuple[DataFrame, list[dict]]:
    """The first survey (rows: file, qualified, capped) with enough qualified sessions, or that read all files to the end; and what each tier found."""
    trace: list[dict] = []
    rows = None
    for cap in caps:
        rows = survey(cap)
        t = rows.agg(F.sum("qualified").alias("qualified"), F.bool_or("capped").alias("capped")).first()
        trace.append({"cap": cap, "qualified": t["qualified"] or 0, "capped": bool(t["capped"])})
        if trace[-1]["qualified"] >= least or not trace[-1]["capped"]:
            break
    return rows, trace


def leaderboard(results: DataFrame, n: int = 3) -> DataFrame:
    """The n best candidates: those that meet all targets first, then macro recall, then accuracy, then name. results: candidate and the metrics of TARGETS."""
    met = (F.col("accuracy") >= TARGETS["accuracy"]) & (F.col("macro_precision") >= TARGETS["macro_precision"]) & (F.col("macro_recall") >= TARGETS["macro_recall"]) & (F.col("max_fpr") <= TARGETS["max_fpr"])
    return results.withColumn("meets", met).orderBy(F.desc("meets"), F.desc("macro_recall"), F.desc("accuracy"), "candidate").limit(n)


def meets(metrics: dict) -> bool:
    return all(metrics[k] <= v if k == "max_fpr" else metrics[k] >= v for k, v in TARGETS.items())


def sealed(folder: str, config: dict, run: Callable[[], dict]) -> dict:
    """Runs a test once: gate.json must be there and hold the configuration's hash, result.json must not."""
    from netloom.sources.results import exists, read_text, write_text

    seal = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    if exists(f"{folder}/result.json"):
        raise ValueError("this test has been run")
    if not exists(f"{folder}/gate.json") or json.loads(read_text(f"{folder}/gate.json")).get("sha256") != seal:
        raise ValueError("no gate for this configuration")
    result = run() | {"sha256": seal}
    write_text(f"{folder}/result.json", json.dumps(result))
    return result


def opened(folder: str, config: dict) -> str:
    """Writes the gate of a configuration; returns its hash."""
    from netloom.sources.results import write_text

    seal = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    write_text(f"{folder}/gate.json", json.dumps({"sha256": seal}))
    return seal


def tune_bias(rows: DataFrame, classes: int, label: str = "label", step: float = 0.15, margin: float = 0.005, rounds: int = 6) -> list[float]:
    """An addition to each class's log probability that raises macro recall on out-of-fold rows (label, proba), as long as precision and false positives keep their targets.

    One class at a time is moved up or down; all candidates of a round are counted in one pass over the rows, of which the driver gets confusion counts.
    """
    bias = [0.0] * classes
    best = -1.0

    def scores(candidates: list[list[float]]) -> list[float]:
        logs = F.transform("proba", lambda p: F.log(F.greatest(p, F.lit(1e-12))))
        picks = []
        for b in candidates:
            moved = F.zip_with(logs, F.array(*[F.lit(float(x)) for x in b]), lambda p, x: p + x)
            picks.append((F.array_position(moved, F.array_max(moved)) - 1).cast("int"))
        counts = rows.select(F.col(label).cast("int").alias("y"), F.posexplode(F.array(*picks)).alias("k", "p")).groupBy("k", "y", "p").agg(F.count("*").alias("n")).collect()
        out = []
        for k in range(len(candidates)):
            m = np.zeros((classes, classes))
            for r in counts:
                if r["k"] == k:
                    m[r["y"], r["p"]] = r["n"]
            tp, fp, fn = np.diag(m), m.sum(0) - np.diag(m), m.sum(1) - np.diag(m)
            tn = m.sum() - tp - fp - fn
            share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1e-12), 0.0)
            ok = share(tp, tp + fp).mean() >= TARGETS["macro_precision"] + margin and share(fp, fp + tn).max() <= TARGETS["max_fpr"] - margin
            out.append(float(share(tp, tp + fn).mean()) if ok else -1.0)
        return out

    best = scores([bias])[0]
    for _ in range(rounds):
        candidates = [[x + d * step * (i == c) for i, x in enumerate(bias)] for c in range(classes) for d in (1, -1)]
        found = scores(candidates)
        top = int(np.argmax(found))
        if found[top] <= best + 1e-9:
            break
        best, bias = found[top], candidates[top]
    return bias


def by_capture(rows: DataFrame, predictions: DataFrame, capture: str = "capture", label: str = "label", id_: str = "id") -> DataFrame:
    """Of predictions (id, predicted) that were made for a capture without it: by class, captures, mean accuracy by capture, captures whose most frequent prediction is wrong."""
    j = rows.select(F.col(id_).alias("id"), F.col(capture).alias("capture"), F.col(label).alias("label")).join(predictions, "id")
    counts = j.groupBy("capture", "label", "predicted").agg(F.count("*").alias("n"))
    caps = counts.groupBy("capture", "label").agg((F.sum(F.when(F.col("predicted") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.max_by("predicted", F.struct("n", -F.col("predicted"))).alias("majority"))
    return caps.groupBy("label").agg(F.count("*").alias("n_captures"), F.avg("accuracy").alias("mean_accuracy"), F.count_if(F.col("majority") != F.col("label")).alias("majority_wrong"))


def leave_one_out(rows: DataFrame, capture: str, run: Callable[[DataFrame, DataFrame], DataFrame], least_train: int = 20, least_test: int = 3) -> DataFrame:
    """Predictions of each capture by what run(train, test) makes of all others; captures with too few rows are left out."""
    sizes = {r[capture]: r["n"] for r in rows.groupBy(capture).agg(F.count("*").alias("n")).orderBy(capture).collect()}  # a row a capture, a model each
    total, out = sum(sizes.values()), None
    for c, n in sizes.items():
        if total - n >= least_train and n >= least_test:
            one = run(rows.filter(~F.col(capture).eqNullSafe(c)), rows.filter(F.col(capture).eqNullSafe(c)))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no capture has enough rows")
    return out


def transfer(rows: DataFrame, platform: str, run: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Predictions of each platform by a model of each other one, with both names (trained_on, tested_on)."""
    names = [r[0] for r in rows.select(platform).distinct().orderBy(platform).collect()]
    out = None
    for a in names:
        for b in names:
            if a != b:
                one = run(rows.filter(F.col(platform) == a), rows.filter(F.col(platform) == b)).withColumn("trained_on", F.lit(a)).withColumn("tested_on", F.lit(b))
                out = one if out is None else out.unionByName(one)
    return out


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def f_tail(f: float, k: float, rest: float) -> float:
    """Probability that an F value with k and rest degrees of freedom is larger."""
    return 1.0 if f <= 0 else _beta_share(rest / 2, k / 2, rest / (rest + k * f))


def effectiveness(scores: DataFrame, computable: set | None, consistent: set | None, supported: set | None) -> dict:
    """Whether each feature is effective: it can be computed and isn't constant, training and inference agree on it, it tells classes apart (p < 0.05), and rules can use it; without evidence for agreement or support it is pending. scores: feature, f, k (classes), n (rows) of selection.anova_f, a row a feature."""
    rows, good, pending = {}, [], []
    for r in scores.orderBy("feature").collect():
        f = r["feature"]
        p = f_tail(r["f"] or 0.0, r["k"] - 1, r["n"] - r["k"])
        known = {"computable": computable is None or f in computable, "consistent": None if consistent is None else f in consistent, "discriminative": p < 0.05, "supported": None if supported is None else f in supported, "p": p}
        if known["consistent"] is None or known["supported"] is None:
            pending.append(f)
        elif known["computable"] and known["consistent"] and known["discriminative"] and known["supported"]:
            good.append(f)
        rows[f] = known
    return {"all": list(rows), "effective": good, "pending": pending, "rate": len(good) / len(rows) if rows else 0.0, "rows": rows}


def accounting(published: list[str], effective: set, referenced: set, target: float = 0.80) -> dict:
    """How many published features are effective on validation rows, and how many a model uses."""
    e, r = sorted(set(published) & set(effective)), sorted(set(published) & set(referenced))
    n = max(len(published), 1)
    return {"A": len(published), "E": len(e), "R": len(r), "E_over_A": round(len(e) / n, 4), "R_over_A": round(len(r) / n, 4), "met": len(e) / n >= target}


def coral(source: DataFrame, target: DataFrame, features: list[str], ridge: float = 1.0) -> DataFrame:
    """source with features centred, whitened by their own covariance and coloured by the target's, and moved to the target's mean. Covariances are sums over rows; their matrices (features squared) are worked out in the driver."""

    def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
        r = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        c = np.zeros((len(features), len(features)))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"] or 0.0
        return np.array([r[f"m{i}"] or 0.0 for i in range(len(features))]), c + ridge * np.eye(len(features))

    def power(c: np.ndarray, p: float) -> np.ndarray:
        values, vectors = np.linalg.eigh(c)
        return vectors @ np.diag(np.maximum(values, 1e-12) ** p) @ vectors.T

    (m, c), (tm, tc) = moments(source), moments(target)
    a = power(c, -0.5) @ power(tc, 0.5)
    moved = [F.lit(float(tm[j])) + sum(((F.col(f) - float(m[i])) * float(a[i, j]) for i, f in enumerate(features)), F.lit(0.0)) for j in range(len(features))]
    return source.select(*[c for c in source.columns if c not in features], *[x.alias(f) for x, f in zip(moved, features, strict=True)])


def usable_rate(reviews: DataFrame) -> float:
    """Share of reviewed rules that were kept or modified (column decision); an error where nothing has been reviewed."""
    r = reviews.filter("decision IS NOT NULL AND decision <> ''").agg(F.count("*").alias("n"), F.count_if(F.col("decision").isin("keep", "modify")).alias("k")).first()
    if not r["n"]:
        raise ValueError("nothing has been reviewed")
    return r["k"] / r["n"]


def vote_grid(rows: DataFrame, sizes: list[int], thresholds: list[float], keys: list[str], order: str, positive: str, truth: str) -> DataFrame:
    """size, threshold, accuracy, recall of causal votes over the last `size` rows, positive where their share of positives is over the threshold. All settings in one pass."""
    from pyspark.sql import Window

    shares = {k: F.avg(F.col(positive).cast("double")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k - 1), 0)) for k in sizes}
    voted = rows.select(truth, *[x.alias(f"s{k}") for k, x in shares.items()])
    grid = F.array(*[F.struct(F.lit(k).alias("size"), F.lit(t).alias("threshold"), (F.col(f"s{k}") > t).alias("voted")) for k in sizes for t in thresholds])
    out = voted.select(F.col(truth).cast("boolean").alias("truth"), F.explode(grid).alias("g")).select("truth", "g.*")
    return out.groupBy("size", "threshold").agg(F.avg((F.col("voted") == F.col("truth")).cast("double")).alias("accuracy"), (F.count_if(F.col("voted") & F.col("truth")) / F.greatest(F.count_if("truth"), F.lit(1))).alias("recall"))
