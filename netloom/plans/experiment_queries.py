"""Queries on models and on what experiments do around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import experiments as E
from netloom.operators import models as M
from netloom.operators import selection as L
from netloom.operators import sessions as S
from netloom.operators import windows as W
from netloom.plans import binding as B
from netloom.plans import matrix_queries as MQ
from netloom.plans import window_queries as WQ
from netloom.plans.flow_queries import KEYS

QUERIES: dict = {}
ORACLES: dict = {}
FEATURES = [f"f{i}" for i in range(64)]


def _rows(spark, sf_dir):
    """Vectors with labels numbered from 0."""
    w = B.wide(spark, sf_dir)
    names = [r[0] for r in w.select("label").distinct().orderBy("label").collect()]  # a row a class
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label")) - 1
    return w.withColumn("y", number.cast("int")), names


def q_classifier_match(spark, sf_dir):
    """A classifier learnt from four fifths of the rows decides on the rest where it is sure, rules where not."""
    rows, names = _rows(spark, sf_dir)
    train, rest = rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0")
    proba = M.probabilities(M.fit(train, FEATURES, "y", "rf"), rest, FEATURES, len(names))
    labels = {i: f"app{n}_kind{n}" for i, n in enumerate(names)}
    return M.matched(proba, labels, 0.3, MQ.RULES).select("id", "match.rule_id", "match.label", "match.app", "match.behavior", "match.source", F.round("match.confidence", 6).alias("confidence"))


QUERIES["q_classifier_match"] = q_classifier_match


def q_out_of_fold(spark, sf_dir):
    """Out-of-fold decisions of every row, with a bias by class tuned on them."""
    rows, names = _rows(spark, sf_dir)
    oof = M.out_of_fold(rows, FEATURES, "y", "id", "lr", len(names), folds=3).select("id", "y", "fold", "proba")
    bias = E.tune_bias(oof, len(names), "y")
    moved = F.zip_with(F.transform("proba", lambda p: F.log(F.greatest(p, F.lit(1e-12)))), F.array(*[F.lit(b) for b in bias]), lambda p, b: p + b)
    return oof.select("id", "fold", F.col("y").alias("truth"), M.argmax(F.col("proba")).alias("predicted"), M.argmax(moved).alias("predicted_with_bias"))


QUERIES["q_out_of_fold"] = q_out_of_fold


def q_latent_domains(spark, sf_dir):
    """A gate over two domains of classes, and an expert for each."""
    rows, names = _rows(spark, sf_dir)
    out = M.latent_domains(rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0"), FEATURES, "y", [i % 2 for i in range(len(names))], "lr")
    return out.select("id", F.col("y").alias("truth"), M.argmax(F.col("proba")).alias("predicted"), F.round(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


QUERIES["q_latent_domains"] = q_latent_domains


def _table(spark, sf_dir):
    """Scores by feature, scaled, as rankings use them."""
    s = MQ._scores(spark, sf_dir)
    from netloom.operators import ranking as K

    t = K.top_support(s, 20).withColumn("pooled", F.col("mean")).withColumn("in_sequence", F.col("feature") % 3 == 0)
    names = {"n_mean": "mean", "n_min": "min", "n_pooled": "pooled", "n_support": "support", "n_std": "std"}
    return L.scaled(t.select("*", *[F.col(c).cast("double").alias(n) for n, c in names.items()]), list(names))


_N = ", ".join(f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-10 THEN 1.0::DOUBLE ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS {n}" for n, c in (("n_mean", "mean"), ("n_min", "mn"), ("n_pooled", "mean"), ("n_support", "support::DOUBLE"), ("n_std", "std")))
TABLE_SQL = f"{MQ.SCORE_SQL}, tb AS (SELECT feature, count_if(place <= 20) AS support, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS mn FROM rk GROUP BY feature), nt AS (SELECT *, {_N}, feature % 3 = 0 AS in_sequence FROM tb)"
_OBJ = {"robust_stable": "0.35 * n_mean + 0.15 * n_min + 0.20 * n_pooled + 0.35 * n_support - 0.05 * n_std", "pooled": "n_pooled"}
_PLACE = lambda o: f"row_number() OVER (ORDER BY round({o}, 9) DESC, support DESC, round(mean, 9) DESC, feature)"


def q_rank_variants(spark, sf_dir):
    r = E.ranked(_table(spark, sf_dir), "robust_stable", 0.25)
    return r.select("feature", "place", F.round("objective", 6).alias("objective"), "support")


QUERIES["q_rank_variants"] = q_rank_variants
_BOOST = f"{_OBJ['robust_stable']} + 0.25 * CASE WHEN in_sequence THEN 1 ELSE 0 END"
ORACLES["q_rank_variants"] = f"WITH {TABLE_SQL} SELECT feature, {_PLACE(_BOOST)} AS place, round({_BOOST}, 6) AS objective, support FROM nt"


def q_hybrid_subset(spark, sf_dir):
    return E.hybrid(_table(spark, sf_dir), 8, 24)


QUERIES["q_hybrid_subset"] = q_hybrid_subset
ORACLES["q_hybrid_subset"] = f"""WITH {TABLE_SQL}, s AS (SELECT feature, CASE WHEN support < 2 THEN 1 ELSE 0 END AS weak, {_PLACE(_OBJ['robust_stable'])} AS sp, {_PLACE(_OBJ['pooled'])} AS pp FROM nt), c AS (SELECT *, row_number() OVER (ORDER BY weak, sp) AS cp FROM s),
o AS (SELECT feature, row_number() OVER (ORDER BY CASE WHEN cp <= 8 THEN 0 ELSE 1 END, CASE WHEN cp <= 8 THEN cp ELSE pp END) AS place FROM c) SELECT feature, place FROM o WHERE place <= 24"""


def q_split_plan(spark, sf_dir):
    """Observations of five classes from files of very different sizes, dealt out to training, validation and test."""
    e = B.table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id") % 5).alias("label"), F.concat(F.lit("file"), F.floor(F.sqrt(F.col("user_id") % 97))).alias("file"), F.concat(F.lit("o"), F.col("event_id")).alias("observation_id"))
    return E.no_leaks(E.split_plan(e, 100, "s7"), "observation_id")


QUERIES["q_split_plan"] = q_split_plan


def q_leave_one_capture(spark, sf_dir):
    """By class: captures, their mean accuracy, captures whose most frequent prediction is wrong; predictions are made by a rule of ids."""
    rows = B.wide(spark, sf_dir).select("id", F.col("label").cast("int").alias("label"), (F.col("id") % 11).alias("capture"))
    predictions = rows.select("id", F.when(F.col("id") % 3 == 0, (F.col("label") + 1) % 5).otherwise(F.col("label")).cast("int").alias("predicted"))
    return E.by_capture(rows, predictions).select("label", "n_captures", F.round("mean_accuracy", 6).alias("mean_accuracy"), "majority_wrong")


QUERIES["q_leave_one_capture"] = q_leave_one_capture
ORACLES["q_leave_one_capture"] = """WITH r AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, vec_id % 11 AS capture, CASE WHEN vec_id % 3 = 0 THEN (CAST(label AS INTEGER) + 1) % 5 ELSE CAST(label AS INTEGER) END AS predicted FROM embeddings),
c AS (SELECT capture, label, predicted, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT capture, label, sum(CASE WHEN predicted = label THEN n ELSE 0 END) / sum(n) AS a, arg_max(predicted, n * 1000 - predicted) AS m FROM c GROUP BY ALL)
SELECT label, count(*) AS n_captures, round(avg(a), 6) AS mean_accuracy, count_if(m <> label) AS majority_wrong FROM k GROUP BY label"""


def q_vote_grid(spark, sf_dir):
    """Causal votes over windows at every size and threshold, in one pass."""
    t = WQ._labelled(spark, sf_dir).withColumn("positive", (F.col("label") == "voice").cast("int")).withColumn("truth", F.col("k") % 2 == 0)
    g = E.vote_grid(t, [1, 2, 3], [0.3, 0.5], S.SESSION, "k", "positive", "truth")
    return g.select("size", "threshold", F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"))


QUERIES["q_vote_grid"] = q_vote_grid
_VOTE = " UNION ALL ".join(f"SELECT {k} AS size, {t}::DOUBLE AS threshold, avg(CASE WHEN positive = 1 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY k ROWS {k - 1} PRECEDING) > {t} AS voted, truth FROM p" for k in (1, 2, 3) for t in (0.3, 0.5))
ORACLES["q_vote_grid"] = f"WITH {WQ.LABEL_SQL}, p AS (SELECT {KEYS}, k, CASE WHEN label = 'voice' THEN 1 ELSE 0 END AS positive, k % 2 = 0 AS truth FROM lw), v AS ({_VOTE}) SELECT size, threshold, round(avg(CASE WHEN voted = truth THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(count_if(voted AND truth) / greatest(count_if(truth), 1), 6) AS recall FROM v GROUP BY ALL"


def q_window_predictions(spark, sf_dir):
    """Behaviour windows to predictions: missing figures become the sentinel, the first rule that matches decides, each row says which window it is."""
    from netloom.operators import profiles as P
    from netloom.operators import rules as R

    rules = [{"rule_id": "w0", "label": "burst", "priority": 0, "confidence": 0.9, "conditions": [{"feature": "rel01_gap", "op": ">=", "value": 0}, {"feature": "n_seg", "op": ">=", "value": 3}]}, {"rule_id": "w1", "label": "alone", "priority": 1, "confidence": 0.8, "conditions": [{"feature": "seg1_pkt", "op": "<=", "value": -1}]}]
    w = W.behavior41(W.sliding(WQ._six(spark, sf_dir), WQ.SIZE, WQ.STEP), WQ.SIZE, WQ.SEGMENT, WQ.WIN)
    rows = P.matrix(w.select(F.col("capture_id").alias("_capture_id"), F.col("k").alias("_k"), *R.required_features(rules)), R.required_features(rules), missing=-1.0)
    return R.first_match(rows, rules, 0.5).select(F.concat(F.lit("cap"), "_capture_id", F.lit(":w"), "_k").alias("observation_id"), (F.col("_k") * float(WQ.STEP)).alias("window_start"), F.col("match.rule_id").alias("rule_id"), F.col("match.label").alias("label"))


QUERIES["q_window_predictions"] = q_window_predictions
ORACLES["q_window_predictions"] = f"""WITH {WQ.SEG_SQL}, g AS (SELECT capture_id, k, count(*) AS n_seg, round(max(CASE WHEN slot = 1 THEN "start" END) - max(CASE WHEN slot = 0 THEN "end" END), 6) AS gap, coalesce(max(CASE WHEN slot = 1 THEN n END), -1) AS second FROM f GROUP BY capture_id, k),
m AS (SELECT *, CASE WHEN coalesce(gap, -1) >= 0 AND n_seg >= 3 THEN 'w0' WHEN second <= -1 THEN 'w1' END AS rule_id FROM g) SELECT 'cap' || capture_id || ':w' || k AS observation_id, (k * {WQ.STEP})::DOUBLE AS window_start, rule_id, CASE rule_id WHEN 'w0' THEN 'burst' WHEN 'w1' THEN 'alone' ELSE 'unknown' END AS label FROM m"""
