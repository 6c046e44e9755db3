"""Classifiers over feature rows: training, probabilities, ensembles, latent domains, matching, bundles.

Models are Spark's own learners, so rows stay on executors; a model's parameters, a few classes' sizes and
what is read from bundles are all that the driver holds. Probabilities are arrays in the order of the labels.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import rules as R
from netloom.operators.ranking import seeded

#: Members of the named ensembles, whose probabilities are averaged.
ENSEMBLES = {"extra_rf": ("extra", "rf"), "extra_rf_lr": ("extra", "rf", "lr")}


def learner(name: str, seed: int):
    """rf: a forest; extra: a deeper one whose trees see every row and few features; gbt: boosted trees, one against the rest; lr: logistic."""
    common = {"featuresCol": "_v", "labelCol": "_y", "weightCol": "_w"}
    if name == "rf":
        return RandomForestClassifier(numTrees=40, maxDepth=8, seed=seed, **common)
    if name == "extra":
        return RandomForestClassifier(numTrees=60, maxDepth=12, subsamplingRate=1.0, featureSubsetStrategy="sqrt", seed=seed, **common)
    if name == "lr":
        return LogisticRegression(maxIter=50, regParam=1e-3, **common)
    if name == "gbt":
        return OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=4, seed=seed), **common)
    raise ValueError(f"no model {name}")


def prepared(rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds the vector of features; null, NaN and infinite values are 0."""
    clean = [F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf")), 0.0).otherwise(F.col(f).cast("double")).alias(f"_x{i}") for i, f in enumerate(features)]
    held = rows.select("*", *clean)
    return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_v").transform(held).drop(*[f"_x{i}" for i in range(len(features))])


def balanced(rows: DataFrame, label: str = "_y") -> DataFrame:
    """Adds _w: rows over classes times the class's rows, so that classes weigh alike. One row a class is joined."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c").alias("n"), F.count("*").alias("k")).first()
    return rows.join(F.broadcast(sizes), label).withColumn("_w", F.lit(total["n"] / max(total["k"], 1)) / F.col("_c")).drop("_c")


def fit(train: DataFrame, features: list[str], label: str, name: str, seed: int = 7):
    """A list of models, one a member. label: numbers from 0."""
    ready = balanced(prepared(train, features).withColumn("_y", F.col(label).cast("double"))).select("_v", "_y", "_w")
    return [learner(m, seed + i).fit(ready) for i, m in enumerate(ENSEMBLES.get(name, (name,)))]


def probabilities(models, rows: DataFrame, features: list[str], classes: int) -> DataFrame:
    """rows with proba: array of as many doubles as there are classes, averaged over the models."""
    out = prepared(rows, features).withColumn("_sum", F.array_repeat(F.lit(0.0), classes))
    for m in models:
        got = m.transform(out).withColumn("_one", vector_to_array("probability") if "probability" in m.transform(out.limit(0)).columns else _softmax(vector_to_array("rawPrediction")))
        out = got.withColumn("_sum", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.get("_sum", i) + F.coalesce(F.get("_one", i), F.lit(0.0)))).drop("probability", "rawPrediction", "prediction", "_one")
    return out.withColumn("proba", F.transform("_sum", lambda x: x / len(models))).drop("_sum", "_v")


def _softmax(raw: Column) -> Column:
    shifted = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def argmax(proba: Column) -> Column:
    """The first class of the largest probability."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def out_of_fold(train: DataFrame, features: list[str], label: str, id_: str, name: str, classes: int, folds: int = 5, seed: int = 7) -> DataFrame:
    """Rows with fold and proba, each from models that did not learn from it. Folds are dealt out within classes by seeded order of the id."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(label, F.substring(seeded(str(seed), F.col(id_)), 1, 2)).orderBy(seeded(str(seed), F.col(id_)), id_))
    dealt = train.withColumn("fold", F.pmod(place + F.conv(F.substring(seeded(str(seed), F.col(label)), 1, 4), 16, 10).cast("int"), F.lit(folds)))
    parts = []
    for k in range(folds):
        models = fit(dealt.filter(F.col("fold") != k), features, label, name, seed + 1000 + k)
        parts.append(probabilities(models, dealt.filter(F.col("fold") == k), features, classes))
    return reduce(DataFrame.unionByName, parts)


def latent_domains(train: DataFrame, rows: DataFrame, features: list[str], label: str, domain_of: list[int], name: str, seed: int = 7, soft: bool = True) -> DataFrame:
    """rows with proba from a gate over domains and an expert for each: their probabilities multiplied (soft), or the likeliest domain's expert alone. domain_of: domain of each class; domains are never inputs. A domain with under two rows a class has equal odds."""
    classes, domains = len(domain_of), sorted(set(domain_of))
    mapped = train.withColumn("_domain", F.element_at(F.array(*[F.lit(domains.index(d)) for d in domain_of]), F.col(label).cast("int") + 1))
    out = probabilities(fit(mapped, features, "_domain", name, seed), rows, features, len(domains)).withColumnRenamed("proba", "_gate")
    if not soft:
        out = out.withColumn("_gate", F.transform(F.sequence(F.lit(0), F.lit(len(domains) - 1)), lambda i: (i == argmax(F.col("_gate"))).cast("double")))
    sizes = {r["_domain"]: r["n"] for r in mapped.groupBy("_domain").agg(F.count("*").alias("n")).collect()}  # a number a domain
    for i, d in enumerate(domains):
        own = [c for c in range(classes) if domain_of[c] == d]
        if sizes.get(i, 0) < 2 * len(own):
            out = out.withColumn(f"_p{i}", F.array(*[F.lit(1.0 / len(own)) for _ in own]))
            continue
        part = mapped.filter(F.col("_domain") == i).withColumn("_own", F.element_at(F.array(*[F.lit(own.index(c) if c in own else 0) for c in range(classes)]), F.col(label).cast("int") + 1))
        out = probabilities(fit(part, features, "_own", name, seed + 1 + i), out, features, len(own)).withColumnRenamed("proba", f"_p{i}")
    made = [F.get("_gate", F.lit(domains.index(domain_of[c]))) * F.get(f"_p{domains.index(domain_of[c])}", F.lit([x for x in range(classes) if domain_of[x] == domain_of[c]].index(c))) for c in range(classes)]
    return out.withColumn("proba", F.array(*made)).drop("_gate", *[f"_p{i}" for i in range(len(domains))])


def app_of(label: Column) -> Column:
    return F.substring_index(label, "_", 1)


def behavior_of(label: Column) -> Column:
    """What follows the first underscore; the whole label where there is none."""
    return F.when(F.instr(label, "_") > 0, F.substr(label, F.instr(label, "_") + 1)).otherwise(label)


def matched(rows: DataFrame, labels: dict[int, str], threshold: float, rules: list[dict] | None = None, missing: float | None = None) -> DataFrame:
    """rows with match (rule_id, label, confidence, app, behavior, source): the classifier's label where its probability (column proba) reaches the threshold, else the first rule that matches, else unknown."""
    p = F.array_max("proba")
    name = F.coalesce(F.element_at(F.array(*[F.lit(labels.get(i)) for i in range(max(labels) + 1)]), argmax(F.col("proba")) + 1), F.concat(F.lit("class_"), argmax(F.col("proba"))))
    sure = F.struct(F.lit("ENS_0001").alias("rule_id"), name.alias("label"), p.alias("confidence"))
    found = R.first_match(rows, [r for r in rules or [] if r.get("type") != "ensemble_classifier"], threshold, missing, out="_rule")
    by = F.when(p >= threshold, F.lit("classifier")).when(F.col("_rule.rule_id").isNotNull(), F.lit("rules")).otherwise(F.lit("none"))
    both = F.when(p >= threshold, sure).otherwise(F.struct(F.col("_rule.rule_id").alias("rule_id"), F.col("_rule.label").alias("label"), F.col("_rule.confidence").alias("confidence")))
    out = found.withColumn("_m", both).withColumn("_by", by)
    return out.withColumn("match", F.struct("_m.rule_id", "_m.label", "_m.confidence", app_of(F.col("_m.label")).alias("app"), behavior_of(F.col("_m.label")).alias("behavior"), F.col("_by").alias("source"))).drop("_m", "_by", "_rule")


def match_statistics(rows: DataFrame) -> DataFrame:
    """Rows, matches and the share of matches, by source."""
    by = rows.groupBy(F.col("match.source").alias("source")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(_everything())
    return by.select("source", "n", F.round(F.col("n") / total, 6).alias("rate"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # a row a source


def low_confidence(rows: DataFrame, threshold: float) -> DataFrame:
    """rows with predicted (-1 below the threshold), confidence and source."""
    p = F.array_max("proba")
    return rows.withColumn("confidence", p).withColumn("predicted", F.when(p < threshold, -1).otherwise(argmax(F.col("proba")))).withColumn("source", F.when(p < threshold, "low_confidence").otherwise("classifier"))


def ensemble_rule(importances: dict[str, float], threshold: float) -> dict:
    """A rule that stands for the classifier: it has no conditions, so that it never matches by itself."""
    best = sorted(importances.items(), key=lambda x: (-x[1], x[0]))[:10]
    return {"rule_id": "ENS_0001", "type": "ensemble_classifier", "label": "classify_by_ensemble", "priority": 0, "confidence": threshold, "conditions": [], "num_features": len(importances), "top_features": [[k, float(v)] for k, v in best]}


def generated(rows: DataFrame, features: list[str], label: str, labels: dict[int, str], id_: str = "id", threshold: float = 0.5, name: str = "rf", purity: float = 0.6) -> tuple[list, list[dict]]:
    """The classifier (as control) and all rules: the one that stands for it, those of a tree, and ranges by class."""
    models = fit(rows, features, label, name)
    weights = next((m.featureImportances.toArray() for m in models if hasattr(m, "featureImportances")), [0.0] * len(features))
    named = lambda x: labels.get(int(x), f"class_{int(x)}")
    out = [ensemble_rule(dict(zip(features, map(float, weights), strict=True)), threshold)]
    out += [r | {"type": "decision_tree", "label": named(r["label"]), "priority": 100 + i} for i, r in enumerate(R.tree_rules(rows, features, label, purity))]
    long = rows.select(F.col(id_).alias("id"), F.col(label).alias("label"), F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "x"))
    ranges: dict = {}
    for r in R.statistical_rules(long).collect():  # at most eight a class
        ranges.setdefault(r["label"], []).append(r)
    for i, (cls, rs) in enumerate(sorted(ranges.items())):
        out.append({"rule_id": f"stat_{i}", "type": "statistical", "label": named(cls), "priority": 1000 + i, "confidence": round(1 - min(r["outside"] for r in rs), 4), "conditions": [{"feature": features[r["feature"]], "op": "range", "value": [r["low"], r["high"]]} for r in rs]})
    return models, out


def save_model(folder: str, models: list, features: list[str], labels: dict[int, str], threshold: float, soft_threshold: float | None = None) -> None:
    """Models in Spark's own format, features and engine_config.json."""
    from netloom.sources.results import write_text

    PipelineModel(stages=models).write().overwrite().save(f"{folder}/model")
    write_text(f"{folder}/selected_features.json", json.dumps(features))
    write_text(f"{folder}/engine_config.json", json.dumps({"labels": {str(k): v for k, v in labels.items()}, "confidence_threshold": threshold, "soft_match_threshold": soft_threshold}))


def load_model(folder: str) -> tuple[list, list[str], dict]:
    from netloom.sources.results import exists, read_text

    lacking = [f for f in ("model", "selected_features.json", "engine_config.json") if not exists(f"{folder}/{f}")]
    if lacking:
        raise FileNotFoundError(f"{folder} lacks {', '.join(lacking)}")
    config = json.loads(read_text(f"{folder}/engine_config.json"))
    return PipelineModel.load(f"{folder}/model").stages, json.loads(read_text(f"{folder}/selected_features.json")), config | {"labels": {int(k): v for k, v in config["labels"].items()}}


#: Rules to try an engine with.
DEMO = [
    {"rule_id": f"demo_{i}", "type": "statistical", "label": label, "priority": i, "confidence": 0.6, "conditions": conditions}
    for i, (label, conditions) in enumerate(
        [
            ("web_browse", [{"feature": "total_packets", "op": "range", "value": [10, 200]}, {"feature": "pkt_size_mean", "op": "<", "value": 700}]),
            ("video_stream", [{"feature": "down_up_byte_ratio", "op": ">=", "value": 8}, {"feature": "pkt_size_mean", "op": ">=", "value": 700}]),
            ("voice_call", [{"feature": "iat_mean", "op": "<=", "value": 0.06}, {"feature": "pkt_size_std", "op": "<", "value": 120}]),
            ("file_transfer", [{"feature": "total_bytes", "op": ">=", "value": 1_000_000}, {"feature": "pkt_size_mean", "op": ">=", "value": 900}]),
            ("chat_text", [{"feature": "total_packets", "op": "<", "value": 60}, {"feature": "total_bytes", "op": "<", "value": 20_000}]),
        ]
    )
]
