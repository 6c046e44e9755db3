"""Rules: conditions on features, compiled to columns; mining, replay and revision.

A rule is {"rule_id", "label", "priority", "confidence", "conditions": [{"feature", "op", "value"}]}; a range has a value of two numbers, or min and max. No user
expression is ever evaluated: operators come from a fixed list and become column expressions, so a whole rule set runs
inside one projection, without joins and without Python.
"""

from __future__ import annotations

import copy
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.order import numbered

#: What a condition may say.
OPERATORS = ("range", "<=", ">=", ">", "<", "==", "!=", "exists", "not_exists", "contains")


def condition(c: dict, columns: dict[str, str], missing: float | None = None) -> Column:
    """columns: types by name. A missing feature (null; with `missing`, that value) fails all but not_exists; NaN fails all comparisons but !=."""
    op, name, value = c["op"], c["feature"], c.get("value")
    if op == "range" and value is None:
        value = [c.get("min", -math.inf), c.get("max", math.inf)]
    if op not in OPERATORS:
        return F.lit(False)
    if name not in columns:
        return F.lit(op == "not_exists")
    x = F.col(f"`{name}`")
    number = columns[name] in ("double", "float", "int", "bigint", "smallint", "tinyint") or columns[name].startswith("decimal")
    if missing is not None and number:
        x = F.coalesce(x, F.lit(missing))
    if op == "exists":
        return x.isNotNull() & (F.lit(True) if number else x != "")
    if op == "not_exists":
        return x.isNull() | (F.lit(False) if number else x == "")
    if op == "contains":  # of a list of values, any
        wanted = value if isinstance(value, list) else [value]
        has = (lambda v: F.array_contains(x, v)) if columns[name].startswith("array") else lambda v: F.contains(x.cast("string"), F.lit(str(v)))
        return F.coalesce(reduce(Column.__or__, [has(v) for v in wanted], F.lit(False)), F.lit(False))
    if op == "==":
        return F.coalesce(x.cast("string") == F.lit(str(value)), F.lit(False))
    d = x.cast("double")
    real = d.isNotNull() & ~F.isnan(d)
    if op == "!=":
        return d.isNotNull() & (F.isnan(d) | (d != float(value)))
    test = {"range": lambda: d.between(float(value[0]), float(value[1])), "<=": lambda: d <= float(value), ">=": lambda: d >= float(value), ">": lambda: d > float(value), "<": lambda: d < float(value)}[op]()
    return F.coalesce(real & test, F.lit(False))


def matches(rule: dict, columns: dict[str, str], missing: float | None = None) -> Column:
    """All conditions hold; a rule without any never matches."""
    if not rule.get("conditions"):
        return F.lit(False)
    return reduce(Column.__and__, [condition(c, columns, missing) for c in rule["conditions"]])


def ordered(rules: list[dict], threshold: float = 0.0) -> list[dict]:
    """By priority, then place; without those whose confidence is below the threshold."""
    return [r for _, _, r in sorted((r.get("priority", 0), i, r) for i, r in enumerate(rules)) if r.get("confidence", 1.0) >= threshold]


def first_match(df: DataFrame, rules: list[dict], threshold: float = 0.0, missing: float | None = None, out: str = "match") -> DataFrame:
    """Adds a struct (rule_id, label, confidence) of the first rule that matches; label unknown, confidence 0 where none does."""
    types = dict(df.dtypes)
    none = F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit("unknown").alias("label"), F.lit(0.0).alias("confidence"))
    whens = [F.when(matches(r, types, missing), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(str(r["label"])).alias("label"), F.lit(float(r.get("confidence", 1.0))).alias("confidence"))) for r in ordered(rules, threshold)]
    return df.withColumn(out, F.coalesce(*whens, none))


def required_features(rules: list[dict]) -> list[str]:
    return sorted({c["feature"] for r in rules for c in r.get("conditions", [])})


def statistical_rules(long: DataFrame, outside: float = 0.5, most: int = 8, least: int = 2) -> DataFrame:
    """Ranges that hold the middle 90 % of a class's values of a feature and less than `outside` of all other classes' values.

    long: id, label, feature, x. Returns label, feature, low, high (4 decimals), outside; the `most` least shared of each class, for classes of
    at least 3 rows with at least `least` such features. Ranges are as many as classes times features.
    """
    from pyspark.sql import Window

    # Exact quantiles from places in order: no task holds a class's values.
    n = numbered(long.filter("x IS NOT NULL"), ["label", "feature"], ["x", "id"], "_i", "_n")
    ends = []
    for share in (0.05, 0.95):
        at = (F.col("_n") - 1) * share + 1
        low = F.max(F.when(F.col("_i") == F.floor(at), F.col("x")))
        high = F.max(F.when(F.col("_i") == F.ceil(at), F.col("x")))
        ends.append(low + (high - low) * (F.max(at) - F.floor(F.max(at))))
    q = n.groupBy("label", "feature").agg(F.round(ends[0], 4).alias("low"), F.round(ends[1], 4).alias("high"), F.count("*").alias("n")).filter("n >= 3")
    # All classes' ranges of a feature in one row: a value meets them in place, and only counts by class move.
    ranges = q.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("label", "low", "high"))).alias("ranges"))
    met = long.join(F.broadcast(ranges), "feature").select("feature", "label", "x", F.explode("ranges").alias("r"))  # classes times features
    inside = met.filter(F.col("label") != F.col("r.label")).groupBy(F.col("r.label").alias("rule_label"), "feature", "r.low", "r.high").agg(F.avg(F.col("x").between(F.col("r.low"), F.col("r.high")).cast("double")).alias("outside"))
    w = Window.partitionBy("rule_label")
    ranked = inside.filter(F.col("outside") < outside).withColumn("_r", F.row_number().over(w.orderBy(F.round("outside", 9), "feature"))).withColumn("_n", F.count("*").over(w))
    return ranked.filter((F.col("_r") <= most) & (F.col("_n") >= least)).select(F.col("rule_label").alias("label"), "feature", "low", "high", F.round("outside", 6).alias("outside"))


def tree_rules(df: DataFrame, features: list[str], label: str, purity: float = 0.6, depth: int = 5) -> list[dict]:
    """Paths of a decision tree to leaves of at least such purity, as conjunctions; confidence is their precision when replayed on the rows they come from, and those that hit nothing fall."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = df.count()
    classes = df.select(label).distinct().count()
    ready = VectorAssembler(inputCols=features, outputCol="_v").transform(df.select(*features, F.col(label).cast("double").alias("_y")))
    tree = DecisionTreeClassifier(featuresCol="_v", labelCol="_y", maxDepth=depth, minInstancesPerNode=max(1, min(5, rows // max(2 * classes, 1))), seed=7).fit(ready)

    found: list[dict] = []

    def walk(node, conditions: list[dict]) -> None:
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            total = sum(stats)
            best = max(range(len(stats)), key=lambda i: (stats[i], -i))
            if conditions and total and stats[best] / total >= purity:
                found.append({"rule_id": f"tree_{len(found)}", "label": best, "priority": len(found), "conditions": list(conditions)})
            return
        split = node.split()
        name, cut = features[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), [*conditions, {"feature": name, "op": "<=", "value": cut}])
        walk(node.rightChild(), [*conditions, {"feature": name, "op": ">", "value": cut}])

    walk(tree._java_obj.rootNode(), [])
    if not found:
        return []
    types = dict(df.dtypes)
    aggs = [x for i, r in enumerate(found) for x in (F.count_if(matches(r, types)).alias(f"n{i}"), F.count_if(matches(r, types) & (F.col(label) == r["label"])).alias(f"h{i}"))]
    hit = df.agg(*aggs).first()
    return [r | {"confidence": round(hit[f"h{i}"] / hit[f"n{i}"], 4)} for i, r in enumerate(found) if hit[f"n{i}"]]


class RevisionError(ValueError):
    """An edit that can't be made; nothing is changed."""


def revise(rules: list[dict], edits: list[dict], deployed: list[str]) -> list[dict]:
    """Disable, enable or edit rules; any problem in any edit stops the whole revision."""
    out = {r["rule_id"]: copy.deepcopy(r) for r in rules}
    problems = []
    for e in edits:
        r = out.get(e.get("rule_id"))
        if r is None:
            problems.append(f"no rule {e.get('rule_id')}")
        elif e.get("action") in ("disable", "enable"):
            r["enabled"] = e["action"] == "enable"
        elif e.get("action") == "edit":
            for c in e.get("conditions", []):
                values = c["value"] if isinstance(c.get("value"), list) else [c.get("value")]
                if c.get("op") not in OPERATORS:
                    problems.append(f"{e['rule_id']}: operator {c.get('op')}")
                elif c.get("feature") not in deployed:
                    problems.append(f"{e['rule_id']}: feature {c.get('feature')} isn't deployed")
                elif c["op"] not in ("exists", "not_exists", "contains", "==") and not all(isinstance(v, int | float) and math.isfinite(v) for v in values):
                    problems.append(f"{e['rule_id']}: value {c.get('value')}")
            r["conditions"] = e.get("conditions", r["conditions"])
        else:
            problems.append(f"action {e.get('action')}")
    if problems:
        raise RevisionError("; ".join(problems))
    return [r for r in out.values() if r.get("enabled", True)]


def save_bundle(folder: str, rules: list[dict], features: list[str], labels: dict[int, str], **meta) -> None:
    """rules.json, selected_features.json and bundle_config.json, in the store of the folder's scheme."""
    from netloom.sources.results import write_text

    write_text(f"{folder}/rules.json", json.dumps(rules, indent=1))
    write_text(f"{folder}/selected_features.json", json.dumps(features))
    write_text(f"{folder}/bundle_config.json", json.dumps({"labels": {str(k): v for k, v in labels.items()}} | meta, indent=1))


def load_bundle(folder: str) -> tuple[list[dict], list[str], dict]:
    """All three files must be there; label numbers are integers again."""
    from netloom.sources.results import exists, read_text

    files = ["rules.json", "selected_features.json", "bundle_config.json"]
    lacking = [f for f in files if not exists(f"{folder}/{f}")]
    if lacking:
        raise FileNotFoundError(f"{folder} lacks {', '.join(lacking)}")
    rules, features, config = (json.loads(read_text(f"{folder}/{f}")) for f in files)
    return rules, features, config | {"labels": {int(k): v for k, v in config["labels"].items()}}
