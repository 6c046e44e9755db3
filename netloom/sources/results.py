"""What runs leave behind, and how it is read again: tables of features and detections, rule files, manifests, models, reports.

Rows are written by executors, in any number. Small documents go through the store of the path's scheme.
"""

from __future__ import annotations

import json

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.sources.capture import _store

#: Fields of a manifest row, in the order in which they are written.
MANIFEST_ORDER = ["capture_id", "trial_id", "device_id", "platform", "app", "app_version", "behavior", "pcap", "terminal_ip", "network_env", "label_source", "candidate_label", "behavior_start", "behavior_end", "split"]


def read_text(path: str) -> str:
    store, inner = _store(path)
    with store.open_input_stream(inner, compression=None) as f:
        return f.read().decode()


def write_text(path: str, text: str) -> None:
    store, inner = _store(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner, compression=None) as f:
        f.write(text.encode())


def exists(path: str) -> bool:
    from pyarrow import fs

    store, inner = _store(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def write_features(rows: DataFrame, path: str) -> None:
    """Feature rows as CSV with a head; columns that begin with an underscore describe the observation and come first."""
    order = sorted(rows.columns, key=lambda c: not c.startswith("_"))
    rows.select(*order).write.mode("overwrite").option("header", "true").csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a feature CSV: columns that begin with an underscore as text, all others as doubles."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*[F.col(c) if c.startswith("_") else F.col(c).try_cast("double").alias(c) for c in raw.columns])


def feature_rows(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """Feature vectors from JSON: an array of objects, one object, or lines; what an object lacks is null, other fields are dropped."""
    kind = ", ".join(f"`{f}` double" for f in features)
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    several = head is not None and head["c"] == "["
    return spark.read.schema(kind).option("multiLine", str(several).lower()).json(path)


def write_detections(rows: DataFrame, path: str) -> None:
    """Detections as CSV with a head."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_predictions(rows: DataFrame, path: str, **extra) -> None:
    """A JSON document with a version, counts and where the results are: lines of a folder beside it, so that any number can be written."""
    rows.write.mode("overwrite").json(f"{path}.rows")
    count = rows.sparkSession.read.schema(rows.schema).json(f"{path}.rows").count()
    write_text(path, json.dumps({"version": 1, "results_in": f"{path}.rows", "n_results": count} | extra, indent=1))


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows of a document of write_predictions, and the document."""
    document = json.loads(read_text(path))
    return spark.read.json(document["results_in"]), document


def write_manifest(rows: DataFrame, path: str) -> None:
    """Lines of JSON with fields in their order, in one file (a manifest has a row a trial)."""
    rows.select(*[c for c in MANIFEST_ORDER if c in rows.columns]).coalesce(1).write.mode("overwrite").json(path)


def manifest_report(rows: DataFrame, base: str) -> dict:
    """Of manifest rows: how many, distinct values, which captures don't exist below base, how many have an interval. One short row a capture reaches the driver."""
    names = ["capture_id", "device_id", "app", "behavior", "platform", "split"]
    first = rows.agg(F.count("*").alias("rows"), F.count("behavior_start").alias("with_interval"), *[F.count_distinct(c).alias(f"n_{c}") for c in names if c in rows.columns]).first().asDict()
    lacking = [r["pcap"] for r in rows.select("pcap").distinct().orderBy("pcap").collect() if not exists(r["pcap"] if "://" in r["pcap"] or r["pcap"].startswith("/") else f"{base.rstrip('/')}/{r['pcap']}")]
    return first | {"missing": lacking}


def write_rules(path: str, rules: list[dict], labels: dict[int, str]) -> None:
    """A YAML document (version 2.0) with labels by number and rules."""
    plain = json.loads(json.dumps({"version": "2.0", "labels": {str(k): v for k, v in labels.items()}, "rules": rules}, default=float))
    plain["labels"] = {int(k): v for k, v in plain["labels"].items()}
    write_text(path, yaml.safe_dump(plain, sort_keys=False, allow_unicode=True))


def read_rules(path: str) -> tuple[list[dict], dict[int, str]]:
    """Rules and labels of a YAML document; label numbers are integers."""
    document = yaml.safe_load(read_text(path)) or {}
    return document.get("rules") or [], {int(k): v for k, v in (document.get("labels") or {}).items()}


def selection_report(scores: DataFrame, n: int = 20) -> list[dict]:
    """The n best features with their scores."""
    return [r.asDict() for r in scores.orderBy(F.desc(F.round("score", 9)), "feature").limit(n).collect()]


def write_reports(folder: str, matrix: DataFrame, scores: DataFrame, rules: list[dict]) -> None:
    """feature_selection_report.json, selected_features_stats.json (count, mean, sample deviation, quartiles of each column of matrix), rules_summary.json."""
    write_text(f"{folder}/feature_selection_report.json", json.dumps(selection_report(scores), indent=1))
    names = [c for c, kind in matrix.dtypes if not c.startswith("_") and kind in ("double", "float", "int", "bigint")]
    row = matrix.agg(*[x for c in names for x in (F.count(c).alias(f"{c}|count"), F.avg(c).alias(f"{c}|mean"), F.stddev_samp(c).alias(f"{c}|std"), F.min(c).alias(f"{c}|min"), F.max(c).alias(f"{c}|max"), F.approx_percentile(c, [0.25, 0.5, 0.75]).alias(f"{c}|quartiles"))]).first()
    stats = {c: {k: row[f"{c}|{k}"] for k in ("count", "mean", "std", "min", "max", "quartiles")} for c in names}
    write_text(f"{folder}/selected_features_stats.json", json.dumps(stats, indent=1, default=float))
    kinds: dict[str, int] = {}
    for r in rules:
        kinds[r.get("type", "rule")] = kinds.get(r.get("type", "rule"), 0) + 1
    write_text(f"{folder}/rules_summary.json", json.dumps({"n_rules": len(rules), "by_type": kinds, "features": sorted({c["feature"] for r in rules for c in r.get("conditions", [])})}, indent=1))


def run_report(folder: str, metrics: dict, rules: list[dict], labels: dict[int, str]) -> str:
    """A markdown page of a run, written to report.md."""
    lines = ["# Run", "", f"Labels: {', '.join(labels[k] for k in sorted(labels))}", "", f"Rules: {len(rules)}", "", "| metric | value |", "|-|-|"]
    lines += [f"| {k} | {v:.6g} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in metrics.items()]
    lines += ["", "| rule | label | conditions |", "|-|-|-|"]
    for r in rules:
        text = " and ".join(f"{c['feature']} {c['op']} {c.get('value', '')}" for c in r.get("conditions", []))
        lines.append(f"| {r.get('rule_id')} | {r.get('label')} | {text} |")
    write_text(f"{folder}/report.md", "\n".join(lines) + "\n")
    return "\n".join(lines) + "\n"
