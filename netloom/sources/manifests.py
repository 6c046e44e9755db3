"""Trial manifests, predictions, observation lists, capture names, attribute files, nested flows; and what is written of results."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a manifest row, and what two of them may hold.
REQUIRED = ["capture_id", "trial_id", "device_id", "app", "behavior", "pcap", "platform", "label_source"]
OPTIONAL = ["app_version", "network_env", "terminal_ip", "candidate_label", "split"]
PLATFORMS = ["android", "ios", "pc"]
LABEL_SOURCES = ["ui_event", "automation", "manual_verified", "dataset_official"]
SPLITS = {"train": "train", "val": "validation", "valid": "validation", "validation": "validation", "test": "test"}
MANIFEST = ", ".join(f"{c} string" for c in [*REQUIRED, *OPTIONAL]) + ", behavior_start double, behavior_end double"


class InputError(ValueError):
    """A file that isn't what it should be."""


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines manifest; blank lines and those that begin with # are skipped, unknown fields dropped. Any bad row is an error."""
    lines = spark.read.text(path).filter(~F.trim("value").rlike("^(#|$)"))
    rows = lines.select(F.from_json("value", MANIFEST).alias("r")).select("r.*").fillna("", OPTIONAL)
    split = F.coalesce(*[F.when(F.lower("split") == k, v) for k, v in SPLITS.items()], F.when(F.col("split") == "", ""))
    lacking = F.array_join(F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull()), ", ")
    bad = (
        F.when(lacking != "", F.concat(F.lit("lacks "), lacking))
        .when(~F.col("platform").isin(PLATFORMS), F.concat(F.lit("platform "), "platform"))
        .when(~F.col("label_source").isin(LABEL_SOURCES), F.concat(F.lit("label_source "), "label_source"))
        .when(split.isNull(), F.concat(F.lit("split "), "split"))
        .when(F.col("behavior_start").isNull() != F.col("behavior_end").isNull(), F.lit("half an interval"))
        .when(F.col("behavior_end") <= F.col("behavior_start"), F.lit("interval that ends before it starts"))
    )
    checked = rows.withColumn("bad", bad)
    first = checked.filter("bad IS NOT NULL").first()
    if first is not None:
        raise InputError(f"{path}: {first['bad']}")
    if checked.isEmpty():
        raise InputError(f"{path}: no rows")
    return checked.drop("bad").withColumn("split", split)


def unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows, if no key occurs twice."""
    again = rows.groupBy(key).count().filter("count > 1").first()
    if again is not None:
        raise InputError(f"{key} {again[key]} occurs {again['count']} times")
    return rows


def observation_list(spark: SparkSession, path: str) -> DataFrame:
    """observation_id and label of a JSON-lines file; ids must be unique."""
    rows = spark.read.schema("observation_id string, label string").json(path)
    if not rows.filter("observation_id IS NULL OR label IS NULL").isEmpty():
        raise InputError(f"{path}: a row lacks observation_id or label")
    return unique(rows, "observation_id")


PREDICTION = "observation_id string, source_file string, predicted_label string, confidence double, source string, window_start double, window_end double, session_index long, terminal string"


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from JSON lines, or from one JSON document: an array, one object, or an object with `results`."""
    try:
        document = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
        kind = document.select(F.schema_of_json(F.lit('{"a":1}')), F.substring("v", 1, 1).alias("c"), F.get_json_object("v", "$.results").alias("r"), F.from_json("v", PREDICTION).alias("one")).first()
    except Exception as e:
        raise InputError(f"{path}: {e}") from e
    if kind is None or not kind["c"]:
        raise InputError(f"{path}: empty")
    if kind["c"] == "[":
        rows = document.select(F.explode(F.from_json("v", f"array<struct<{_struct(PREDICTION)}>>")).alias("p")).select("p.*")
    elif kind["r"] is not None:
        rows = document.select(F.explode(F.from_json(F.get_json_object("v", "$.results"), f"array<struct<{_struct(PREDICTION)}>>")).alias("p")).select("p.*")
    else:
        rows = spark.read.schema(PREDICTION).json(path)
    if not rows.filter("predicted_label IS NULL").isEmpty():
        raise InputError(f"{path}: a row has no predicted_label")
    return rows


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (x.split() for x in ddl.split(", ")))


def name_parts(name: Column, pattern: str = r"^[A-Za-z0-9.\-]+?-([A-Za-z0-9]+?)(?:_p(\d+))?\.pcap$") -> list[Column]:
    """Class and part number of a capture's file name; null where it has another form."""
    cls = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return [cls.alias("class"), F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).try_cast("int").alias("part")]


def audit(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """By class (of the file's name; null if it has none) and format: files, bytes, and how many are anomalous: empty, of no known format, or named like nothing. Files' first four bytes are read, no more."""
    from netloom.sources.capture import discover, kind_of

    names = spark.createDataFrame([(p,) for p in discover(path)], "path string")  # one short row a file

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [kind_of(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["path", "format", "size"])

    files = names.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, format string, size long")
    base = F.element_at(F.split("path", "/"), -1)
    known = files.select(*(name_parts(base, pattern) if pattern else name_parts(base)), "format", "size")
    odd = (F.col("size") == 0) | (F.col("format") == "unknown") | F.col("class").isNull()
    return known.groupBy("class", "format").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(odd).alias("anomalies"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, class, part of captures whose names have the form, whole ones before parts, by class."""
    from netloom.sources.capture import discover

    names = spark.createDataFrame([(p,) for p in discover(path)], "path string")
    return names.select("path", *name_parts(F.element_at(F.split("path", "/"), -1))).filter("class IS NOT NULL").orderBy("class", F.col("part").asc_nulls_first(), "path")


def single_activity(captures: DataFrame, counts: str = "activities") -> DataFrame:
    """Captures whose map of counts by activity has just one that is over 0; adds activity."""
    some = F.map_keys(F.map_filter(counts, lambda k, n: n > 0))
    return captures.filter(F.size(some) == 1).withColumn("activity", some[0])


def candidate_label(name: Column, prefixes: list[str]) -> Column:
    """The longest of the prefixes that a name begins with."""
    return F.coalesce(*[F.when(name.startswith(p), F.lit(p)) for p in sorted(prefixes, key=lambda p: (-len(p), p))], F.lit(None).cast("string"))


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """A table of an attribute-relation file: numbers as doubles (missing, NaN and infinite ones as -1), the rest as strings."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' AND NOT v LIKE '\\%%'")
    heads = [r["v"] for r in lines.filter(F.lower("v").startswith("@attribute")).collect()]  # one short row a column
    names = []
    for h in heads:
        m = re.match(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.+)", h, re.I)
        if not m:
            raise InputError(f"{path}: {h}")
        names.append((m[1].strip("'\""), m[2].strip().lower() in ("numeric", "real", "integer")))
    parts = lines.filter(~F.col("v").startswith("@")).select(F.split("v", ",").alias("p"))
    cols = []
    for i, (n, number) in enumerate(names):
        x = F.trim(F.get("p", F.lit(i)))
        d = x.try_cast("double")
        cols.append((F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), -1.0).otherwise(d) if number else F.regexp_replace(x, "^['\"]|['\"]$", "")).alias(n))
    return parts.select(*cols)


FLOW = "map<string, struct<flow_metadata:struct<BF_label:string,BF_activity:string,BF_num_packets:bigint,BF_IP_packet_bytes:bigint,BF_duration:double>,packet_data:struct<timestamp:array<double>,IP_packet_bytes:array<bigint>,packet_dir:array<int>,iat:array<double>>>>"


def nested_flows(text: DataFrame, column: str = "value") -> DataFrame:
    """Packets of captures that are JSON maps of flows: flow, label, activity, pos, ts, length, direction."""
    f = text.select(F.explode(F.from_json(column, FLOW)).alias("flow", "f"))
    p = f.select("flow", F.col("f.flow_metadata.BF_label").alias("label"), F.col("f.flow_metadata.BF_activity").alias("activity"), F.posexplode(F.arrays_zip("f.packet_data.timestamp", "f.packet_data.IP_packet_bytes", "f.packet_data.packet_dir")).alias("pos", "x"))
    return p.select("flow", "label", "activity", "pos", F.col("x.timestamp").alias("ts"), F.col("x.IP_packet_bytes").alias("length"), F.when(F.col("x.packet_dir") == 0, 1).otherwise(-1).alias("direction"))
