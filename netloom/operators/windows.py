"""Time windows over packets: sliding, tumbling, segments, labels, votes, events.

Windows begin at a capture's (or session's) first packet, not at the epoch. A packet's windows are
an exploded range of numbers, so each packet is repeated only as often as it counts; no window is
looked up by comparing times.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.exprs import entropy_of_counts, rounded, share, stats8
from netloom.operators.sessions import SESSION


#: Packets that go the other way than the one before.
CHANGES = "count_if(prev_dir is not null and prev_dir <> direction)"


def sliding(packets: DataFrame, size: float, step: float, key: str = "capture_id") -> DataFrame:
    """A row for each packet and window [k * step, k * step + size) from the key's first packet on; adds k, rel."""
    origin = packets.groupBy(key).agg(F.min_by("ts", "pkt_idx").alias("origin"))
    rel = packets.join(origin, key).withColumn("rel", F.col("ts") - F.col("origin")).filter("rel >= 0")
    last = F.floor(F.col("rel") / step)
    first = F.greatest(F.floor((F.col("rel") - size) / step) + 1, F.lit(0))
    return rel.withColumn("k", F.explode(F.sequence(first, last)))


def segments(windowed: DataFrame, gap: float, keys: list[str], conn: str = "flow") -> DataFrame:
    """Segments of each connection in each window: split where it is idle for over the gap. slot counts them by start, then first packet."""
    w = Window.partitionBy(*keys, conn).orderBy("pkt_idx")
    cut = windowed.withColumn("_b", F.coalesce((F.col("rel") - F.lag("rel").over(w)) > gap, F.lit(False)).cast("int")).withColumn("seg", F.sum("_b").over(w))
    by = cut.groupBy(*keys, conn, "seg").agg(
        F.min("rel").alias("start"), F.max("rel").alias("end"), F.min("pkt_idx").alias("first_idx"), F.count("*").alias("n"), F.sum("length").alias("bytes"), F.avg("length").alias("mean_len"),
        F.stddev_pop("length").alias("std_len"), F.count_if(F.col("direction") == 1).alias("up"), F.coalesce(F.sum(F.when(F.col("direction") == 1, F.col("length"))), F.lit(0)).alias("up_bytes"),
    )
    return by.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "first_idx")) - 1)


def slot_features(slots: int = 3) -> dict[str, str]:
    """Aggregates over segments of a window: totals, the first slots (null where absent), relations of neighbouring slots."""
    out = {"n_conn": "count(distinct flow)", "n_seg": "count(*)", "n_pkt": "sum(n)", "active_span": 'max("end") - min("start")', "up_ratio": share("sum(up)", "sum(n)"), "up_byte_ratio": share("sum(up_bytes)", "sum(bytes)")}
    out |= {"overflow_n_seg": f"count_if(slot >= {slots})", "overflow_byte_ratio": share(f"coalesce(sum(bytes) FILTER (WHERE slot >= {slots}), 0)", "sum(bytes)")}
    at = lambda x, i: f"max(case when slot = {i} then {x} end)"
    for i in range(slots):
        out |= {f"seg{i}_valid": f"case when count_if(slot = {i}) > 0 then 1 end", f"seg{i}_duration": at('"end" - "start"', i), f"seg{i}_pkt": at("n", i), f"seg{i}_up_ratio": at("up / cast(n as double)", i), f"seg{i}_up_byte_ratio": at("up_bytes / cast(greatest(bytes, 1) as double)", i), f"seg{i}_mean_len": at("mean_len", i), f"seg{i}_std_len": at("std_len", i)}
    for i in range(slots - 1):
        a, b = i, i + 1
        both = f"greatest(least({at(chr(34) + 'end' + chr(34), a)}, {at(chr(34) + 'end' + chr(34), b)}) - greatest({at(chr(34) + 'start' + chr(34), a)}, {at(chr(34) + 'start' + chr(34), b)}), 0)"
        has = f"count_if(slot = {b}) > 0"
        out |= {
            f"rel{a}{b}_gap": f"""{at('"start"', b)} - {at('"end"', a)}""",
            f"rel{a}{b}_overlap": f"case when {has} then {both} end",
            f"rel{a}{b}_overlap_ratio": f"case when {has} then {both} / greatest({at(chr(34) + 'end' + chr(34) + ' - ' + chr(34) + 'start' + chr(34), a)}, {at(chr(34) + 'end' + chr(34) + ' - ' + chr(34) + 'start' + chr(34), b)}, 1e-9) end",
            f"rel{a}{b}_cross_conn": f"case when {has} then (case when {at('flow', a)} <> {at('flow', b)} then 1 else 0 end) end",
            f"rel{a}{b}_byte_ratio": f"{at('bytes', b)} / cast({at('bytes', a)} as double)",
        }
    return out


def window64() -> dict[str, str]:
    """Identifier-free figures of a window's packets; iat and prev_dir are within the window."""
    up, down = "direction = 1", "direction = -1"
    n = "count(*)"
    out = {
        "n_pkt": n, "n_conn": "count(distinct flow)", "active_span": "max(ts) - min(ts)", "total_bytes": "sum(length)", "up_pkts": f"count_if({up})", "down_pkts": f"count_if({down})",
        "up_bytes": f"coalesce(sum(length) FILTER (WHERE {up}), 0)", "down_bytes": f"coalesce(sum(length) FILTER (WHERE {down}), 0)", "up_ratio": share(f"count_if({up})", n),
        "up_byte_ratio": share(f"coalesce(sum(length) FILTER (WHERE {up}), 0)", "sum(length)"), "dir_changes": CHANGES, "dir_change_rate": share(CHANGES, f"{n} - 1"),
    }
    out |= stats8("length", "size") | {"size_sum": "sum(length)"} | stats8("greatest(iat, 0)", "iat")
    out |= stats8("length", "up_size", up, 5) | stats8("length", "down_size", down, 5)
    edges = [0, 64, 128, 256, 512, 768, 1024, 1280, 1601]
    out |= {f"size_hist_{i}": share(f"count_if(length >= {a} AND length < {b})", n) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))}
    for name, cond in {"eq40": "length = 40", "560_610": "length between 560 and 610", "ge1450": "length >= 1450", "1300_1449": "length between 1300 and 1449", "le64": "length <= 64"}.items():
        out[f"size_{name}_ratio"] = share(f"count_if({cond})", n)
    out["size_unique_ratio"] = share("count(distinct length)", n)
    for name, (a, b) in {"uu": (1, 1), "ud": (1, -1), "du": (-1, 1), "dd": (-1, -1)}.items():
        out[f"dir2_{name}"] = share(f"count_if(prev_dir is not null and prev_dir = {a} and direction = {b})", f"{n} - 1")
    return out


def within(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """iat and prev_dir as seen within each window."""
    w = Window.partitionBy(*keys).orderBy("pkt_idx")
    return windowed.withColumn("iat", F.col("ts") - F.lag("ts").over(w)).withColumn("prev_dir", F.lag("direction").over(w))


def value_entropy(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Entropy and mode share of a value within keys, by way of its counts."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.round(F.expr(entropy_of_counts("c")), 6).alias(f"{out}_entropy"), F.round(F.max("c") / F.sum("c"), 6).alias(f"{out}_mode_ratio"))


def behavior41(windowed: DataFrame, size: float, gap: float, keys: list[str], digits: int = 6) -> DataFrame:
    """All figures of a behaviour window: its segments', its packets' changes of direction, its idle time."""
    slots = segments(windowed, gap, keys).groupBy(*keys).agg(*rounded(sparked(slot_features()), digits))
    changes = within(windowed, keys).groupBy(*keys).agg(F.expr(CHANGES).alias("dir_changes"))
    idle = F.round(F.greatest(F.lit(float(size)) - F.col("active_span"), F.lit(0.0)), digits)
    return slots.join(changes, keys).withColumn("idle", idle)


def tunnel64(windowed: DataFrame, size: float, gap: float, keys: list[str], digits: int = 6) -> DataFrame:
    """All figures of a tunnel window; k: the window's number. It starts after the capture's first packet if k is over 0."""
    main = within(windowed, keys).groupBy(*keys).agg(*rounded(sparked(window64()), digits))
    over = {k: v for k, v in slot_features().items() if k in ("n_seg", "overflow_n_seg", "overflow_byte_ratio")}
    slots = segments(windowed, gap, keys).groupBy(*keys).agg(*rounded(sparked(over), digits))
    out = main.join(slots, keys).join(value_entropy(windowed, keys, "length", "size"), keys)
    return out.withColumn("idle", F.round(F.greatest(F.lit(float(size)) - F.col("active_span"), F.lit(0.0)), digits)).withColumn("truncated_prefix", (F.col("k") > 0).cast("double"))


def sparked(named: dict[str, str]) -> dict[str, str]:
    """Spark's quotes; distinct counts as sizes of sets, which takes one pass where several distinct counts would multiply the rows."""
    quoted = {k: v.replace('"end"', "`end`").replace('"start"', "`start`") for k, v in named.items()}
    return {k: re.sub(r"count\(distinct (\w+)\)", r"size(collect_set(\1))", v) for k, v in quoted.items()}


def multiflow(windowed: DataFrame, keys: list[str], least: int = 20, digits: int = 6) -> DataFrame:
    """Figures of the flows in a window: counts, the busiest one's shares, statistics and Gini coefficients of their packets and bytes. Windows with fewer packets fall."""
    by = windowed.groupBy(*keys, "flow").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("rel").alias("first"))
    at = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, "flow"))
    return by.withColumn("rank_n", at("n")).withColumn("rank_bytes", at("bytes")).groupBy(*keys).agg(*rounded(MULTIFLOW, digits)).filter(F.col("n_pkt") >= least)


def _gini(x: str, rank: str) -> str:
    return f"case when sum({x}) > 0 then 2.0 * sum({rank} * {x}) / (count(*) * sum({x})) - (count(*) + 1.0) / count(*) else 0 end"


MULTIFLOW = {"n_flows": "count(*)", "n_pkt": "sum(n)", "bytes": "sum(bytes)", "top_pkt_share": "max(n) / cast(sum(n) as double)", "top_share": "max(bytes) / cast(sum(bytes) as double)", "pkt_gini": _gini("n", "rank_n"), "byte_gini": _gini("bytes", "rank_bytes")} | stats8("bytes", "flow_bytes") | stats8("n", "flow_pkts")


def tumbling(ctx: DataFrame, size: float, least: int = 5) -> DataFrame:
    """Windows of each session from its own first packet on; sessions shorter than one window, and windows of fewer packets, are left out. Adds k."""
    s = Window.partitionBy(*SESSION)
    w = Window.partitionBy(*SESSION, "k")
    span = F.max("ts").over(s) - F.min("ts").over(s)
    return ctx.withColumn("_span", span).filter(F.col("_span") >= size).withColumn("k", F.floor((F.col("ts") - F.col("t0")) / size)).withColumn("_c", F.count("*").over(w)).filter(F.col("_c") >= least).drop("_span", "_c")


def flow_window64() -> dict[str, str]:
    """Figures of a window of one session; gap (0 for its first packet) and diat are within the window."""
    up, down = "direction = 1", "direction = -1"
    n, span = "count(*)", "greatest(max(ts) - min(ts), 1e-9)"
    fb, bb = f"coalesce(sum(length) FILTER (WHERE {up}), 0)", f"coalesce(sum(length) FILTER (WHERE {down}), 0)"
    out = {
        "n_packets": n, "duration": span, "total_bytes": "sum(length)", "total_payload_bytes": "sum(payload_length)", "fwd_packets": f"count_if({up})", "bwd_packets": f"count_if({down})", "fwd_bytes": fb, "bwd_bytes": bb,
        "packet_rate": f"{n} / {span}", "byte_rate": f"sum(length) / {span}", "payload_ratio": share("sum(payload_length)", "sum(length)"), "fwd_bwd_packet_ratio": f"count_if({up}) / greatest(count_if({down}), 1)",
        "fwd_bwd_byte_ratio": f"({fb}) / greatest({bb}, 1)", "direction_changes": CHANGES, "direction_change_rate": share(CHANGES, f"{n} - 1"),
    }
    out |= stats8("length", "pkt") | stats8("payload_length", "payload") | stats8("coalesce(iat, 0)", "iat") | stats8("length", "fwd_pkt", up, 5) | stats8("length", "bwd_pkt", down, 5)
    for p, w in (("fwd", up), ("bwd", down)):
        f = f" FILTER (WHERE {w})"
        out |= {f"{p}_iat_mean": f"coalesce(avg(iat){f}, 0)", f"{p}_iat_std": f"coalesce(stddev_pop(iat){f}, 0)", f"{p}_iat_max": f"coalesce(max(iat){f}, 0)", f"{p}_iat_median": f"coalesce(percentile(iat, 0.5){f}, 0)"}
    out |= {"header_mean": "avg(header)", "header_std": "stddev_pop(header)", "header_min": "min(header)"}
    for name, (a, b) in {"ff": (1, 1), "fb": (1, -1), "bf": (-1, 1), "bb": (-1, -1)}.items():
        out[f"dir2_{name}"] = share(f"count_if(prev_dir is not null and prev_dir = {a} and direction = {b})", f"{n} - 1")
    return out


def top_flows(windowed: DataFrame, keys: list[str], k: int, flow: str = "flow") -> DataFrame:
    """The k flows of each window with the most bytes (ties: smallest id), with their share of the window's bytes."""
    by = windowed.groupBy(*keys, flow).agg(F.sum("length").alias("bytes"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return by.withColumn("rank", F.row_number().over(w.orderBy(F.desc("bytes"), flow))).withColumn("byte_share", F.round(F.col("bytes") / F.sum("bytes").over(w), 6)).filter(F.col("rank") <= k)


def overlap_label(start: Column, end: Column, window_start: Column, window_end: Column, label: Column, least: float = 0.5, other: str = "background") -> Column:
    """The label if the interval covers at least so much of the window."""
    both = F.greatest(F.least(end, window_end) - F.greatest(start, window_start), F.lit(0.0))
    return F.when(both / (window_end - window_start) >= least, label).otherwise(F.lit(other))


def temporal_vote(rows: DataFrame, size: int, keys: list[str], order: str = "window_start", label: str = "label", confidence: str = "confidence") -> DataFrame:
    """Votes of blocks of `size` windows in time order; blocks of one are left out. Most frequent label, then larger summed confidence, then earliest."""
    block = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size)
    by = rows.withColumn("block", block).groupBy(*keys, "block", F.col(label).alias("label")).agg(F.count("*").alias("votes"), F.sum(confidence).alias("weight"), F.avg(confidence).alias("confidence"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys, "block")
    ranked = by.withColumn("n", F.sum("votes").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("votes"), F.desc(F.round("weight", 9)), "first")))
    return ranked.filter("_r = 1 and n >= 2").select(*keys, "block", "label", "votes", "n", F.round("confidence", 6).alias("confidence"))


def causal_vote(rows: DataFrame, k: int, keys: list[str], order: str, positive: str = "positive") -> DataFrame:
    """Adds voted: 1 if over half of the last k rows (this one included) are positive."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k - 1), 0)
    return rows.withColumn("voted", (F.sum(positive).over(w) * 2 > F.count("*").over(w)).cast("int"))


def merge_events(rows: DataFrame, keys: list[str], gap: float, drop: tuple[str, ...] = ("unknown", "background")) -> DataFrame:
    """Neighbouring windows of one label, up to gap after the end so far, become one event."""
    w = Window.partitionBy(*keys).orderBy("window_start", "window_end")
    kept = rows.filter(~F.col("label").isin(*drop))
    ends = kept.withColumn("_p", F.lag("label").over(w)).withColumn("_e", F.max("window_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    cut = ends.withColumn("event", F.sum(F.when(F.col("_p").isNull() | (F.col("_p") != F.col("label")) | (F.col("window_start") - F.col("_e") > gap), 1).otherwise(0)).over(w))
    return cut.groupBy(*keys, "event", "label").agg(F.min("window_start").alias("t"), F.max("window_end").alias("end"), F.count("*").alias("n_windows"), F.round(F.avg("confidence"), 6).alias("confidence"))


def thinned(rows: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """At most cap rows within keys, evenly spaced from first to last."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    # Row i is kept if some j below cap has floor(j * (n - 1) / (cap - 1)) = i.
    j = F.ceil(F.col("_i") * (cap - 1) / (F.col("_n") - 1) - 1e-9)
    keep = (F.col("_n") <= cap) | (F.floor(j * (F.col("_n") - 1) / (cap - 1) + 1e-9) == F.col("_i"))
    return numbered.filter(keep).drop("_i", "_n")
