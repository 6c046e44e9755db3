"""Queries on time windows, votes and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import exprs as X
from netloom.operators import sessions as S
from netloom.operators import windows as W
from netloom.plans import binding as B
from netloom.plans.flow_queries import KEYS

QUERIES: dict = {}
ORACLES: dict = {}
WIN = ["capture_id", "k"]
SIZE, STEP, SEGMENT = 5, 1, 2
#: Of the wider windows.
WIDE, WIDE_STEP, TUMBLE = 45, 45, 60


def _sliding_sql(size: float, step: float, name: str) -> str:
    return f"""{name}_o AS (SELECT capture_id, arg_min(ts, pkt_idx) AS origin FROM pkt GROUP BY ALL), {name}_r AS (SELECT p.*, p.ts - o.origin AS rel FROM pkt p JOIN {name}_o o USING (capture_id) WHERE p.ts - o.origin >= 0),
    {name} AS (SELECT *, unnest(range(greatest(CAST(floor((rel - {size}) / {step}) AS BIGINT) + 1, 0), CAST(floor(rel / {step}) AS BIGINT) + 1)) AS k FROM {name}_r)"""


def q_sliding_window_features(spark, sf_dir):
    return W.behavior41(W.sliding(_six(spark, sf_dir), SIZE, STEP), SIZE, SEGMENT, WIN)


def _six(spark, sf_dir):
    """What windows read of packets: they repeat them, so nothing else travels."""
    return B.packets(spark, sf_dir).select("capture_id", "flow", "pkt_idx", "ts", "direction", "length")


QUERIES["q_sliding_window_features"] = q_sliding_window_features
SEG_SQL = f"""{B.PKT}, {_sliding_sql(SIZE, STEP, 'sw')},
c AS (SELECT *, CASE WHEN rel - lag(rel) OVER (PARTITION BY capture_id, k, flow ORDER BY pkt_idx) > {SEGMENT} THEN 1 ELSE 0 END AS b FROM sw),
d AS (SELECT *, sum(b) OVER (PARTITION BY capture_id, k, flow ORDER BY pkt_idx) AS seg FROM c),
e AS (SELECT capture_id, k, flow, seg, min(rel) AS "start", max(rel) AS "end", min(pkt_idx) AS first_idx, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes, avg(length) AS mean_len, stddev_pop(length) AS std_len,
count_if(direction = 1) AS up, CAST(coalesce(sum(length) FILTER (WHERE direction = 1), 0) AS BIGINT) AS up_bytes FROM d GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY capture_id, k ORDER BY "start", first_idx) - 1 AS slot FROM e),
v AS (SELECT *, ts - lag(ts) OVER w AS iat, lag(direction) OVER w AS prev_dir FROM sw WINDOW w AS (PARTITION BY capture_id, k ORDER BY pkt_idx))"""
ORACLES["q_sliding_window_features"] = f"""WITH {SEG_SQL}, g AS (SELECT capture_id, k, {X.rounded_ansi(W.slot_features())} FROM f GROUP BY capture_id, k), h AS (SELECT capture_id, k, count_if(prev_dir IS NOT NULL AND prev_dir <> direction) AS dir_changes FROM v GROUP BY ALL)
SELECT g.*, dir_changes, round(greatest({SIZE}.0::DOUBLE - active_span, 0), 6) AS idle FROM g JOIN h USING (capture_id, k)"""


def q_tunnel_window64(spark, sf_dir):
    out = W.tunnel64(W.sliding(_six(spark, sf_dir), SIZE, STEP), SIZE, SEGMENT, WIN)
    assert len(out.columns) == len(WIN) + 64
    return out


QUERIES["q_tunnel_window64"] = q_tunnel_window64
ORACLES["q_tunnel_window64"] = f"""WITH {SEG_SQL}, m AS (SELECT capture_id, k, {X.rounded_ansi(W.window64())} FROM v GROUP BY capture_id, k),
s AS (SELECT capture_id, k, count(*)::DOUBLE AS n_seg, count_if(slot >= 3)::DOUBLE AS overflow_n_seg, round(coalesce(sum(bytes) FILTER (WHERE slot >= 3), 0) / greatest(sum(bytes), 1), 6) AS overflow_byte_ratio FROM f GROUP BY capture_id, k),
u AS (SELECT capture_id, k, length, count(*) AS c FROM sw GROUP BY ALL), z AS (SELECT capture_id, k, round({X.entropy_of_counts('c')}, 6) AS size_entropy, round(max(c) / sum(c), 6) AS size_mode_ratio FROM u GROUP BY capture_id, k)
SELECT *, round(greatest({SIZE}.0::DOUBLE - active_span, 0), 6) AS idle, CASE WHEN k > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS truncated_prefix FROM m JOIN s USING (capture_id, k) JOIN z USING (capture_id, k)"""


def q_window_size_entropy(spark, sf_dir):
    return W.value_entropy(W.sliding(B.packets(spark, sf_dir), SIZE, STEP), WIN, "length", "size")


QUERIES["q_window_size_entropy"] = q_window_size_entropy
ORACLES["q_window_size_entropy"] = f"WITH {B.PKT}, {_sliding_sql(SIZE, STEP, 'sw')}, c AS (SELECT capture_id, k, length, count(*) AS c FROM sw GROUP BY ALL) SELECT capture_id, k, round({X.entropy_of_counts('c')}, 6) AS size_entropy, round(max(c) / sum(c), 6) AS size_mode_ratio FROM c GROUP BY capture_id, k"

TUM_SQL = f"""{B.CTX}, tu1 AS (SELECT *, CAST(floor((ts - t0) / {TUMBLE}) AS BIGINT) AS k FROM ctx QUALIFY max(ts) OVER (PARTITION BY {KEYS}) - min(ts) OVER (PARTITION BY {KEYS}) >= {TUMBLE}),
tu AS (SELECT * FROM tu1 QUALIFY count(*) OVER (PARTITION BY {KEYS}, k) >= 5)"""


def q_flow_window64(spark, sf_dir):
    keys = [*S.SESSION, "k"]
    t = W.within(W.tumbling(B.ctx(spark, sf_dir), TUMBLE), keys)
    return t.groupBy(*keys).agg(*X.rounded(W.flow_window64()))


QUERIES["q_flow_window64"] = q_flow_window64
ORACLES["q_flow_window64"] = f"WITH {TUM_SQL}, v AS (SELECT * REPLACE (ts - lag(ts) OVER w AS iat, lag(direction) OVER w AS prev_dir) FROM tu WINDOW w AS (PARTITION BY {KEYS}, k ORDER BY pkt_idx)) SELECT {KEYS}, k, {X.rounded_ansi(W.flow_window64())} FROM v GROUP BY {KEYS}, k"

#: Widths and steps of windows over all flows.
MULTI = [(30, 30), (45, 45), (60, 30)]


def q_multiflow_window(spark, sf_dir):
    p = _six(spark, sf_dir)
    parts = [W.multiflow(W.sliding(p, size, step), WIN).withColumn("width", F.lit(size)).withColumn("step", F.lit(step)) for size, step in MULTI]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["q_multiflow_window"] = q_multiflow_window
ORACLES["q_multiflow_window"] = " UNION ALL ".join(
    f"""(WITH {B.PKT}, {_sliding_sql(size, step, 'sw')}, f AS (SELECT capture_id, k, flow, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM sw GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, k ORDER BY n, flow) AS rank_n, row_number() OVER (PARTITION BY capture_id, k ORDER BY bytes, flow) AS rank_bytes FROM f)
SELECT capture_id, k, {X.rounded_ansi(W.MULTIFLOW)}, {size} AS width, {step} AS step FROM r GROUP BY capture_id, k HAVING sum(n) >= 20)"""
    for size, step in MULTI
)


def q_topk_flows_window(spark, sf_dir):
    return W.top_flows(W.sliding(B.packets(spark, sf_dir), WIDE, WIDE_STEP), WIN, 5)


QUERIES["q_topk_flows_window"] = q_topk_flows_window
ORACLES["q_topk_flows_window"] = f"WITH {B.PKT}, {_sliding_sql(WIDE, WIDE_STEP, 'sw')}, f AS (SELECT capture_id, k, flow, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS n FROM sw GROUP BY ALL) SELECT capture_id, k, flow, bytes, n, row_number() OVER (PARTITION BY capture_id, k ORDER BY bytes DESC, flow) AS rank, round(bytes / sum(bytes) OVER (PARTITION BY capture_id, k), 6) AS byte_share FROM f QUALIFY row_number() OVER (PARTITION BY capture_id, k ORDER BY bytes DESC, flow) <= 5"

#: A labelled window: by mean size, with a confidence from the share of forward packets.
LABEL_SQL = f"""{TUM_SQL}, lw AS (SELECT {KEYS}, k, k * {TUMBLE}.0 AS window_start, (k + 1) * {TUMBLE}.0 AS window_end, CASE WHEN avg(length) < 200 THEN 'background' WHEN avg(length) < 240 THEN 'chat' WHEN avg(length) < 300 THEN 'voice' ELSE 'video' END AS label,
round(count_if(direction = 1) / count(*), 4) AS confidence FROM tu GROUP BY {KEYS}, k)"""


def _labelled(spark, sf_dir):
    t = W.tumbling(B.ctx(spark, sf_dir), TUMBLE)
    mean = F.avg("length")
    label = F.when(mean < 200, "background").when(mean < 240, "chat").when(mean < 300, "voice").otherwise("video")
    return t.groupBy(*S.SESSION, "k").agg(label.alias("label"), F.round(F.count_if(F.col("direction") == 1) / F.count("*"), 4).alias("confidence")).withColumn("window_start", F.col("k") * float(TUMBLE)).withColumn("window_end", (F.col("k") + 1) * float(TUMBLE))


def q_label_overlap(spark, sf_dir):
    """Windows of a session against the interval of its middle half."""
    t = _labelled(spark, sf_dir)
    ends = B.ctx(spark, sf_dir).groupBy(*S.SESSION).agg((F.max("ts") - F.min("t0")).alias("span"))
    j = t.join(ends, S.SESSION)
    return j.select(*S.SESSION, "k", W.overlap_label(F.col("span") / 4, F.col("span") * 3 / 4, F.col("window_start"), F.col("window_end"), F.lit("call")).alias("window_label"))


QUERIES["q_label_overlap"] = q_label_overlap
ORACLES["q_label_overlap"] = f"WITH {LABEL_SQL}, e AS (SELECT {KEYS}, max(ts) - min(t0) AS span FROM ctx GROUP BY ALL) SELECT {KEYS}, k, CASE WHEN greatest(least(span * 3 / 4, window_end) - greatest(span / 4, window_start), 0) / (window_end - window_start) >= 0.5 THEN 'call' ELSE 'background' END AS window_label FROM lw JOIN e USING ({KEYS})"


def q_temporal_vote(spark, sf_dir):
    return W.temporal_vote(_labelled(spark, sf_dir), 3, S.SESSION)


QUERIES["q_temporal_vote"] = q_temporal_vote
ORACLES["q_temporal_vote"] = f"""WITH {LABEL_SQL}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY {KEYS} ORDER BY window_start) - 1) / 3) AS BIGINT) AS block FROM lw),
g AS (SELECT {KEYS}, block, label, count(*) AS votes, sum(confidence) AS weight, avg(confidence) AS confidence, min(window_start) AS first FROM b GROUP BY ALL),
r AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY {KEYS}, block) AS BIGINT) AS n, row_number() OVER (PARTITION BY {KEYS}, block ORDER BY votes DESC, round(weight, 9) DESC, first) AS r FROM g)
SELECT {KEYS}, block, label, votes, n, round(confidence, 6) AS confidence FROM r WHERE r = 1 AND n >= 2"""


def q_causal_vote(spark, sf_dir):
    t = _labelled(spark, sf_dir).withColumn("positive", (F.col("label") == "voice").cast("int"))
    return W.causal_vote(t, 3, S.SESSION, "k").select(*S.SESSION, "k", "positive", "voted")


QUERIES["q_causal_vote"] = q_causal_vote
ORACLES["q_causal_vote"] = f"WITH {LABEL_SQL}, p AS (SELECT *, CASE WHEN label = 'voice' THEN 1 ELSE 0 END AS positive FROM lw) SELECT {KEYS}, k, positive, CAST(sum(positive) OVER w * 2 > count(*) OVER w AS INTEGER) AS voted FROM p WINDOW w AS (PARTITION BY {KEYS} ORDER BY k ROWS 2 PRECEDING)"


def q_window_events(spark, sf_dir):
    return W.merge_events(_labelled(spark, sf_dir), S.SESSION, 1.5)


QUERIES["q_window_events"] = q_window_events
ORACLES["q_window_events"] = f"""WITH {LABEL_SQL}, a AS (SELECT *, lag(label) OVER w AS p, max(window_end) OVER (PARTITION BY {KEYS} ORDER BY window_start, window_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM lw WHERE label NOT IN ('unknown', 'background') WINDOW w AS (PARTITION BY {KEYS} ORDER BY window_start, window_end)),
c AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR p <> label OR window_start - e > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY window_start, window_end) AS BIGINT) AS event FROM a)
SELECT {KEYS}, event, label, CAST(min(window_start) AS DOUBLE) AS t, CAST(max(window_end) AS DOUBLE) AS "end", count(*) AS n_windows, round(avg(confidence), 6) AS confidence FROM c GROUP BY {KEYS}, event, label"""


def q_linspace_thin(spark, sf_dir):
    return W.thinned(_labelled(spark, sf_dir).withColumn("_order", F.struct("flow", "sid", "k")), ["capture_id"], "_order", 40).select(*S.SESSION, "k", "label")


QUERIES["q_linspace_thin"] = q_linspace_thin
ORACLES["q_linspace_thin"] = f"""WITH {LABEL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY flow, sid, k) - 1 AS i, count(*) OVER (PARTITION BY capture_id) AS n FROM lw),
t AS (SELECT DISTINCT capture_id, n, CAST(floor(j * (n - 1) / 39 + 1e-9) AS BIGINT) AS i FROM (SELECT DISTINCT capture_id, n FROM n), range(40) AS r(j)) SELECT {KEYS}, k, label FROM n WHERE n <= 40 OR (capture_id, i) IN (SELECT capture_id, i FROM t)"""


def q_dominant_split(spark, sf_dir):
    """A wide window belongs to the split (by flow) of its busiest flow."""
    by = W.sliding(B.packets(spark, sf_dir), WIDE, WIDE_STEP).groupBy(*WIN, "flow").agg(F.count("*").alias("n"))
    split = F.when(F.col("flow") % 7 < 2, "test").when(F.col("flow") % 7 < 4, "validation").otherwise("train")
    return by.withColumn("split", split).groupBy(*WIN).agg(F.max_by("split", F.struct("n", -F.col("flow"))).alias("split"), F.count("*").alias("n_flows"))


QUERIES["q_dominant_split"] = q_dominant_split
ORACLES["q_dominant_split"] = f"WITH {B.PKT}, {_sliding_sql(WIDE, WIDE_STEP, 'sw')}, f AS (SELECT capture_id, k, flow, count(*) AS n FROM sw GROUP BY ALL), s AS (SELECT *, CASE WHEN flow % 7 < 2 THEN 'test' WHEN flow % 7 < 4 THEN 'validation' ELSE 'train' END AS split FROM f) SELECT capture_id, k, arg_max(split, (n, -flow)) AS split, count(*) AS n_flows FROM s GROUP BY capture_id, k"
