"""Queries on the order of packets in sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.functions import exprs as X
from netloom.operators import flow_features as FF
from netloom.operators import sequence as Q
from netloom.operators import sessions as S
from netloom.plans import binding as B
from netloom.plans.flow_queries import KEYS, RUN_SQL

QUERIES: dict = {}
ORACLES: dict = {}

PROG_SQL = f"{B.CTX}, pg AS (SELECT *, count(*) OVER s AS n, CAST(sum(length) OVER s AS DOUBLE) AS total, CAST(sum(length) OVER (PARTITION BY {KEYS} ORDER BY pkt_idx) AS DOUBLE) AS sofar, lag(length) OVER o AS prev_len, lag(iat) OVER o AS prev_iat, max(ts) OVER s AS tn FROM ctx WINDOW s AS (PARTITION BY {KEYS}), o AS (PARTITION BY {KEYS} ORDER BY pkt_idx))"


def _ctx(spark, sf_dir):
    return Q.neighbours(Q.progress(B.ctx(spark, sf_dir))).withColumn("tn", F.max("ts").over(Window.partitionBy(*S.SESSION)))


for _name, _build in (("q_seq_progress", Q.progress_features), ("q_seq_hist", Q.histograms), ("q_seq_transitions", Q.transitions), ("q_seq_position", Q.positions), ("q_seq_density", Q.density)):
    QUERIES[_name] = lambda spark, sf_dir, named=_build(): _ctx(spark, sf_dir).groupBy(*S.SESSION).agg(*X.rounded(named))
    ORACLES[_name] = f"WITH {PROG_SQL} SELECT {KEYS}, {X.rounded_ansi(_build())} FROM pg GROUP BY {KEYS}"

_RUNS = {"n_runs": "count(*)"} | X.stats8("n", "run_len") | X.stats8("n", "fwd_run_len", "direction = 1", 4) | X.stats8("n", "bwd_run_len", "direction = -1", 4) | X.stats6("bytes", "run_bytes")


def q_seq_runs(spark, sf_dir):
    r = FF.runs(B.ctx(spark, sf_dir)).groupBy(*S.SESSION, "run", "direction").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    return r.groupBy(*S.SESSION).agg(*X.rounded(_RUNS))


QUERIES["q_seq_runs"] = q_seq_runs
ORACLES["q_seq_runs"] = f"WITH {RUN_SQL}, r AS (SELECT {KEYS}, run, direction, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM rn GROUP BY ALL) SELECT {KEYS}, {X.rounded_ansi(_RUNS)} FROM r GROUP BY {KEYS}"

LAGS = [1, 2, 3, 4, 5]


def q_seq_autocorr(spark, sf_dir):
    return Q.autocorrelation(B.ctx(spark, sf_dir), LAGS)


QUERIES["q_seq_autocorr"] = q_seq_autocorr
ORACLES["q_seq_autocorr"] = (
    f"WITH {B.CTX}, d AS (SELECT *, length - avg(length) OVER (PARTITION BY {KEYS}) AS dev FROM ctx), e AS (SELECT *, "
    + ", ".join(f"lead(dev, {k}) OVER o AS dev{k}" for k in LAGS)
    + f" FROM d WINDOW o AS (PARTITION BY {KEYS} ORDER BY pkt_idx)) SELECT {KEYS}, "
    + ", ".join(f"round(CASE WHEN sum(dev * dev) > 1e-9 THEN coalesce(sum(dev * dev{k}), 0) / sum(dev * dev) ELSE 0 END, 6) AS seq_ac_{k}" for k in LAGS)
    + f" FROM e GROUP BY {KEYS}"
)


def q_seq_gini(spark, sf_dir):
    counts = B.ctx(spark, sf_dir).groupBy("capture_id", "flow").agg(F.count("*").alias("c"))
    return Q.gini(counts, ["capture_id"], "c", "flow")


QUERIES["q_seq_gini"] = q_seq_gini
ORACLES["q_seq_gini"] = f"WITH {B.CTX}, c AS (SELECT capture_id, flow, count(*) AS c FROM ctx GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY c, flow) AS r FROM c) SELECT capture_id, round(CASE WHEN sum(c) > 0 THEN 2 * sum(r * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*) ELSE 0 END, 6) AS gini, count(*) AS n_counts FROM r GROUP BY capture_id"

BUDGETS = [8, 16, 32, 64, 128]


def _budget(b: int) -> dict[str, str]:
    cond = f"pos <= {b}"
    out = {f"p{b}_packets": f"count_if({cond})", f"p{b}_bytes": f"coalesce(sum(length) FILTER (WHERE {cond}), 0)", f"p{b}_fwd_share": X.share(f"count_if({cond} AND direction = 1)", f"count_if({cond})"), f"p{b}_duration": f"coalesce(max(ts) FILTER (WHERE {cond}) - min(ts) FILTER (WHERE {cond}), 0)"}
    return out | X.stats8("length", f"p{b}_len", cond) | X.stats8("iat", f"p{b}_iat", cond)


_PREFIX = {k: v for b in BUDGETS for k, v in _budget(b).items()}


def q_flow_budgets(spark, sf_dir):
    """Per-flow vectors over the first packets only, for several budgets at once."""
    return B.ctx(spark, sf_dir).groupBy(*S.SESSION).agg(*X.rounded(_PREFIX))


QUERIES["q_flow_budgets"] = q_flow_budgets
ORACLES["q_flow_budgets"] = f"WITH {B.CTX} SELECT {KEYS}, {X.rounded_ansi(_PREFIX)} FROM ctx GROUP BY {KEYS}"

#: Shorter flows are a group of their own.
SHORT = 10
_SCALARS = {"n": "n", "bytes": "bytes", "duration": "duration", "mean_len": "mean_len", "max_len": "max_len", "mean_iat": "mean_iat", "bwd_share": "bwd_share"}
_GROUPS = {"n_flows": "count(*)", "short_share": f"avg(case when n < {SHORT} then 1.0e0 else 0.0e0 end)"}
for _x in _SCALARS:
    _GROUPS |= X.stats8(_x, f"short_{_x}", f"n < {SHORT}") | X.stats8(_x, f"long_{_x}", f"n >= {SHORT}")
_FLOW = {"n": "count(*)", "bytes": "sum(length)", "duration": "max(ts) - min(ts)", "mean_len": "avg(length)", "max_len": "max(length)", "mean_iat": "coalesce(avg(iat), 0)", "bwd_share": "count_if(direction = -1) / cast(count(*) as double)"}


def q_capture_flow_groups(spark, sf_dir):
    """Captures as statistics of their short and long flows' scalars."""
    flows = B.ctx(spark, sf_dir).groupBy(*S.SESSION).agg(*[F.expr(e).cast("double").alias(n) for n, e in _FLOW.items()])
    return flows.groupBy("capture_id").agg(*X.rounded(_GROUPS, 4))


QUERIES["q_capture_flow_groups"] = q_capture_flow_groups
ORACLES["q_capture_flow_groups"] = f"WITH {B.CTX}, f AS (SELECT {KEYS}, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _FLOW.items())} FROM ctx GROUP BY {KEYS}) SELECT capture_id, {X.rounded_ansi(_GROUPS, 4)} FROM f GROUP BY capture_id"
