"""Features of the order of packets in a session: progress, segments, positions, transitions.

They are aggregates over the context table as well; those that need a neighbour at a distance take it
from one more window over the same sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.exprs import histogram, share
from netloom.operators.sessions import SESSION

#: Edges of size and gap histograms, size regimes, gap regimes.
SIZE_EDGES = [32, 64, 128, 256, 512, 768, 1024, 1280, 1500]
GAP_EDGES = [0, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]
SIZE_REGIMES, GAP_REGIMES = (200, 800), (0.01, 0.1)


def progress(ctx: DataFrame) -> DataFrame:
    """Adds n (packets of the session), total (bytes), sofar (bytes up to this packet), and the share of each in the session."""
    w = Window.partitionBy(*SESSION)
    upto = w.orderBy("pkt_idx").rowsBetween(Window.unboundedPreceding, 0)
    return ctx.withColumn("n", F.count("*").over(w)).withColumn("total", F.sum("length").over(w)).withColumn("sofar", F.sum("length").over(upto))


def progress_features(points: list[int] | None = None) -> dict[str, str]:
    """Share of bytes sent once so many percent of packets have been; share of packets that bring so many percent of bytes."""
    out = {}
    for p in points or [10, 25, 50, 75, 90]:
        out[f"cum_bytes_p{p}"] = f"max(case when pos <= greatest(floor(n * {p} / 100.0e0), 1) then sofar end) / max(total)"
        out[f"pkts_for_bytes_p{p}"] = f"min(case when sofar >= total * {p} / 100.0e0 then pos end) / cast(max(n) as double)"
    return out


def histograms() -> dict[str, str]:
    return histogram("length", SIZE_EDGES, "seq_lenhist") | histogram("iat", GAP_EDGES, "seq_iathist")


def transitions() -> dict[str, str]:
    """Shares of pairs of neighbours by direction, by size regime and by gap regime."""
    out = {}
    size = lambda x: f"case when {x} <= {SIZE_REGIMES[0]} then 0 when {x} <= {SIZE_REGIMES[1]} then 1 else 2 end"
    gap = lambda x: f"case when {x} <= {GAP_REGIMES[0]} then 0 when {x} <= {GAP_REGIMES[1]} then 1 else 2 end"
    for i in range(3):
        for j in range(3):
            out[f"seq_len_trans_{i}{j}"] = share(f"count_if(prev_len is not null and {size('prev_len')} = {i} and {size('length')} = {j})", "count(prev_len)")
            out[f"seq_iat_trans_{i}{j}"] = share(f"count_if(prev_iat is not null and {gap('prev_iat')} = {i} and {gap('iat')} = {j})", "count(prev_iat)")
    return out


def neighbours(ctx: DataFrame) -> DataFrame:
    """Adds prev_len and prev_iat."""
    w = Window.partitionBy(*SESSION).orderBy("pkt_idx")
    return ctx.withColumn("prev_len", F.lag("length").over(w)).withColumn("prev_iat", F.lag("iat").over(w))


def positions(first: int = 8) -> dict[str, str]:
    """Signed size, and gap, at each of the first positions; 0 past the end."""
    out = {}
    for i in range(1, first + 1):
        out[f"seq_pos_len_{i}"] = f"coalesce(max(case when pos = {i} then direction * length end), 0)"
        out[f"seq_pos_iat_{i}"] = f"coalesce(max(case when pos = {i} then iat end), 0)"
    return out


def density(parts: int = 6) -> dict[str, str]:
    """Shares of packets and bytes in equal parts of the session's time, and shares of packets and bytes that go forward by quarter of its packets."""
    out = {}
    span = "greatest(tn - t0, 1e-9)"
    for i in range(parts):
        cond = f"least(floor((ts - t0) / {span} * {parts}), {parts - 1}) = {i}"
        out[f"seq_tw_pkt_{i}"] = f"count_if({cond}) / cast(count(*) as double)"
        out[f"seq_tw_byte_{i}"] = f"coalesce(sum(case when {cond} then length end), 0) / cast(sum(length) as double)"
    for q in range(4):
        cond = f"floor((pos - 1) * 4 / n) = {q}"
        out[f"seq_quarter_fwd_{q}"] = share(f"count_if({cond} and direction = 1)", f"count_if({cond})")
    return out


def autocorrelation(ctx: DataFrame, lags: list[int], x: str = "length") -> DataFrame:
    """Of each session: sum of products of deviations at each lag over the sum of their squares; 0 if constant or no longer than the lag."""
    w = Window.partitionBy(*SESSION)
    o = w.orderBy("pkt_idx")
    dev = ctx.withColumn("dev", F.col(x) - F.avg(x).over(w))
    for k in lags:
        dev = dev.withColumn(f"dev{k}", F.lead("dev", k).over(o))
    ss = F.sum(F.col("dev") * F.col("dev"))
    return dev.groupBy(*SESSION).agg(*[F.round(F.when(ss > 1e-9, F.coalesce(F.sum(F.col("dev") * F.col(f"dev{k}")), F.lit(0.0)) / ss).otherwise(0.0), 6).alias(f"seq_ac_{k}") for k in lags])


def gini(counts: DataFrame, keys: list[str], count: str, tie: str) -> DataFrame:
    """Inequality of counts within keys: 0 if all are equal."""
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("_r", F.row_number().over(w.orderBy(count, tie)))
    n, s = F.count("*"), F.sum(count)
    return ranked.groupBy(*keys).agg(F.round(F.when(s > 0, 2 * F.sum(F.col("_r") * F.col(count)) / (n * s) - (n + 1) / n).otherwise(0.0), 6).alias("gini"), n.alias("n_counts"))
