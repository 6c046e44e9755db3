"""Features of sessions: counts, sizes, times, flags, bursts, patterns.

Each family is a dictionary of aggregate expressions over the context table (see
sessions.context), so that one groupBy computes as many families as are asked for, and
Catalyst drops those that aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.exprs import TCP_FLAGS, ratio, share, stats6
from netloom.operators.sessions import SESSION, islands

FWD, BWD = "direction = 1", "direction = -1"
DURATION = "(max(ts) - min(ts))"
#: Shortest duration that rates divide by, and times after which packets are counted.
EPS, EARLY = "0.001", [0.1, 0.5, 1.0, 3.0, 5.0]


def session_info() -> dict[str, str]:
    return {
        "duration": DURATION,
        "protocol_tcp": "max(case when flags > 0 then 1 else 0 end)",
        "protocol_udp": "max(case when flags > 0 then 0 else 1 end)",
        "src_port": "min(src_port)",
        "dst_port": "min(dst_port)",
        "is_well_known_src_port": "max(case when src_port < 1024 then 1 else 0 end)",
        "is_well_known_dst_port": "max(case when dst_port < 1024 then 1 else 0 end)",
    }


def flow_stats() -> dict[str, str]:
    n, f, b = "count(*)", f"count_if({FWD})", f"count_if({BWD})"
    all_b, fb, bb = "sum(length)", f"coalesce(sum(length) FILTER (WHERE {FWD}), 0)", f"coalesce(sum(length) FILTER (WHERE {BWD}), 0)"
    out = {"total_fwd_packets": f, "total_bwd_packets": b, "total_fwd_bytes": fb, "total_bwd_bytes": bb, "total_packets": n, "total_bytes": all_b, "fwd_bwd_packet_ratio": ratio(f, b)}
    out |= {f"{p}packet_rate": ratio(c, DURATION, EPS) for p, c in (("", n), ("fwd_", f), ("bwd_", b))}
    out |= {"fwd_bwd_byte_ratio": ratio(fb, bb)}
    out |= {f"{p}byte_rate": ratio(c, DURATION, EPS) for p, c in (("", all_b), ("fwd_", fb), ("bwd_", bb))}
    out |= {"down_up_byte_ratio": ratio(bb, fb)}
    for x, name in (("length", "pkt_size"), ("payload_length", "payload_size")):
        out |= stats6(x, name) | stats6(x, f"fwd_{name}", FWD) | stats6(x, f"bwd_{name}", BWD)
    return out


def timing() -> dict[str, str]:
    """Without active, idle and bursts, which have tables of their own."""
    out = stats6("iat", "iat") | stats6("diat", "fwd_iat", FWD) | stats6("diat", "bwd_iat", BWD)
    return out | {f"pkts_first_{str(t).replace('.', '_')}s": f"count_if(ts - t0 <= {t})" for t in EARLY}


def flag_counts(window: str = "window_size") -> dict[str, str]:
    out = {}
    for p, w in (("", None), ("fwd_", FWD), ("bwd_", BWD)):
        for name, m in TCP_FLAGS.items():
            out[f"{p}{name}_flag_count"] = f"count_if((flags & {m}) <> 0" + (f" AND {w})" if w else ")")
    return out | stats6(window, "tcp_window", f"{window} > 0")


def structure() -> dict[str, str]:
    out = stats6("header", "header_bytes") | stats6("header", "fwd_header_bytes", FWD) | stats6("header", "bwd_header_bytes", f"NOT ({FWD})")
    out |= {"avg_segment_size": "coalesce(avg(payload_length), 0)", "fwd_avg_segment_size": f"coalesce(avg(payload_length) FILTER (WHERE {FWD}), 0)", "bwd_avg_segment_size": f"coalesce(avg(payload_length) FILTER (WHERE NOT ({FWD})), 0)"}
    return out | {"payload_ratio": ratio("sum(payload_length)", "sum(length)")}


def directions() -> dict[str, str]:
    """Without the longest run."""
    pairs = {"ff": (1, 1), "fb": (1, -1), "bf": (-1, 1), "bb": (-1, -1)}
    changes = "count_if(prev_dir IS NOT NULL AND prev_dir <> direction)"
    out = {"direction_changes": changes, "direction_change_rate": share(changes, "count(*) - 1")}
    return out | {f"dir_2gram_{i}": share(f"count_if(prev_dir = {a} AND direction = {b})", "count(*) - 1") for i, (a, b) in enumerate(pairs.values())}


def size_distribution() -> dict[str, str]:
    out = {f"size_quantile_{i}": f"percentile(length, {(i + 1)} / 11.0e0)" for i in range(10)}
    mean, std = "avg(length)", "stddev_pop(length)"
    return out | {"size_iqr": "percentile(length, 0.75) - percentile(length, 0.25)", "size_range": "max(length) - min(length)", "size_cv": f"case when {mean} > 0 then {std} / {mean} else 0 end"}


def crosses() -> dict[str, str]:
    fb, bb = f"coalesce(sum(length) FILTER (WHERE {FWD}), 0)", f"coalesce(sum(length) FILTER (WHERE {BWD}), 0)"
    return {
        "avg_size_x_avg_iat": "avg(length) * coalesce(avg(iat), 0)",
        "updown_ratio_x_duration": f"case when {fb} > 0 then {bb} / greatest({fb}, 1) * {DURATION} else 0 end",
        "pkt_rate_x_avg_size": f"case when {DURATION} > 0 then count(*) / greatest({DURATION}, 1e-9) * avg(length) else 0 end",
        "fwd_burst_x_bwd_burst": f"coalesce(stddev_pop(length) FILTER (WHERE {FWD}), 0) * coalesce(stddev_pop(length) FILTER (WHERE {BWD}), 0)",
    }


def moments(x: str = "length") -> dict[str, str]:
    """Population skewness (from 3 values) and excess kurtosis (from 4), 0 where all are equal; from centred values dev."""
    var = "avg(dev * dev)"
    return {
        "pkt_size_skewness": f"case when count(*) >= 3 and {var} > 1e-12 then avg(dev * dev * dev) / ({var} * sqrt({var})) else 0 end",
        "pkt_size_kurtosis": f"case when count(*) >= 4 and {var} > 1e-12 then avg(dev * dev * dev * dev) / ({var} * {var}) - 3 else 0 end",
    }


def runs(ctx: DataFrame) -> DataFrame:
    """Adds run: the number of the run of packets of one direction."""
    return islands(ctx, F.col("prev_dir").isNull() | (F.col("prev_dir") != F.col("direction")), "run")


def bursts(ctx: DataFrame, gap: float, least: int = 3) -> DataFrame:
    """A row for each burst: neighbours of one direction, gaps up to `gap`, at least so many packets."""
    cut = islands(ctx, F.col("prev_dir").isNull() | (F.col("prev_dir") != F.col("direction")) | (F.col("iat") > gap), "burst")
    return cut.groupBy(*SESSION, "burst").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("seconds"), F.sum("length").alias("bytes")).filter(F.col("n") >= least)


def bulks(ctx: DataFrame, least: int = 4) -> DataFrame:
    """A row for each run of at least so many packets of one direction."""
    return runs(ctx).groupBy(*SESSION, "run", "direction").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), (F.max("ts") - F.min("ts")).alias("seconds")).filter(F.col("n") >= least)


def active_idle(ctx: DataFrame, idle: float) -> DataFrame:
    """A row for each active or idle period of a session: kind, seconds.

    Gaps over `idle` are idle. An active period runs from its first packet to the last one before an idle
    gap, or to the session's end; after an idle gap it begins at the packet before the first short gap. The
    very first period counts even if no short gap is in it; later periods need one.
    """
    gaps = ctx.filter("iat IS NOT NULL").withColumn("is_idle", F.col("iat") > idle).withColumn("from_ts", F.col("ts") - F.col("iat"))
    cut = islands(gaps, F.lag("is_idle").over(_order()).isNull() | (F.lag("is_idle").over(_order()) != F.col("is_idle")), "period")
    periods = cut.groupBy(*SESSION, "period", "is_idle").agg(F.min("pos").alias("p0"), F.min_by("from_ts", "pos").alias("a"), F.max_by("ts", "pos").alias("b"))
    active = periods.filter("NOT is_idle").select(*SESSION, F.lit("active").alias("kind"), (F.col("b") - F.col("a")).alias("seconds"))
    first = periods.filter("is_idle AND p0 = 2").select(*SESSION, F.lit("active").alias("kind"), F.lit(0.0).alias("seconds"))
    idles = gaps.filter("is_idle").select(*SESSION, F.lit("idle").alias("kind"), F.col("iat").alias("seconds"))
    return active.unionAll(first).unionAll(idles)


def _order():
    from pyspark.sql import Window

    return Window.partitionBy(*SESSION).orderBy("pkt_idx")


def size_counts(ctx: DataFrame) -> DataFrame:
    """A row for each session and bin of size: 50 bins of equal width where a size exceeds 255, else the sizes themselves."""
    from pyspark.sql import Window

    w = Window.partitionBy(*SESSION)
    mn, mx = F.min("length").over(w), F.max("length").over(w)
    wide = F.least(F.floor((F.col("length") - F.col("mn")) / ((F.col("mx") - F.col("mn")) / 50)), F.lit(49))
    bin_ = F.when(F.col("mx") <= 255, F.col("length")).when(F.col("mx") == F.col("mn"), F.lit(0)).otherwise(wide)
    return ctx.withColumn("mn", mn).withColumn("mx", mx).withColumn("bin", bin_).groupBy(*SESSION, "bin").agg(F.count("*").alias("c"))


def packet_words(ctx: DataFrame) -> DataFrame:
    """Adds word: 8 for backward packets, plus the quarter of the session's largest size (0 to 3)."""
    from pyspark.sql import Window

    top = F.max("length").over(Window.partitionBy(*SESSION))
    quarter = F.least(F.floor(F.col("length") / F.greatest(top, F.lit(1)) * 4), F.lit(3))
    return ctx.withColumn("word", F.when(F.col("direction") == 1, 0).otherwise(8) + quarter)


def bag(words: DataFrame, prefix: str, word: str = "word", size: int = 32) -> DataFrame:
    """Relative frequency of each word, modulo size."""
    return words.groupBy(*SESSION).agg(*[F.round(F.count_if(F.col(word) % size == i) / F.count("*"), 6).alias(f"{prefix}_{i}") for i in range(size)])


def signatures(words: DataFrame, group: str, out: str) -> DataFrame:
    """One word for each session and group: counts of its words, in order of first appearance, folded by s * 31 + word * count modulo 256."""
    counts = words.groupBy(*SESSION, group, "word").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    listed = counts.groupBy(*SESSION, group).agg(F.array_sort(F.collect_list(F.struct("first", "word", "c"))).alias("bag"), F.min("first").alias("pos"))
    fold = F.aggregate("bag", F.lit(0).cast("long"), lambda s, x: (s * 31 + x["word"] * x["c"]) % 256)
    return listed.select(*SESSION, group, "pos", fold.alias(out))
