"""Feature profiles, and extraction of just what is asked for.

A profile fixes what an observation is, how many packets and features it has, and which features it must not use.
`extract` evaluates only the families that hold a requested feature: those that are sums over packets share one groupBy, whose
list holds the requested expressions alone; families that need runs, periods or counts of values have plans of their own, made only if asked for.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import exprs as X
from netloom.operators import complexity
from netloom.operators import flow_features as FF
from netloom.operators.sessions import SESSION

#: The features of the two small profiles, in order.
FAST16 = ("duration", "total_packets", "total_bytes", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes", "fwd_bwd_byte_ratio", "pkt_size_mean", "pkt_size_std", "pkt_size_max", "pkt_size_min", "fwd_pkt_size_mean", "bwd_pkt_size_mean", "iat_mean", "iat_std")
FAST32 = (*FAST16, "iat_max", "fwd_iat_mean", "bwd_iat_mean", "num_bursts", "pkts_first_0_5s", "packet_rate", "byte_rate", "down_up_byte_ratio", "fwd_pkt_size_max", "bwd_pkt_size_std", "tls_has_sni", "tls_sni_length", "tls_num_cipher_suites", "tls_num_extensions", "tls_has_tls13_ciphers", "num_retransmissions")
#: Features that tell who talks rather than how.
IDENTIFIERS = ("dst_ip", "dst_port", "is_well_known_dst_port", "is_well_known_src_port", "protocol_tcp", "protocol_udp", "quic_sni", "quic_useragent", "quic_version", "src_ip", "src_port", "tls_has_sni", "tls_ja3_hash_prefix", "tls_ja4_hash_prefix", "tls_sni", "tls_sni_length", "tls_version")
#: What each profile prescribes.
PROFILES = {
    "full": {"observation_unit": "flow", "max_packets": None, "feature_budget": None, "temporal_vote": 1, "task": None, "forbidden_features": ()},
    "fast16": {"observation_unit": "flow_prefix", "max_packets": 32, "feature_budget": 16, "temporal_vote": 1, "task": None, "forbidden_features": ()},
    "fast32": {"observation_unit": "flow_prefix", "max_packets": 32, "feature_budget": 32, "temporal_vote": 1, "task": None, "forbidden_features": ()},
    "application64": {"observation_unit": "flow_prefix", "max_packets": 64, "feature_budget": 64, "temporal_vote": 1, "task": "app", "forbidden_features": IDENTIFIERS},
    "behavior15": {"observation_unit": "flow_window", "max_packets": None, "feature_budget": 64, "temporal_vote": 1, "task": "behavior", "forbidden_features": IDENTIFIERS, "window": 15.0, "least_packets": 5},
    "tunnel15": {"observation_unit": "tunnel_flow_window", "max_packets": None, "feature_budget": 64, "temporal_vote": 3, "task": "tool", "forbidden_features": IDENTIFIERS, "window": 15.0, "least_packets": 5, "windows_per_file": 200},
}


def profile(name: str | None, task: str | None = None) -> dict:
    """A copy of a profile; None is full. One made for another task is an error; plain profiles observe windows where the task is behavior."""
    name = name or "full"
    if name not in PROFILES:
        raise ValueError(f"no profile {name}")
    out = copy.deepcopy(PROFILES[name]) | {"profile_name": name}
    if out["task"] and task and out["task"] != task:
        raise ValueError(f"{name} is made for {out['task']}, not {task}")
    if task == "behavior" and name in ("full", "fast16", "fast32"):
        out["observation_unit"] = "behavior_window"
    return out


def profile_features(name: str | None) -> tuple[str, ...] | None:
    """The features of a small profile; None where nothing is left out."""
    if name in (None, "full"):
        return None
    if name not in ("fast16", "fast32"):
        raise ValueError(f"no list of features for {name}")
    return FAST16 if name == "fast16" else FAST32


def smallest_profile(features: Iterable[str]) -> str:
    wanted = set(features)
    return "fast16" if wanted <= set(FAST16) else "fast32" if wanted <= set(FAST32) else "full"


def allowed(rows: DataFrame, spec: dict) -> DataFrame:
    """Without the columns that a profile forbids."""
    return rows.drop(*[c for c in spec["forbidden_features"] if c in rows.columns])


def common_shape(features: Iterable[str]) -> list[str]:
    """Features that any capture has: no identifiers, handshakes, flags, windows, round trips or retransmissions."""
    flags = tuple(f"{n}_flag_count" for n in X.TCP_FLAGS)
    out = lambda f: f in IDENTIFIERS or f.startswith(("tls_", "quic_", "protocol_", "tcp_window_")) or f.endswith(flags) or "rtt" in f or "retrans" in f
    return [f for f in features if not out(f)]


def broad(features: Iterable[str]) -> list[str]:
    return [f for f in features if f not in IDENTIFIERS]


def pools(features: Iterable[str]) -> dict[str, list[str]]:
    """Named pools: sequences, handshakes, all without ports, and that with fingerprints."""
    every = list(features)
    prints = ("tls_ja3_hash_prefix", "tls_ja4_hash_prefix")
    no_port = [f for f in every if "port" not in f and f not in prints]
    return {"sequence": [f for f in every if f.startswith("seq_")], "handshake": [f for f in every if f.startswith(("tls_", "quic_")) and f not in prints], "no_port": no_port, "with_prints": [*no_port, *[f for f in every if f in prints]]}


def _bulk() -> dict[str, str]:
    out = {}
    for p, d in (("fwd", "direction = 1"), ("bwd", "direction = -1")):
        size = f"coalesce(sum(bytes) FILTER (WHERE {d}), 0)"
        out |= {f"{p}_bulk_count": f"count_if({d})", f"{p}_bulk_total_bytes": size, f"{p}_bulk_total_packets": f"coalesce(sum(n) FILTER (WHERE {d}), 0)", f"{p}_avg_bulk_size": f"coalesce(avg(bytes) FILTER (WHERE {d}), 0)", f"{p}_avg_bulk_rate": f"{size} / greatest(max(span), 0.001)"}
    return out


def _span(ctx: DataFrame) -> DataFrame:
    return ctx.withColumn("span", F.max("ts").over(Window.partitionBy(*SESSION)) - F.min("ts").over(Window.partitionBy(*SESSION)))


def _bulks(ctx: DataFrame, least: int = 4) -> DataFrame:
    return FF.runs(_span(ctx)).groupBy(*SESSION, "run", "direction").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.max("span").alias("span")).filter(F.col("n") >= least)


#: Families that are sums over a session's packets.
SUMS: dict[str, Callable[[], dict[str, str]]] = {"session_info": FF.session_info, "flow_stats": FF.flow_stats, "timing": FF.timing, "flags": FF.flag_counts, "structure": FF.structure, "directions": FF.directions, "sizes": FF.size_distribution, "cross": FF.crosses}
#: Families with a plan of their own: the rows that are summed (from ctx, idle and burst seconds), and the sums.
TABLES: dict[str, tuple[Callable[[DataFrame, dict], DataFrame], dict[str, str]]] = {
    "active_idle": (lambda c, o: FF.active_idle(c, o["idle"]), X.stats6("seconds", "active", "kind = 'active'") | X.stats6("seconds", "idle", "kind = 'idle'")),
    "bursts": (lambda c, o: FF.bursts(c, o["burst"], o["burst_packets"]), {"num_bursts": "count(*)"} | X.stats6("seconds", "burst_duration") | X.stats6("n", "burst_pkt_count")),
    "bulk": (lambda c, o: _bulks(c), _bulk()),
    "size_entropy": (lambda c, o: FF.size_counts(c), {"pkt_size_entropy": X.entropy_of_counts("c")}),
    "moments": (lambda c, o: c.withColumn("dev", F.col("length") - F.avg("length").over(Window.partitionBy(*SESSION))), FF.moments()),
    "runs": (lambda c, o: FF.runs(c).groupBy(*SESSION, "run").agg(F.count("*").alias("n")), {"longest_same_dir_run": "max(n)"}),
    "packet_words": (lambda c, o: FF.packet_words(c), {f"packet_bow_{i}": f"count_if(word % 32 = {i}) / count(*)" for i in range(32)}),
    "burst_words": (lambda c, o: _burst_words(c, o), {f"burst_bow_{i}": f"count_if(burst_word % 32 = {i}) / count(*)" for i in range(32)}),
    "behavior_words": (lambda c, o: FF.signatures(_burst_words(c, o).withColumn("behavior", F.floor(F.col("slot") / o["words"])).withColumnRenamed("burst_word", "word"), "behavior", "behavior_word"), {f"behavior_bow_{i}": f"count_if(behavior_word % 32 = {i}) / count(*)" for i in range(32)}),
}
COMPLEXITY = ("iat_spectral_entropy", "iat_approximate_entropy", "iat_hurst_exponent")
#: Seconds of idle time, of a burst's gaps, of a burst word, words of a behaviour word; least packets of a burst.
SECONDS = {"idle": 1.0, "burst": 0.5, "burst_packets": 3, "word": 1.0, "words": 5}


def _burst_words(ctx: DataFrame, o: dict) -> DataFrame:
    return FF.signatures(FF.packet_words(ctx).withColumn("slot", F.floor((F.col("ts") - F.col("t0")) / o["word"])), "slot", "burst_word")


def family_of() -> dict[str, str]:
    """Family of every feature."""
    return {n: f for f, build in SUMS.items() for n in build()} | {n: f for f, (_, named) in TABLES.items() for n in named} | dict.fromkeys(COMPLEXITY, "complexity")


def required_families(features: Iterable[str]) -> set[str]:
    known = family_of()
    return {known[f] for f in features if f in known}


def extract(ctx: DataFrame, features: Iterable[str] | None = None, seconds: dict | None = None, digits: int = 6) -> DataFrame:
    """SESSION and the requested features (all, where none are named) in their order; names that no family has yield no column. ctx: sessions.context."""
    known, o = family_of(), SECONDS | (seconds or {})
    wanted = [f for f in dict.fromkeys(features if features is not None else known) if f in known]
    if "src_port" not in ctx.columns:
        wanted = [f for f in wanted if "port" not in f]
    families = required_families(wanted)
    sums = {n: e for f, build in SUMS.items() if f in families for n, e in build().items() if n in wanted}
    out = ctx.groupBy(*SESSION).agg(*X.rounded(sums or {"_n": "count(*)"}, digits))
    for f, (rows, named) in TABLES.items():
        if f in families:
            own = rows(ctx, o).groupBy(*SESSION).agg(*X.rounded({n: e for n, e in named.items() if n in wanted}, digits))
            out = out.join(own, SESSION, "left")
    if "complexity" in families:
        out = out.join(complexity.iat_complexity(ctx), SESSION, "left")
    return out.select(*SESSION, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in wanted])


def matrix(rows: DataFrame, columns: list[str], missing: float | None = None) -> DataFrame:
    """Columns that begin with an underscore, then the given ones in order; those that rows lack, and nulls, are null or `missing`."""
    made = [(F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")) for c in columns]
    return rows.select(*[c for c in rows.columns if c.startswith("_")], *[(F.coalesce(x, F.lit(missing)) if missing is not None else x).alias(c) for x, c in zip(made, columns, strict=True)])


def observation_parts(rows: DataFrame, column: str = "observation_id") -> DataFrame:
    """Adds session and window of ids that end in :bw<session>:<window>; any other id is an error."""
    pattern = r":bw(\d+):(\d+)$"
    bad = F.raise_error(F.concat(F.lit("not an id of a window: "), F.coalesce(column, F.lit("null")))).cast("int")
    part = lambda k: F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, k).cast("int")).otherwise(bad)
    return rows.withColumn("session", part(1)).withColumn("window", part(2))


def by_file(rows: DataFrame, mapping: DataFrame, path: str = "source_file") -> DataFrame:
    """Rows whose file's name (without folders) the mapping knows, with its other columns; unmapped rows fall. mapping: name and more, a row a file."""
    base = rows.withColumn("name", F.element_at(F.split(path, "/"), -1))
    return base.join(mapping, "name")
