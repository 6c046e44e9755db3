"""Queries on profiles: requested features alone, and all families merged. Their SQL is written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import profiles as P
from netloom.operators import sessions as S
from netloom.plans import binding as B
from netloom.plans import flow_queries as FQ
from netloom.plans.flow_queries import KEYS

QUERIES: dict = {}
ORACLES: dict = {}
SECONDS = {"idle": B.IDLE, "burst": B.BURST, "burst_packets": 2, "word": FQ.WORD_WINDOW, "words": FQ.WORDS}


def _ctx(spark, sf_dir):
    return B.ctx(spark, sf_dir).withColumnRenamed("window", "window_size")


def q_profile_fast16(spark, sf_dir):
    """The small profile over the first 32 packets of each session."""
    return P.extract(S.context(_ctx(spark, sf_dir).filter("pos <= 32")), P.profile_features("fast16"))


QUERIES["q_profile_fast16"] = q_profile_fast16
F16 = f"""WITH {B.CTX}, p AS (SELECT * FROM ctx WHERE pos <= 32), a AS (SELECT {KEYS}, max(ts) - min(ts) AS duration, count(*)::DOUBLE AS total_packets, sum(length)::DOUBLE AS total_bytes, count_if(direction = 1)::DOUBLE AS total_fwd_packets, count_if(direction = -1)::DOUBLE AS total_bwd_packets,
sum(CASE WHEN direction = 1 THEN length ELSE 0 END)::DOUBLE AS total_fwd_bytes, sum(CASE WHEN direction = -1 THEN length ELSE 0 END)::DOUBLE AS total_bwd_bytes, avg(length) AS pkt_size_mean, sqrt(greatest(avg(length * length) - avg(length) ** 2, 0)) AS pkt_size_std, max(length)::DOUBLE AS pkt_size_max, min(length)::DOUBLE AS pkt_size_min,
coalesce(avg(CASE WHEN direction = 1 THEN length END), 0) AS fwd_pkt_size_mean, coalesce(avg(CASE WHEN direction = -1 THEN length END), 0) AS bwd_pkt_size_mean, coalesce(avg(iat), 0) AS iat_mean, coalesce(stddev_pop(iat), 0) AS iat_std FROM p GROUP BY {KEYS})"""
ORACLES["q_profile_fast16"] = f"{F16} SELECT {KEYS}, " + ", ".join(f"round({c if c != 'fwd_bwd_byte_ratio' else 'total_fwd_bytes / greatest(total_bwd_bytes, 1)'}, 6) AS {c}" for c in P.FAST16) + " FROM a"


def q_profile_rules(spark, sf_dir):
    """Only what a rule set asks for is extracted; names that no family has fall."""
    wanted = ["iat_mean", "num_bursts", "longest_same_dir_run", "pkt_size_entropy", "no_such_feature"]
    return P.extract(_ctx(spark, sf_dir), wanted, SECONDS)


QUERIES["q_profile_rules"] = q_profile_rules
ORACLES["q_profile_rules"] = f"""WITH {B.CTX}, s AS (SELECT {KEYS}, round(coalesce(avg(iat), 0), 6) AS iat_mean FROM ctx GROUP BY {KEYS}) SELECT {KEYS}, iat_mean, coalesce(num_bursts, 0) AS num_bursts, longest_same_dir_run::DOUBLE AS longest_same_dir_run, pkt_size_entropy
FROM s LEFT JOIN ({FQ.ORACLES['q_bursts']}) b USING ({KEYS}) JOIN ({FQ.ORACLES['q_longest_run']}) r USING ({KEYS}) JOIN ({FQ.ORACLES['q_size_entropy']}) e USING ({KEYS})"""


def q_extract_all(spark, sf_dir):
    """All families that are figures of packets, merged: one row a session."""
    features = [f for f, family in P.family_of().items() if family not in ("complexity", "moments")]
    return P.extract(_ctx(spark, sf_dir), features, SECONDS)


_PARTS = ["q_flow_stats", "q_flow_timing", "q_flow_flags", "q_flow_structure", "q_direction_patterns", "q_size_quantiles", "q_cross_features", "q_size_entropy", "q_longest_run", "q_bow_packet", "q_bow_burst", "q_bow_behavior"]
_RATE = ", ".join(f"round(coalesce(sum(CASE WHEN direction = {d} THEN bytes END), 0) / greatest(max(span), 0.001), 6) AS {p}_avg_bulk_rate" for p, d in (("fwd", 1), ("bwd", -1)))
BULK_SQL = f"""{FQ.RUN_SQL}, sp AS (SELECT {KEYS}, max(ts) - min(ts) AS span FROM ctx GROUP BY ALL), bk AS (SELECT {KEYS}, run, direction, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes, max(span) AS span FROM rn JOIN sp USING ({KEYS}) GROUP BY ALL HAVING count(*) >= 4)"""


def _all_sql() -> str:
    optional = {"q_active_idle": FQ.ORACLES["q_active_idle"], "q_bursts": FQ.ORACLES["q_bursts"], "bulk": f"WITH {BULK_SQL} SELECT {KEYS}, " + ", ".join(f"round(count_if(direction = {d})::DOUBLE, 6) AS {p}_bulk_count, round(coalesce(sum(CASE WHEN direction = {d} THEN bytes END), 0)::DOUBLE, 6) AS {p}_bulk_total_bytes, round(coalesce(sum(CASE WHEN direction = {d} THEN n END), 0)::DOUBLE, 6) AS {p}_bulk_total_packets, round(coalesce(avg(CASE WHEN direction = {d} THEN bytes END), 0), 6) AS {p}_avg_bulk_size" for p, d in (("fwd", 1), ("bwd", -1))) + f", {_RATE} FROM bk GROUP BY {KEYS}"}
    joins = "".join(f" JOIN ({FQ.ORACLES[q]}) USING ({KEYS})" for q in _PARTS) + "".join(f" LEFT JOIN ({q}) USING ({KEYS})" for q in optional.values())
    names = [f for f, family in P.family_of().items() if family not in ("complexity", "moments") and "port" not in f]
    first = f"SELECT {KEYS}, round(max(ts) - min(ts), 6) AS duration, max(CASE WHEN flags > 0 THEN 1 ELSE 0 END) AS protocol_tcp, max(CASE WHEN flags > 0 THEN 0 ELSE 1 END) AS protocol_udp FROM ctx GROUP BY {KEYS}"
    return f"SELECT {KEYS}, " + ", ".join(f"coalesce({n}, 0)::DOUBLE AS {n}" for n in names) + f" FROM (WITH {B.CTX} {first}){joins}"


QUERIES["q_extract_all"] = q_extract_all
ORACLES["q_extract_all"] = _all_sql()


def q_feature_pools(spark, sf_dir):
    """The catalogue: family of each feature, and which pools, spaces and profiles it belongs to."""
    family = P.family_of()
    spaces = {"common_shape": set(P.common_shape(family)), "broad": set(P.broad(family)), "fast16": set(P.FAST16), "fast32": set(P.FAST32), "no_port": set(P.pools(family)["no_port"])}
    return spark.createDataFrame([(f, k, *[f in s for s in spaces.values()]) for f, k in family.items()], "feature string, family string, " + ", ".join(f"{s} boolean" for s in spaces))


QUERIES["q_feature_pools"] = q_feature_pools
