"""Sessions of packets: idle gaps, order of emission, admission, causal prefixes.

A packet table has capture_id, flow (canonical key), pkt_idx (order of arrival), ts (seconds),
direction (1 from the initiator, -1 back), length, payload_length and flags. Everything is in order of
arrival, not of ts. One exchange by (capture_id, flow) serves all that follows,
as later groupings contain these keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOW = ["capture_id", "flow"]
SESSION = [*FLOW, "sid"]


def sessionize(packets: DataFrame, gap: float) -> DataFrame:
    """Adds sid: within a flow, a new session begins where the time since the packet before is over the gap (equal goes on)."""
    w = Window.partitionBy(*FLOW).orderBy("pkt_idx")
    idle = (F.col("ts") - F.lag("ts").over(w)) > gap
    return packets.withColumn("_new", F.coalesce(idle, F.lit(False)).cast("int")).withColumn("sid", F.sum("_new").over(w)).drop("_new")


def context(sessions: DataFrame) -> DataFrame:
    """Adds what packet features need of their neighbours: pos (from 1), t0, iat, diat (to the last packet of the same direction), prev_dir, next_dir, header."""
    w = Window.partitionBy(*SESSION).orderBy("pkt_idx")
    d = Window.partitionBy(*SESSION, "direction").orderBy("pkt_idx")
    return (
        sessions.withColumn("pos", F.row_number().over(w))
        .withColumn("t0", F.first("ts").over(w))
        .withColumn("iat", F.col("ts") - F.lag("ts").over(w))
        .withColumn("prev_dir", F.lag("direction").over(w))
        .withColumn("next_dir", F.lead("direction").over(w))
        .withColumn("diat", F.col("ts") - F.lag("ts").over(d))
        .withColumn("header", F.greatest(F.col("length") - F.col("payload_length"), F.lit(0)))
    )


def islands(rows: DataFrame, starts: Column, name: str, keys: list[str] = SESSION, order: str = "pkt_idx") -> DataFrame:
    """Adds name: the number of rows so far, within keys, at which a new run starts."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w))


def admitted(sessions: DataFrame, packets: int = 3, total_bytes: int = 100) -> DataFrame:
    """Rows of sessions with at least so many packets and bytes."""
    w = Window.partitionBy(*SESSION)
    return sessions.withColumn("_n", F.count("*").over(w)).withColumn("_b", F.sum("length").over(w)).filter((F.col("_n") >= packets) & (F.col("_b") >= total_bytes)).drop("_n", "_b")


def summaries(sessions: DataFrame) -> DataFrame:
    """One row a session, with session_index: closed sessions by the packet that closed them (the next of their flow), then open ones by their first packet."""
    by = sessions.groupBy(*SESSION).agg(
        F.count("*").alias("n_packets"),
        F.sum("length").alias("n_bytes"),
        F.min("pkt_idx").alias("first_pkt"),
        F.min_by("ts", "pkt_idx").alias("start_ts"),
        F.max_by("ts", "pkt_idx").alias("end_ts"),
        F.min_by("direction", "pkt_idx").alias("first_direction"),
    )
    closing = by.withColumn("close_pkt", F.lead("first_pkt").over(Window.partitionBy(*FLOW).orderBy("sid")))
    order = Window.partitionBy("capture_id").orderBy(F.col("close_pkt").asc_nulls_last(), "first_pkt")
    return closing.withColumn("session_index", F.row_number().over(order) - 1).withColumn("duration", F.col("end_ts") - F.col("start_ts"))


def prefix(ctx: DataFrame, packets: int) -> DataFrame:
    """Sessions as they stood after their first packets: totals and TCP state of the prefix only."""
    has = lambda m: F.bool_or(F.col("flags").bitwiseAND(F.lit(m)) != 0)
    syn_ack = F.bool_or(F.col("flags").bitwiseAND(F.lit(18)) == 18)
    syn = F.bool_or((F.col("flags").bitwiseAND(F.lit(2)) != 0) & (F.col("flags").bitwiseAND(F.lit(16)) == 0))
    state = F.when(has(4), "CLOSED").when(has(1), "FIN_WAIT").when(syn & syn_ack, "ESTABLISHED").when(syn, "SYN_SENT").otherwise("ESTABLISHED")
    return (
        ctx.filter(F.col("pos") <= packets)
        .groupBy(*SESSION)
        .agg(
            F.count("*").alias("n_packets"),
            F.sum("length").alias("n_bytes"),
            F.max_by("ts", "pos").alias("end_ts"),
            has(5).alias("is_closed"),
            state.alias("tcp_state"),
            F.count_if(F.col("direction") == 1).alias("fwd_packets"),
        )
    )


def canonical(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """Both ends of a connection, the smaller (address as text, port) first."""
    a, b = F.struct(src_ip.alias("ip"), src_port.alias("port")), F.struct(dst_ip.alias("ip"), dst_port.alias("port"))
    return F.when(a <= b, F.struct(a.alias("low"), b.alias("high"))).otherwise(F.struct(b.alias("low"), a.alias("high")))


def remote_endpoint(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, src_bytes: Column, dst_bytes: Column) -> Column:
    """The side with a well-known port where just one has it; else the side that sent more; else the destination."""
    s, d = src_port < 1024, dst_port < 1024
    return F.when(s & ~d, src_ip).when(d & ~s, dst_ip).when(src_bytes > dst_bytes, src_ip).otherwise(dst_ip)


def expired(summary: DataFrame, now: Column, timeout: float) -> DataFrame:
    """Sessions (of summaries, with end_ts) that have been idle for longer than the timeout."""
    return summary.filter(now - F.col("end_ts") > timeout)


def state_counters(summary: DataFrame, most_closed: int = 100_000) -> DataFrame:
    """By capture: sessions, those that a later one of their flow closed, and how many of these a queue of so many would have dropped. Nothing is evicted here: tables spill."""
    by = summary.groupBy("capture_id").agg(F.count("*").alias("sessions"), F.count("close_pkt").alias("closed"))
    return by.withColumn("dropped", F.greatest(F.col("closed") - most_closed, F.lit(0))).withColumn("evicted", F.lit(0))
