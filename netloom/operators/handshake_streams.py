"""Handshakes across packets: TLS records put together by direction, QUIC connections, and the session features built on them.

Bytes are taken in order of arrival, before any reordering, one direction of one connection at a time; a task
holds the open record of one such direction, 64 KB at most, so there is no limit over all of them to keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import handshakes as H

#: Bytes of an open record, beyond which it is dropped.
OPEN = 65_536
ENDS = ["capture", "src_ip", "src_port", "dst_ip", "dst_port"]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def fed(held: bytes, payload: bytes) -> tuple[dict | None, bytes]:
    """The figures of the first record that payload completes, and what stays open."""
    held, found = held + payload, None
    while len(held) >= 5 and held[0] == 22 and len(held) >= 5 + int.from_bytes(held[3:5], "big"):
        n = 5 + int.from_bytes(held[3:5], "big")
        found = found or H.figures(held[:n])
        held = held[n:]
    return found, held if held[:1] == b"\x16" and len(held) <= OPEN else b""


def tls_records(packets: DataFrame) -> DataFrame:
    """ENDS, pkt_idx and the figures of the first handshake record that a TCP packet completes; a FIN or RST drops what is open in its direction. packets: decoded ones of a capture source."""
    kinds = ", ".join(f"{k} {v}" for k, v in H.FIGURES.items())
    schema = pa.schema([(k, _ARROW[v]) for k, v in H.FIGURES.items()])
    src = packets.filter("protocol = 6").select(*ENDS, "pkt_idx", "tcp_flags", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, b""
        for b in batches:
            keep, found = [], []
            ends = list(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
            for i, (end, flags, payload) in enumerate(zip(ends, b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True)):
                if end != now:
                    now, held = end, b""
                if payload:
                    got, held = fed(held, payload)
                    if got:
                        keep.append(i)
                        found.append(got)
                if flags & 5:
                    held = b""
            rows = pa.RecordBatch.from_pylist(found, schema=schema)
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(keep, pa.int64())) for i in range(6)], *rows.columns], names=[*ENDS, "pkt_idx", *H.FIGURES])

    dealt = src.repartition(*ENDS).sortWithinPartitions(*ENDS, "pkt_idx")
    return dealt.mapInArrow(run, f"capture string, src_ip string, src_port int, dst_ip string, dst_port int, pkt_idx long, {kinds}")


def quic_initials(packets: DataFrame) -> DataFrame:
    """capture, pkt_idx, version, dcid, scid (hex), token_length, token_md5, size of UDP packets that are QUIC Initials."""
    src = packets.filter("protocol = 17").filter(H.is_quic(F.col("payload"))).select("capture", "pkt_idx", "payload")
    names = ["version", "dcid", "scid", "token_length", "token_md5"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, q, len(p)) for i, p in enumerate(b.column(2).to_pylist()) if (q := H.quic(p)) and q["long"]]
            rows = pa.array([i for i, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *[pa.array([q[n] for _, q, _ in found], k) for n, k in zip(names, kinds, strict=True)], pa.array([n for _, _, n in found], pa.int64())], names=["capture", "pkt_idx", *names, "size"])

    return src.mapInArrow(run, "capture string, pkt_idx long, version long, dcid string, scid string, token_length int, token_md5 string, size long")


def quic_connections(initials: DataFrame) -> DataFrame:
    """At each Initial, what is known of its connection (both ids) in its capture so far: version's kinds, lengths of ids, the first token, number and bytes of Initials, a hash of the ids."""
    so_far = Window.partitionBy("capture", "dcid", "scid").orderBy("pkt_idx").rowsBetween(Window.unboundedPreceding, 0)
    first = lambda c: F.first(c).over(so_far)
    version = first("version")
    return initials.select(
        "capture", "pkt_idx", version.alias("quic_version"), F.coalesce(*[F.when(version == v, F.lit(n)) for v, n in H.QUIC_VERSIONS.items()], F.concat(F.lit("Unknown (0x"), F.lpad(F.lower(F.hex(version)), 8, "0"), F.lit(")"))).alias("quic_version_name"),
        (F.length("dcid") / 2).cast("int").alias("quic_dest_cid_length"), (F.length("scid") / 2).cast("int").alias("quic_src_cid_length"), F.count("*").over(so_far).alias("quic_num_initial_packets"), F.sum("size").over(so_far).alias("quic_total_initial_bytes"),
        (first("token_length") > 0).cast("int").alias("quic_has_token"), first("token_length").alias("quic_token_length"), first("token_md5").alias("quic_token_hash"), (version == 1).cast("int").alias("quic_is_v1"), (version == 0x6B3343CF).cast("int").alias("quic_is_v2"),
        (F.shiftright(version, 24) == 255).cast("int").alias("quic_is_draft"), version.isin(*H.QUIC_GOOGLE).cast("int").alias("quic_is_google"), F.substring(F.md5(F.unhex(F.concat("dcid", "scid"))), 1, 16).alias("quic_cid_hash"),
    )


#: Session features that come from the first handshake figures of a session, as SQL over those.
PROTOCOL = {
    "tls_version": "tls_version", "tls_has_sni": "if(ch_sni <> '', 1, 0)", "tls_sni_length": "ch_sni_length", "tls_num_cipher_suites": "ch_num_cipher_suites", "tls_num_extensions": "ch_num_extensions", "tls_num_supported_versions": "ch_num_supported_versions",
    "tls_num_supported_groups": "ch_num_supported_groups", "tls_num_signature_algorithms": "ch_num_signature_algorithms", "tls_has_h2": "has_h2", "tls_has_http11": "has_http11", "tls_has_tls13_ciphers": "has_tls13_ciphers", "tls_num_certificates": "num_certificates",
    "tls_handshake_bytes": "total_handshake_bytes", "tls_has_encrypted_extensions": "has_encrypted_extensions", "tls_ja3_hash_prefix": "conv(substring(ja3_hash, 1, 8), 16, 10) / 4294967295.0D", "tls_ja4_hash_prefix": "conv(substring(ja4_hash, 1, 8), 16, 10) / 4294967295.0D",
    "quic_is_present": "if(quic_version <> 0, 1, 0)", "quic_version": "quic_version", "quic_is_v1": "quic_is_v1", "quic_has_token": "quic_has_token", "quic_token_length": "quic_token_length",
}


def protocol_features(packets: DataFrame, keys: list[str]) -> DataFrame:
    """keys and PROTOCOL of each group of decoded packets: of the first packet with figures of TLS or QUIC; all 0 where there is none."""
    tls, quic = tls_records(packets).drop(*ENDS[1:]), quic_connections(quic_initials(packets))
    known = tls.unionByName(quic, allowMissingColumns=True)
    met = packets.select(*keys, "pkt_idx", *(["capture"] if "capture" not in keys else [])).join(known, ["capture", "pkt_idx"], "left")
    columns = [c for c in known.columns if c not in ("capture", "pkt_idx")]
    there = F.coalesce("tls_version", "quic_version").isNotNull()
    first = met.groupBy(*keys).agg(F.min_by(F.when(there, F.struct(*columns)), F.when(there, F.col("pkt_idx"))).alias("h")).select(*keys, "h.*")
    return first.select(*keys, *[F.coalesce(F.expr(e).cast("double"), F.lit(0.0)).alias(n) for n, e in PROTOCOL.items()])


def payload_entropy(packets: DataFrame, keys: list[str], first_packets: int = 100, first_bytes: int = 128) -> DataFrame:
    """keys and payload_byte_entropy (bits) of the first bytes of the first packets of each group: counts of byte values, which is at most 256 rows a group."""
    w = Window.partitionBy(*keys).orderBy("pkt_idx")
    head = packets.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first_packets).select(*keys, F.hex(F.substring("payload", 1, first_bytes)).alias("x"))
    values = head.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("x"), F.lit(1)), F.lit(2)), lambda i: F.substr(F.col("x"), i, F.lit(2)))).alias("v"))
    counts = values.groupBy(*keys, "v").agg(F.count_if(F.col("v") != "").alias("c"))
    used = F.filter(F.collect_list("c"), lambda c: c > 0)
    total = F.aggregate(used, F.lit(0).cast("long"), lambda a, c: a + c)
    return counts.groupBy(*keys).agg(F.when(total > 0, F.aggregate(F.transform(used, lambda c: c / total), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0).alias("payload_byte_entropy"))


def encrypted_share(packets: DataFrame, keys: list[str], least: int = 1024, printable: float = 0.70) -> DataFrame:
    """keys and encrypted: 1 if under `printable` of a group's first bytes (at least so many) can be printed; groups with fewer have null."""
    w = Window.partitionBy(*keys).orderBy("pkt_idx").rowsBetween(Window.unboundedPreceding, -1)
    head = packets.withColumn("_n", F.coalesce(F.sum("payload_length").over(w), F.lit(0))).filter(F.col("_n") < least)
    text = F.regexp_replace(F.decode("payload", "ISO-8859-1"), r"[^\x20-\x7e\t\r\n]", "")
    sums = head.groupBy(*keys).agg(F.sum("payload_length").alias("n"), F.sum(F.length(text)).alias("p"))
    return sums.select(*keys, F.when(F.col("n") >= least, (F.col("p") / F.col("n") < printable).cast("int")).alias("encrypted"))
