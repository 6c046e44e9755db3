"""Queries on captures, handshakes and streams.

The data folder has no captures. Small ones are made in code, with what should be read from them written out by hand in the
SQL twins; a large one holds all events as packets, is written as capture files, and is read back through the source.
"""

from __future__ import annotations

import io
import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.functions import exprs as X
from netloom.functions import handshakes as H
from netloom.operators import handshake_streams as HS
from netloom.operators import reassembly
from netloom.operators import rules as R
from netloom.operators import sessions as S
from netloom.plans import binding as B
from netloom.plans.matrix_queries import _FAST, DETECT
from netloom.session import scratch
from netloom.sources import capture as C
from netloom.streaming import windows as SW

QUERIES: dict = {}
ORACLES: dict = {}

HELLO = H.hello("example.org", [0x0A0A, 4865, 4866], [29, 23], [772, 771])  # 110 bytes
SERVER = H.server_record(0x1301, "h2", 0x0304, b"c" * 40)  # 116 bytes
#: What fingerprints are hashes of.
JA3, CIPHERS, EXTENSIONS = "771,4865-4866,0-10-43-16-11,29-23,0", "0a0a,1301,1302", "0000,000a,002b,0010,000b"
JA4_SQL = f"sha256('t13d0305_' || sha256('{CIPHERS}')[1:12] || '_' || sha256('{EXTENSIONS}')[1:12])"
JA4S_SQL = "sha256('t13130102_' || sha256('002b,0010')[1:12])"


def _frames() -> list[tuple[float, bytes]]:
    """A connection with a hello, a gap that is filled, a retransmission and a two-sided end; QUIC; a frame with padding."""
    a, b = ("10.0.0.1", 50000), ("10.0.0.2", 443)
    to, fro = (*a, *b), (*b, *a)
    rows = [(to, 2, 100, b""), (fro, 18, 500, b""), (to, 16, 101, b""), (to, 24, 101, HELLO), (to, 24, 216, b"later"), (to, 24, 211, b"early"), (to, 24, 101, HELLO), (fro, 24, 501, b"answer"), (to, 17, 221, b""), (fro, 17, 507, b"")]
    out = [(1.0 + i / 10, C.frame(*w, p, f, s)) for i, (w, f, s, p) in enumerate(rows)]
    return [*out, (3.0, C.frame("10.0.0.1", 50001, "10.0.0.3", 443, _initial(1, b"abcd", b"xy", b"tok"), protocol=17)), (3.1, C.frame("10.0.0.3", 443, "10.0.0.1", 50001, b"\x45" + b"\0" * 9, protocol=17)), (3.2, C.frame("10.0.0.9", 1, "10.0.0.1", 2, b"", 2, 1, pad=6))]


def _initial(version: int, dcid: bytes, scid: bytes, token: bytes) -> bytes:
    return bytes([0xC3]) + struct.pack("!I", version) + bytes([len(dcid)]) + dcid + bytes([len(scid)]) + scid + bytes([len(token)]) + token + b"\x40\x10" + b"\0" * 16


def _split_frames() -> list[tuple[float, bytes]]:
    """Records over several packets: a hello in three, a server's answer with a certificate in two, application data, a hello cut off by a FIN, two records in one packet."""
    to, fro = ("10.1.0.1", 6000, "10.1.0.2", 443), ("10.1.0.2", 443, "10.1.0.1", 6000)
    rows = [(to, 24, HELLO[:40]), (to, 24, HELLO[40:70]), (to, 24, HELLO[70:]), (fro, 24, SERVER[:100]), (fro, 24, SERVER[100:]), (to, 24, b"\x17\x03\x03\x00\x01x"), (to, 17, HELLO[:20]), (to, 24, HELLO[20:]), (("10.1.0.3", 7, "10.1.0.2", 443), 24, HELLO + HELLO)]
    return [(1.0 + i, C.frame(*w, p, f, 1)) for i, (w, f, p) in enumerate(rows)]


def _quic_frames() -> list[tuple[float, bytes]]:
    to = ("10.2.0.1", 5000, "10.2.0.2", 443)
    rows = [(1, b"abcd", b"xy", b"tok"), (1, b"abcd", b"xy", b""), (0xFF00001D, b"q", b"", b""), (1, b"abcd", b"xy", b"other")]
    return [(1.0 + i, C.frame(*to, _initial(*r), protocol=17)) for i, r in enumerate(rows)] + [(9.0, C.frame(*to, b"\xc3\0\0\0\0\0\0\0", protocol=17)), (9.5, C.frame(*to, b"\x05" + b"\0" * 9, protocol=17))]


def _raw(spark, frames):
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    body = b"".join(struct.pack("<IIII", int(t), round((t - int(t)) * 1e6), len(d), len(d)) + d for t, d in frames)
    return spark.createDataFrame([("made.pcap", i, ts, link, data) for i, (ts, link, data) in enumerate(C.packets(io.BytesIO(head + body)))], C.RAW_SCHEMA)


def _decoded(spark, frames):
    return C.decoded(_raw(spark, frames))


def q_pcap_decode(spark, sf_dir):
    return _decoded(spark, _frames()).select("pkt_idx", F.round("ts", 6).alias("ts"), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "length", "payload_length", "tcp_flags", "tcp_seq")


QUERIES["q_pcap_decode"] = q_pcap_decode
ORACLES["q_pcap_decode"] = """SELECT * FROM (VALUES (0, 1.0::DOUBLE, '10.0.0.1', 50000, '10.0.0.2', 443, 6, 40, 0, 2, 100), (1, 1.1, '10.0.0.2', 443, '10.0.0.1', 50000, 6, 40, 0, 18, 500), (2, 1.2, '10.0.0.1', 50000, '10.0.0.2', 443, 6, 40, 0, 16, 101),
(3, 1.3, '10.0.0.1', 50000, '10.0.0.2', 443, 6, 150, 110, 24, 101), (4, 1.4, '10.0.0.1', 50000, '10.0.0.2', 443, 6, 45, 5, 24, 216), (5, 1.5, '10.0.0.1', 50000, '10.0.0.2', 443, 6, 45, 5, 24, 211), (6, 1.6, '10.0.0.1', 50000, '10.0.0.2', 443, 6, 150, 110, 24, 101),
(7, 1.7, '10.0.0.2', 443, '10.0.0.1', 50000, 6, 46, 6, 24, 501), (8, 1.8, '10.0.0.1', 50000, '10.0.0.2', 443, 6, 40, 0, 17, 221), (9, 1.9, '10.0.0.2', 443, '10.0.0.1', 50000, 6, 40, 0, 17, 507), (10, 3.0, '10.0.0.1', 50001, '10.0.0.3', 443, 17, 63, 35, 0, 0),
(11, 3.1, '10.0.0.3', 443, '10.0.0.1', 50001, 17, 38, 10, 0, 0), (12, 3.2, '10.0.0.9', 1, '10.0.0.1', 2, 6, 40, 0, 2, 1)) AS t(pkt_idx, ts, src_ip, src_port, dst_ip, dst_port, protocol, length, payload_length, tcp_flags, tcp_seq)"""


def q_tls_parse(spark, sf_dir):
    """Hellos that fit one packet."""
    return HS.tls_records(_decoded(spark, _frames())).select("pkt_idx", F.col("ch_sni").alias("sni"), F.col("ch_num_cipher_suites").alias("n_ciphers"), F.col("ja3_hash").alias("ja3"), F.col("ja4_hash").alias("short_fingerprint"))


QUERIES["q_tls_parse"] = q_tls_parse
ORACLES["q_tls_parse"] = f"SELECT unnest([3, 6]) AS pkt_idx, 'example.org' AS sni, 3 AS n_ciphers, md5('{JA3}') AS ja3, {JA4_SQL} AS short_fingerprint"


def q_tls_reassembly(spark, sf_dir):
    """Records over several packets, each at the packet that completes it."""
    return HS.tls_records(_decoded(spark, _split_frames())).select("pkt_idx", "src_port", "handshake_messages_count", "total_handshake_bytes", "ch_sni", "ch_num_extensions", "ja3_hash", "sh_cipher_suite")


QUERIES["q_tls_reassembly"] = q_tls_reassembly
ORACLES["q_tls_reassembly"] = f"SELECT * FROM (VALUES (2, 6000, 1, 105, 'example.org', 5, md5('{JA3}'), NULL), (4, 443, 2, 111, NULL, NULL, NULL, 4865), (8, 7, 1, 105, 'example.org', 5, md5('{JA3}'), NULL)) AS t(pkt_idx, src_port, handshake_messages_count, total_handshake_bytes, ch_sni, ch_num_extensions, ja3_hash, sh_cipher_suite)"


def q_tls_server(spark, sf_dir):
    """The server's side: hello, chosen protocol, fingerprints, certificates."""
    return HS.tls_records(_decoded(spark, _split_frames())).filter("sh_cipher_suite IS NOT NULL").select("pkt_idx", "tls_version", "sh_tls_version", "sh_cipher_suite", "sh_num_extensions", "sh_selected_alpn", "ja3s_str", "ja3s_hash", "ja4s_hash", "has_certificate", "num_certificates", "cert_length")


QUERIES["q_tls_server"] = q_tls_server
ORACLES["q_tls_server"] = f"SELECT 4 AS pkt_idx, 771 AS tls_version, 771 AS sh_tls_version, 4865 AS sh_cipher_suite, 2 AS sh_num_extensions, 'h2' AS sh_selected_alpn, '771,4865,43-16' AS ja3s_str, md5('771,4865,43-16') AS ja3s_hash, {JA4S_SQL} AS ja4s_hash, 1 AS has_certificate, 1 AS num_certificates, 40 AS cert_length"


def q_tls_features(spark, sf_dir):
    """The client's figures, all of them."""
    lists = ["ch_compression_methods", "alpn_protocols", "extension_types"]
    cols = [c for c in H.FIGURES if not c.startswith(("sh_", "ja3s", "ja4s", "cert_")) and c not in lists]
    return HS.tls_records(_decoded(spark, _split_frames())).filter("ch_sni IS NOT NULL").select("pkt_idx", *cols, *[F.array_join(c, "-").alias(c) for c in lists])


QUERIES["q_tls_features"] = q_tls_features
ORACLES["q_tls_features"] = f"""SELECT unnest([2, 8]) AS pkt_idx, 769 AS tls_version, 1 AS handshake_messages_count, 105 AS total_handshake_bytes, 0 AS has_encrypted_extensions, 0 AS has_certificate, 0 AS has_certificate_verify, 0 AS has_finished, 771 AS ch_tls_version, 'example.org' AS ch_sni, 11 AS ch_sni_length,
3 AS ch_num_cipher_suites, 5 AS ch_num_extensions, 2 AS ch_num_supported_versions, 2 AS ch_num_supported_groups, 0 AS ch_num_signature_algorithms, 0 AS ch_session_id_length, md5('{JA3}') AS ja3_hash, '{JA3}' AS ja3_str, {JA4_SQL} AS ja4_hash, 't13d0305_' || sha256('{CIPHERS}')[1:12] || '_' || sha256('{EXTENSIONS}')[1:12] AS ja4_str,
sha256('0-10-43-16-11')[1:16] AS extension_order_hash, 1 AS has_h2, 0 AS has_http11, 1 AS has_tls13_ciphers, 2 AS num_tls13_ciphers, 0 AS num_certificates, '0' AS ch_compression_methods, 'h2' AS alpn_protocols, '0-10-43-16-11' AS extension_types"""


def q_quic_parse(spark, sf_dir):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                q = H.quic(p)
                if q:
                    yield pa.RecordBatch.from_pylist([{"pkt_idx": i, "is_long": q["long"], "version": q.get("version"), "dcid": q.get("dcid"), "token_length": q.get("token_length")}], schema=pa.schema([("pkt_idx", pa.int64()), ("is_long", pa.bool_()), ("version", pa.int64()), ("dcid", pa.string()), ("token_length", pa.int32())]))

    return _decoded(spark, _frames()).filter("protocol = 17").select("pkt_idx", "payload").mapInArrow(run, "pkt_idx long, is_long boolean, version long, dcid string, token_length int")


QUERIES["q_quic_parse"] = q_quic_parse
ORACLES["q_quic_parse"] = "SELECT * FROM (VALUES (10, TRUE, 1, '61626364', 3), (11, FALSE, NULL, NULL, NULL)) AS t(pkt_idx, is_long, version, dcid, token_length)"


def q_quic_connections(spark, sf_dir):
    """What is known of a connection at each of its Initials; version 0 and short headers are none."""
    return HS.quic_connections(HS.quic_initials(_decoded(spark, _quic_frames()))).drop("capture")


QUERIES["q_quic_connections"] = q_quic_connections
ORACLES["q_quic_connections"] = """SELECT pkt_idx, CASE WHEN pkt_idx = 2 THEN 4278190109 ELSE 1 END AS quic_version, CASE WHEN pkt_idx = 2 THEN 'Unknown (0xff00001d)' ELSE 'QUIC v1' END AS quic_version_name, CASE WHEN pkt_idx = 2 THEN 1 ELSE 4 END AS quic_dest_cid_length, CASE WHEN pkt_idx = 2 THEN 0 ELSE 2 END AS quic_src_cid_length,
n AS quic_num_initial_packets, b AS quic_total_initial_bytes, CASE WHEN pkt_idx = 2 THEN 0 ELSE 1 END AS quic_has_token, CASE WHEN pkt_idx = 2 THEN 0 ELSE 3 END AS quic_token_length, CASE WHEN pkt_idx = 2 THEN '' ELSE md5('tok')[1:16] END AS quic_token_hash, CASE WHEN pkt_idx = 2 THEN 0 ELSE 1 END AS quic_is_v1, 0 AS quic_is_v2,
CASE WHEN pkt_idx = 2 THEN 1 ELSE 0 END AS quic_is_draft, 0 AS quic_is_google, CASE WHEN pkt_idx = 2 THEN md5('q') ELSE md5('abcdxy') END[1:16] AS quic_cid_hash FROM (VALUES (0, 1, 35), (1, 2, 67), (2, 1, 27), (3, 3, 104)) AS t(pkt_idx, n, b)"""


def q_protocol_features(spark, sf_dir):
    """The 21 features that come from the first handshake of a session, of made connections with TLS, with QUIC and without."""
    d = _decoded(spark, [*_split_frames(), *_quic_frames(), (20.0, C.frame("10.3.0.1", 1, "10.3.0.2", 2, b"plain"))])
    ends = F.sort_array(F.array(F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")))
    p = HS.protocol_features(d.withColumn("flow", ends[0]), ["capture", "flow"])
    return p.select("flow", *[F.round(c, 9).alias(c) for c in HS.PROTOCOL])


_NONE = ", ".join(f"0.0::DOUBLE AS {c}" for c in HS.PROTOCOL)


def _protocol_sql() -> str:
    tls = {"tls_version": 769, "tls_has_sni": 1, "tls_sni_length": 11, "tls_num_cipher_suites": 3, "tls_num_extensions": 5, "tls_num_supported_versions": 2, "tls_num_supported_groups": 2, "tls_has_h2": 1, "tls_has_tls13_ciphers": 1, "tls_handshake_bytes": 105}
    tls |= {"tls_ja3_hash_prefix": f"('0x' || md5('{JA3}')[1:8])::UBIGINT / 4294967295.0::DOUBLE", "tls_ja4_hash_prefix": f"('0x' || ({JA4_SQL})[1:8])::UBIGINT / 4294967295.0::DOUBLE"}
    quic = {"quic_is_present": 1, "quic_version": 1, "quic_is_v1": 1, "quic_has_token": 1, "quic_token_length": 3}
    row = lambda flow, known: f"SELECT '{flow}' AS flow, " + ", ".join(f"round(({known.get(c, 0)})::DOUBLE, 9) AS {c}" for c in HS.PROTOCOL)
    return " UNION ALL ".join([row("10.1.0.1:6000", tls), row("10.1.0.2:443", tls), row("10.2.0.1:5000", quic), row("10.3.0.1:1", {})])


QUERIES["q_protocol_features"] = q_protocol_features
ORACLES["q_protocol_features"] = _protocol_sql()


def q_tcp_reassembly(spark, sf_dir):
    d = _decoded(spark, _frames()).filter("protocol = 6")
    ends = F.sort_array(F.array(F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")))
    return reassembly.reassembled(d.withColumn("flow", F.array_join(ends, "-"))).select("flow", "sid", "pkt_idx", "direction", "state", "retransmissions", "out_of_order")


QUERIES["q_tcp_reassembly"] = q_tcp_reassembly
ORACLES["q_tcp_reassembly"] = """SELECT flow, 0 AS sid, pkt_idx, direction, state, retransmissions, out_of_order FROM (VALUES (0, 1, 'SYN_SENT', 0, 0), (1, -1, 'SYN_RECEIVED', 0, 0), (2, 1, 'ESTABLISHED', 0, 0), (3, 1, 'ESTABLISHED', 0, 0), (5, 1, 'ESTABLISHED', 0, 1), (4, 1, 'ESTABLISHED', 0, 1), (7, -1, 'ESTABLISHED', 1, 1),
(8, 1, 'ESTABLISHED', 1, 1), (9, -1, 'FIN_WAIT', 1, 1)) AS t(pkt_idx, direction, state, retransmissions, out_of_order), (SELECT '10.0.0.1:50000-10.0.0.2:443' AS flow) UNION ALL SELECT '10.0.0.1:2-10.0.0.9:1', 0, 12, 1, 'SYN_SENT', 0, 0"""


def q_ja3_like(spark, sf_dir):
    """Fingerprints of lists that events stand for."""
    e = B.table(spark, sf_dir, "events").select("event_id", F.array((F.col("event_id") % 7).cast("int"), F.lit(2570), F.lit(4865)).alias("c"), F.array((F.col("user_id") % 5).cast("int")).alias("x"))
    return e.select("event_id", H.ja3(F.lit(771), F.col("c"), F.col("x"), F.col("x"), F.array(F.lit(0))).alias("ja3"))


QUERIES["q_ja3_like"] = q_ja3_like
ORACLES["q_ja3_like"] = "SELECT event_id, md5('771,' || (event_id % 7) || '-4865,' || (user_id % 5) || ',' || (user_id % 5) || ',0') AS ja3 FROM events"

# All events as packets of five captures, in the order of their ids.
RT = """rt AS (SELECT 'cap' || (user_id % 5) || '.pcap' AS capture, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS pkt_idx, epoch_us(ts) // 3600 AS us, user_id AS flow, event_type IN ('click', 'purchase', 'signup') AS up, CAST(floor(value * 4) AS BIGINT) AS payload_length,
'10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS client, 1024 + user_id % 60000 AS port, '172.16.' || (user_id % 5) || '.1' AS server, CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 16 WHEN 'view' THEN 24 WHEN 'error' THEN 4 ELSE 17 END AS flags, event_id FROM events),
pk AS (SELECT *, us // 1000000 + (us % 1000000) / 1e6 AS ts, 40 + payload_length AS length FROM rt)"""


def _captures(spark, sf_dir):
    """The capture files' packets, read back."""
    import pyarrow as pa

    e = B.table(spark, sf_dir, "events")
    u = F.col("user_id")
    client = F.concat_ws(".", F.lit("10"), F.floor(u / 65536) % 256, F.floor(u / 256) % 256, u % 256)
    flags = F.expr("CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 16 WHEN 'view' THEN 24 WHEN 'error' THEN 4 ELSE 17 END")
    rows = e.select(F.concat(F.lit("cap"), u % 5, F.lit(".pcap")).alias("capture"), F.col("event_id").alias("pkt_idx"), F.expr("unix_micros(cast(ts as timestamp)) div 3600").alias("us"), client.alias("client"), (1024 + u % 60000).alias("port"), F.concat(F.lit("172.16."), u % 5, F.lit(".1")).alias("server"), F.col("event_type").isin("click", "purchase", "signup").alias("up"), F.floor(F.col("value") * 4).alias("n"), flags.alias("flags"))

    def framed(batches):
        for b in batches:
            made = [C.frame(c, p, s, 443, bytes(n), f, 1) if up else C.frame(s, 443, c, p, bytes(n), f, 1) for c, p, s, up, n, f in zip(*(b.column(i).to_pylist() for i in range(3, 9)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.binary())], names=["capture", "pkt_idx", "us", "data"])

    folder = scratch(spark, "captures")
    C.written(rows.mapInArrow(framed, "capture string, pkt_idx long, us long, data binary"), folder).collect()  # a row a capture
    spark.dataSource.register(C.CaptureSource)
    return spark.read.format("capture").load(folder)


def q_capture_roundtrip(spark, sf_dir):
    return C.decoded(_captures(spark, sf_dir)).select("capture", "pkt_idx", F.round("ts", 6).alias("ts"), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "length", "payload_length", "tcp_flags")


QUERIES["q_capture_roundtrip"] = q_capture_roundtrip
ORACLES["q_capture_roundtrip"] = f"WITH {RT} SELECT capture, pkt_idx, round(ts, 6) AS ts, CASE WHEN up THEN client ELSE server END AS src_ip, CASE WHEN up THEN port ELSE 443 END AS src_port, CASE WHEN up THEN server ELSE client END AS dst_ip, CASE WHEN up THEN 443 ELSE port END AS dst_port, 6 AS protocol, length, payload_length, flags AS tcp_flags FROM pk"


def q_capture_statistics(spark, sf_dir):
    s = C.statistics(_captures(spark, sf_dir))
    return s.select("capture", "packets", "bytes", "ip", "tcp", "udp", "not_ip", "other_ip", "with_payload", "payload_bytes", F.round("first_ts", 6).alias("first_ts"), F.round("last_ts", 6).alias("last_ts"))


QUERIES["q_capture_statistics"] = q_capture_statistics
ORACLES["q_capture_statistics"] = f"WITH {RT} SELECT capture, count(*) AS packets, CAST(sum(length + 14) AS BIGINT) AS bytes, count(*) AS ip, count(*) AS tcp, 0 AS udp, 0 AS not_ip, 0 AS other_ip, count_if(payload_length > 0) AS with_payload, CAST(sum(payload_length) AS BIGINT) AS payload_bytes, round(min(ts), 6) AS first_ts, round(max(ts), 6) AS last_ts FROM pk GROUP BY capture"


def _observed(spark, sf_dir):
    """Sessions of the captures: packets with capture_id, flow (both ends), direction (1: from the session's first sender), sid."""
    d = C.decoded(_captures(spark, sf_dir)).drop("payload")
    low, high = (F.concat_ws(":", S.canonical(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))[k]["ip"], S.canonical(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))[k]["port"]) for k in ("low", "high"))
    s = S.sessionize(d.withColumnRenamed("capture", "capture_id").withColumn("flow", F.concat_ws("-", low, high)), B.GAP)
    first = F.first(F.struct("src_ip", "src_port")).over(Window.partitionBy(*S.SESSION).orderBy("pkt_idx"))
    return s.withColumn("direction", F.when(first == F.struct("src_ip", "src_port"), 1).otherwise(-1))


OBS = f"""{RT}, cut AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture, flow ORDER BY pkt_idx) > {B.GAP} THEN 1 ELSE 0 END AS fresh FROM pk), ses AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY capture, flow ORDER BY pkt_idx) AS BIGINT) AS sid FROM cut),
obs AS (SELECT capture AS capture_id, client || ':' || port || '-' || server || ':443' AS flow, sid, pkt_idx, ts, length, payload_length, flags, CASE WHEN up = first_value(up) OVER w THEN 1 ELSE -1 END AS direction, ts - lag(ts) OVER w AS iat FROM ses WINDOW w AS (PARTITION BY capture, flow, sid ORDER BY pkt_idx))"""


def q_capture_infer(spark, sf_dir):
    """From capture files to predictions: decoded packets, sessions, admission, the features that the rules ask for, the first rule that matches."""
    c = S.context(S.admitted(_observed(spark, sf_dir)))
    wanted = R.required_features(DETECT)
    f = c.groupBy(*S.SESSION).agg(*X.rounded({k: v for k, v in _FAST.items() if k in wanted}))
    return R.first_match(f, DETECT, 0.5).select(*S.SESSION, *sorted(wanted), "match.rule_id", "match.label", "match.confidence")


QUERIES["q_capture_infer"] = q_capture_infer
ORACLES["q_capture_infer"] = f"""WITH {OBS}, f AS (SELECT capture_id, flow, sid, round(count(*)::DOUBLE, 6) AS total_packets, round(avg(length), 6) AS size_mean, round(coalesce(avg(iat), 0), 6) AS iat_mean FROM obs GROUP BY ALL HAVING count(*) >= 3 AND sum(length) >= 100),
m AS (SELECT *, CASE WHEN size_mean >= 300 AND total_packets >= 4 THEN 'd0' WHEN size_mean BETWEEN 100 AND 240 THEN 'd1' WHEN iat_mean < 8 THEN 'd2' END AS rule_id FROM f)
SELECT *, CASE rule_id WHEN 'd0' THEN 'bulk' WHEN 'd1' THEN 'chat' WHEN 'd2' THEN 'steady' ELSE 'unknown' END AS label, CAST(CASE rule_id WHEN 'd0' THEN 0.9 WHEN 'd1' THEN 0.8 WHEN 'd2' THEN 0.7 ELSE 0 END AS DOUBLE) AS confidence FROM m"""


def q_session_survey(spark, sf_dir):
    """Of each session of the captures: packets, bytes, duration, whether it has a SYN."""
    s = _observed(spark, sf_dir).groupBy(*S.SESSION).agg(F.count("*").alias("n_packets"), F.sum("length").alias("n_bytes"), F.round(F.max_by("ts", "pkt_idx") - F.min_by("ts", "pkt_idx"), 6).alias("duration"), F.bool_or(F.col("tcp_flags").bitwiseAND(F.lit(2)) != 0).alias("has_syn"))
    return s.filter("n_packets >= 3")


QUERIES["q_session_survey"] = q_session_survey
ORACLES["q_session_survey"] = f"WITH {OBS} SELECT capture_id, flow, sid, count(*) AS n_packets, CAST(sum(length) AS BIGINT) AS n_bytes, round(arg_max(ts, pkt_idx) - arg_min(ts, pkt_idx), 6) AS duration, bool_or(flags & 2 <> 0) AS has_syn FROM obs GROUP BY ALL HAVING count(*) >= 3"


def q_payload_bytes(spark, sf_dir):
    """Entropy of the bytes of the first packets, and whether the first ones look encrypted: conversations as sessions, turns as packets."""
    p = B.table(spark, sf_dir, "conversations").filter("text <> ''").select("conv_id", F.col("turn").alias("pkt_idx"), F.encode("text", "UTF-8").alias("payload")).withColumn("payload_length", F.octet_length("payload"))
    e = HS.payload_entropy(p, ["conv_id"]).select("conv_id", F.round("payload_byte_entropy", 6).alias("payload_byte_entropy"))
    return e.join(HS.encrypted_share(p, ["conv_id"], 256), "conv_id")


QUERIES["q_payload_bytes"] = q_payload_bytes
ORACLES["q_payload_bytes"] = r"""WITH p AS (SELECT conv_id, turn, lower(hex(encode(text))) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations WHERE text <> ''),
v AS (SELECT conv_id, h[2 * i + 1:2 * i + 2] AS v, count(*) AS c FROM (SELECT conv_id, h, unnest(range(least(length(h) // 2, 128))) AS i FROM p WHERE r <= 100) GROUP BY ALL), t AS (SELECT conv_id, v, c / sum(c) OVER (PARTITION BY conv_id) AS q FROM v), e AS (SELECT conv_id, round(-sum(q * log2(q)), 6) AS payload_byte_entropy FROM t GROUP BY conv_id),
b AS (SELECT conv_id, h[2 * i + 1:2 * i + 2] AS v FROM (SELECT conv_id, h, unnest(range(length(h) // 2)) AS i FROM p WHERE before < 256)), s AS (SELECT conv_id, count(*) AS n, count_if(v BETWEEN '20' AND '7e' OR v IN ('09', '0a', '0d')) AS k FROM b GROUP BY conv_id)
SELECT conv_id, payload_byte_entropy, CASE WHEN n >= 256 THEN CASE WHEN k / n < 0.70 THEN 1 ELSE 0 END END AS encrypted FROM e JOIN s USING (conv_id)"""


def q_stream_parity(spark, sf_dir):
    """Daily counts from a stream of the event files; the SQL twin reads the table."""
    return SW.drained(SW.tumbling_counts(SW.event_stream(spark, sf_dir)), ["window_us", "event_type"], scratch(spark, "stream"))


QUERIES["q_stream_parity"] = q_stream_parity
ORACLES["q_stream_parity"] = "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def q_stream_sliding(spark, sf_dir):
    """Overlapping windows by kind of event, from a stream."""
    return SW.drained(SW.sliding_figures(SW.event_stream(spark, sf_dir), "event_type"), ["window_us", "event_type"], scratch(spark, "stream"))


QUERIES["q_stream_sliding"] = q_stream_sliding
ORACLES["q_stream_sliding"] = "WITH w AS (SELECT *, unnest([epoch_us(ts) // 86400000000 - 1, epoch_us(ts) // 86400000000]) * 86400000000 AS window_us FROM events) SELECT window_us, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM w GROUP BY ALL"


def q_idle_sessions(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return SW.idle_sessions(e)


QUERIES["q_idle_sessions"] = q_idle_sessions
ORACLES["q_idle_sessions"] = "WITH a AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 86400000000 THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s"
