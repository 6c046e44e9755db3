"""Every query against its SQL twin on the smallest tables, and the operators that SQL can't express."""

import json
import math
import struct

import duckdb
import numpy as np
import pytest

from netloom.functions import handshakes as H
from netloom.operators import complexity, evaluation, reassembly
from netloom.operators import rules as R
from netloom.plans import registry
from netloom.sources import capture as C
from netloom.sources import manifests as M

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if name not in registry.ORACLES:
        assert rows
        return
    got = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in at] == cols
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


@pytest.mark.parametrize(("nano", "big"), [(False, False), (True, False), (False, True), (True, True)])
def test_pcap_source(spark, tmp_path, nano, big):
    frames = [(1.5 + i, C.frame("10.0.0.1", 1000 + i, "10.0.0.2", 443, b"x" * i, pad=4)) for i in range(6)]
    C.write_pcap(str(tmp_path / "a.pcap"), frames, nano, big)
    with open(tmp_path / "a.pcap", "ab") as f:
        f.write(b"\0" * 10)  # a record cut short
    spark.dataSource.register(C.CaptureSource)
    raw = spark.read.format("capture").load(str(tmp_path / "*.pcap"))
    rows = C.decoded(raw).orderBy("pkt_idx").collect()
    assert [r["payload_length"] for r in rows] == list(range(6)) and [r["ts"] for r in rows] == [1.5 + i for i in range(6)]
    assert spark.read.format("capture").option("max_packets", 2).load(str(tmp_path / "a.pcap")).count() == 2


def test_pcapng_and_bad_files(tmp_path):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        n = struct.pack(">I", len(body) + 12)
        return struct.pack(">I", kind) + n + body + n

    data = C.frame("10.0.0.1", 1, "10.0.0.2", 2, b"hi")
    raw = block(0x0A0D0D0A, struct.pack(">IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(">HHI", 1, 0, 65535) + struct.pack(">HHB3x", 9, 1, 9) + b"\0" * 4)
    raw += block(6, struct.pack(">IIIII", 0, 1, 5, len(data), len(data)) + data) + block(99, b"skip") + block(3, struct.pack(">I", len(data)) + data)
    p = tmp_path / "x.pcapng"
    p.write_bytes(raw)
    with open(p, "rb") as f:
        got = list(C.packets(f))
    assert [g[0] for g in got] == [((1 << 32) + 5) / 1e9, 0.0] and got[0][2] == data
    p.write_bytes(b"what is this")
    with open(p, "rb") as f, pytest.raises(ValueError):
        list(C.packets(f))
    with open(p, "rb") as f, pytest.raises(ValueError):
        list(C.packets(f, 0))


def test_decode_leaves_out_what_is_not_ip():
    assert C.decode(1, b"\0" * 12 + b"\x08\x06" + b"\0" * 40) is None and C.decode(1, b"short") is None
    six = b"\0" * 12 + b"\x86\xdd" + bytes([0x60, 0, 0, 0, 0, 10, 17, 64]) + b"\0" * 32 + struct.pack("!HHHH", 5, 443, 10, 0) + b"ab"
    assert C.decode(1, six)[2:7] == (5, 443, 17, 50, 2)


def test_hello_and_quic():
    h = H.parse_client(H.hello("a.example", [0x1A1A, 4865], [29], [772]))
    assert h["sni"] == "a.example" and h["supported_versions"] == [772] and h["alpn"] == ["h2"] and H.ja3_text(h) == "771,4865,0-10-43-16-11,29,0"
    assert H.parse_client(H.hello("a.example", [4865], [29], [772])[:-3]) is None
    assert H.varint(b"\x7b\xbd", 0) == (15293, 2) and H.varint(b"\x40", 0) is None
    assert H.quic(b"\x45" + b"\0" * 9)["long"] is False and H.quic(b"\xf3\0\0\0\1\0\0\0") is None


def test_reassembly_order(spark):
    rows = [("c", "f", i, float(i), s, p, fl, q, n) for i, (s, p, fl, q, n) in enumerate([("a", 1, 2, 10, 0), ("b", 2, 18, 50, 0), ("a", 1, 16, 11, 0), ("a", 1, 24, 16, 5), ("a", 1, 24, 11, 5), ("a", 1, 24, 11, 5), ("b", 2, 4, 51, 0), ("a", 1, 16, 99, 0)])]
    got = reassembly.reassembled(spark.createDataFrame(rows, "capture string, flow string, pkt_idx long, ts double, src_ip string, src_port int, tcp_flags int, tcp_seq long, payload_length int")).collect()
    assert [(r["sid"], r["pkt_idx"]) for r in got] == [(0, 0), (0, 1), (0, 2), (0, 4), (0, 3), (0, 6), (1, 7)]
    assert got[5]["retransmissions"] == 1 and got[5]["out_of_order"] == 1 and got[5]["state"] == "CLOSED"


def test_matching_is_largest(spark):
    pairs = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 3, 3), (2, 9, 9)], "k int, predicted_id long, truth_id long")
    got = evaluation.match(pairs, ["k"]).collect()
    assert sorted(r["predicted_id"] for r in got) == [1, 2, 3, 9] and len({(r["k"], r["truth_id"]) for r in got}) == 4


def test_rules_and_bundles(tmp_path):
    rules = [{"rule_id": "a", "label": "x", "priority": 1, "conditions": [{"feature": "f", "op": ">", "value": 1}]}]
    R.save_bundle(str(tmp_path / "b"), rules, ["f"], {0: "x"})
    assert R.load_bundle(str(tmp_path / "b"))[2]["labels"] == {0: "x"}
    (tmp_path / "b" / "rules.json").unlink()
    with pytest.raises(FileNotFoundError):
        R.load_bundle(str(tmp_path / "b"))
    for bad in ({"rule_id": "z", "action": "disable"}, {"rule_id": "a", "action": "edit", "conditions": [{"feature": "g", "op": ">", "value": 1}]}, {"rule_id": "a", "action": "edit", "conditions": [{"feature": "f", "op": "eval", "value": 1}]}, {"rule_id": "a", "action": "edit", "conditions": [{"feature": "f", "op": "<", "value": "x"}]}):
        with pytest.raises(R.RevisionError):
            R.revise(rules, [bad], ["f"])
    assert R.revise(rules, [{"rule_id": "a", "action": "disable"}], ["f"]) == []


def test_complexity():
    x = np.sin(np.arange(64))
    assert complexity.spectral_entropy(np.ones(9)) == 0 and complexity.spectral_entropy(x) < complexity.spectral_entropy(np.random.default_rng(0).normal(size=64))
    assert complexity.hurst(np.ones(5)) == 0.5 and complexity.approximate_entropy(np.ones(9)) == 0
    y = np.random.default_rng(1).normal(size=20)
    r, n = 0.2 * y.std(), 19
    close = lambda m: sum(all(abs(y[i + k] - y[j + k]) <= r for k in range(m)) for i in range(20 - m + 1) for j in range(i + 1, 20 - m + 1))
    if close(2) and close(3):
        assert np.isclose(complexity.approximate_entropy(y), np.log(close(2) / (n * (n - 1) / 2)) - np.log(close(3) / ((n - 1) * (n - 2) / 2)))


def test_manifests(spark, tmp_path):
    row = {"capture_id": "c", "trial_id": "t", "device_id": "d", "app": "a", "behavior": "b", "pcap": "p", "platform": "ios", "label_source": "ui_event", "split": "val", "more": 1}
    p = tmp_path / "m.jsonl"
    p.write_text("# note\n\n" + json.dumps(row) + "\n")
    assert M.manifest(spark, str(p)).first()["split"] == "validation"
    for change in ({"platform": "tv"}, {"app": ""}, {"behavior_start": 1.0}, {"split": "x"}):
        p.write_text(json.dumps(row | change))
        with pytest.raises(M.InputError):
            M.manifest(spark, str(p))
    one = {"observation_id": "o", "predicted_label": "x", "confidence": 0.5}
    for text in (json.dumps([one, one]), json.dumps({"results": [one, one]}), json.dumps(one) + "\n" + json.dumps(one)):
        (tmp_path / "p.json").write_text(text)
        assert M.predictions(spark, str(tmp_path / "p.json")).count() == 2
    (tmp_path / "o.jsonl").write_text('{"observation_id": "1", "label": "x"}\n{"observation_id": "1", "label": "y"}')
    with pytest.raises(M.InputError):
        M.observation_list(spark, str(tmp_path / "o.jsonl"))
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@attribute x numeric\n@attribute 'k' {A,B}\n@data\n1.5,A\n?,B\ninf,A\n")
    assert [(r["x"], r["k"]) for r in M.attributes(spark, str(tmp_path / "a.arff")).collect()] == [(1.5, "A"), (-1.0, "B"), (-1.0, "A")]
    names = spark.createDataFrame([("SET-X-qq_p003.pcap",), ("SET-X-qq.pcap",), ("other.txt",)], "n string").select(*M.name_parts(M.F.col("n"))).collect()
    assert [tuple(r) for r in names] == [("qq", 3), ("qq", None), (None, None)]
