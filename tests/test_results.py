"""Sinks, sources, models, experiments, profiles: against hand-made expectations."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import handshakes as H
from netloom.operators import complexity
from netloom.operators import experiments as E
from netloom.operators import handshake_streams as HS
from netloom.operators import models as M
from netloom.operators import profiles as P
from netloom.operators import ranking as K
from netloom.operators import rules as R
from netloom.operators import selection as L
from netloom.operators import sessions as S
from netloom.operators.order import numbered
from netloom.sources import capture as C
from netloom.sources import manifests as MF
from netloom.sources import results as RS


@pytest.fixture(scope="module")
def ctx(spark):
    """Six packets of one session: known gaps, sizes, directions, flags."""
    rows = [(0.0, 60, 1, 2, 0, 1000), (0.1, 60, -1, 18, 0, 0), (0.4, 100, 1, 16, 60, 500), (2.4, 1000, -1, 24, 960, 700), (2.5, 1000, -1, 24, 960, 700), (2.6, 40, 1, 17, 0, 0)]
    p = spark.createDataFrame([("c", 1, i, t, d, n, y, f, w) for i, (t, n, d, f, y, w) in enumerate(rows)], "capture_id string, flow long, pkt_idx long, ts double, direction int, length long, payload_length long, flags int, window_size long")
    return S.context(S.sessionize(p, 24))


def test_basic_features_by_hand(ctx):
    r = P.extract(ctx).first()
    want = {
        "duration": 2.6, "total_packets": 6, "total_fwd_packets": 3, "total_bwd_packets": 3, "total_bytes": 2260, "total_fwd_bytes": 200, "total_bwd_bytes": 2060, "fwd_bwd_packet_ratio": 1.0, "packet_rate": 6 / 2.6, "fwd_bwd_byte_ratio": 200 / 2060, "down_up_byte_ratio": 10.3, "byte_rate": 2260 / 2.6,
        "pkt_size_max": 1000, "pkt_size_min": 40, "pkt_size_mean": 2260 / 6, "pkt_size_median": 80, "fwd_pkt_size_median": 60, "bwd_payload_size_sum": 1920, "iat_max": 2.0, "iat_min": 0.1, "iat_mean": 0.52, "iat_median": 0.1, "fwd_iat_max": 2.2, "fwd_iat_min": 0.4, "bwd_iat_max": 2.3, "bwd_iat_median": 1.2,
        "pkts_first_0_1s": 2, "pkts_first_0_5s": 3, "pkts_first_3_0s": 6, "syn_flag_count": 2, "fwd_syn_flag_count": 1, "bwd_ack_flag_count": 3, "psh_flag_count": 2, "fin_flag_count": 1, "tcp_window_max": 1000, "tcp_window_min": 500, "tcp_window_mean": 725, "header_bytes_max": 60, "header_bytes_sum": 280, "payload_ratio": 1980 / 2260, "avg_segment_size": 330,
        "active_max": 0.4, "active_min": 0.2, "active_sum": 0.6, "idle_sum": 2.0, "num_bursts": 0, "fwd_bulk_count": 0, "direction_changes": 4, "direction_change_rate": 0.8, "dir_2gram_0": 0.0, "dir_2gram_1": 0.4, "dir_2gram_2": 0.4, "dir_2gram_3": 0.2, "longest_same_dir_run": 2, "size_range": 960, "iat_hurst_exponent": 0.5,
    }
    sizes = np.array([60, 60, 100, 1000, 1000, 40])
    want |= {"pkt_size_std": sizes.std(), "size_cv": sizes.std() / sizes.mean(), "size_iqr": np.percentile(sizes, 75) - np.percentile(sizes, 25), "size_quantile_4": np.percentile(sizes, 500 / 11)}
    assert {k: round(r[k], 5) for k in want} == {k: round(float(v), 5) for k, v in want.items()}
    words = [0, 8, 0, 11, 11, 0]  # quarters of the largest size, 8 more for backward packets
    assert [round(r[f"packet_bow_{i}"], 4) for i in range(32)] == [round(words.count(i) / 6, 4) for i in range(32)]


def test_profiles(ctx):
    assert P.extract(ctx, ["iat_mean", "nothing"]).columns == [*S.SESSION, "iat_mean"] and P.required_families(["iat_mean", "num_bursts", "x"]) == {"timing", "bursts"}
    assert P.profile("behavior15", "behavior")["window"] == 15 and P.profile(None, "behavior")["observation_unit"] == "behavior_window" and P.profile(None)["profile_name"] == "full"
    for bad in (lambda: P.profile("tunnel15", "app"), lambda: P.profile("x"), lambda: P.profile_features("application64")):
        with pytest.raises(ValueError):
            bad()
    spec = P.profile("application64")
    spec["forbidden_features"] = ()
    assert P.profile("application64")["forbidden_features"] and len(P.FAST16) == 16 and len(P.FAST32) == 32
    assert P.smallest_profile(["duration"]) == "fast16" and P.smallest_profile(["num_bursts"]) == "fast32" and P.smallest_profile(["x"]) == "full" and P.profile_features("full") is None
    row = ctx.sparkSession.createDataFrame([(1, 443, 2.0, None)], "_id int, dst_port int, a double, b double")
    assert P.allowed(row, P.profile("tunnel15")).columns == ["_id", "a", "b"] and P.matrix(row, ["b", "zz", "a"], -1.0).first()[:] == (1, -1.0, -1.0, 2.0)
    assert "dst_port" not in P.common_shape(P.family_of()) and "syn_flag_count" not in P.common_shape(P.family_of()) and "iat_mean" in P.common_shape(P.family_of())
    ids = ctx.sparkSession.createDataFrame([("a:bw3:17",)], "observation_id string")
    assert P.observation_parts(ids).first()[1:] == (3, 17)
    with pytest.raises(Exception, match="not an id"):
        P.observation_parts(ids.withColumn("observation_id", F.lit("a:3"))).collect()
    mapped = P.by_file(ctx.sparkSession.createDataFrame([("/x/a.pcap",), ("b.pcap",)], "source_file string"), ctx.sparkSession.createDataFrame([("a.pcap", "p1")], "name string, pair string"))
    assert [r["pair"] for r in mapped.collect()] == ["p1"]


def test_results_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.createDataFrame([("o1", 1.5, None), ("o2", 2.5, 3.0)], "_id string, a double, b double")
    RS.write_features(rows.select("a", "_id", "b"), f"{folder}/raw_features.csv")
    back = RS.read_features(spark, f"{folder}/raw_features.csv")
    assert back.columns == ["_id", "a", "b"] and sorted(map(tuple, back.collect())) == [("o1", 1.5, None), ("o2", 2.5, 3.0)]
    RS.write_detections(rows, f"{folder}/detection_results.csv")
    assert spark.read.option("header", "true").csv(f"{folder}/detection_results.csv").count() == 2
    RS.write_predictions(rows, f"{folder}/p.json", profile="fast16")
    got, document = RS.read_predictions(spark, f"{folder}/p.json")
    assert got.count() == 2 and document["profile"] == "fast16" and document["n_results"] == 2
    for text in ('[{"a": 1, "z": 2}, {"b": 3}]', '{"a": 1}\n{"b": 3}', '{"a": 1}'):
        (tmp_path / "v.json").write_text(text)
        vectors = RS.feature_rows(spark, f"{folder}/v.json", ["a", "b"]).collect()
        assert (1.0, None) in [tuple(v) for v in vectors] and len(vectors) == text.count("}")
    rules = [{"rule_id": "r", "label": "x", "type": "statistical", "conditions": [{"feature": "a", "op": "range", "min": 1, "max": np.float64(2)}]}]
    RS.write_rules(f"{folder}/rules.yaml", rules, {0: "x", 1: "y"})
    assert RS.read_rules(f"{folder}/rules.yaml") == (json.loads(json.dumps(rules, default=float)), {0: "x", 1: "y"})
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "feature string, score double")
    RS.write_reports(f"{folder}/reports", rows, scores, rules)
    stats = json.loads((tmp_path / "reports/selected_features_stats.json").read_text())
    assert stats["a"]["mean"] == 2.0 and abs(stats["a"]["std"] - math.sqrt(0.5)) < 1e-9 and RS.selection_report(scores)[0]["feature"] == "b"
    assert "| accuracy | 0.5 |" in RS.run_report(folder, {"accuracy": 0.5}, rules, {0: "x"}) and (tmp_path / "report.md").exists()
    trial = {c: "" for c in MF.REQUIRED + MF.OPTIONAL} | {"capture_id": "c", "trial_id": "t", "device_id": "d", "app": "a", "behavior": "b", "pcap": "p.pcap", "platform": "ios", "label_source": "ui_event"}
    table = spark.createDataFrame([tuple(trial.values())], ", ".join(f"{c} string" for c in trial))
    RS.write_manifest(table, f"{folder}/m.jsonl")
    again = MF.manifest(spark, f"{folder}/m.jsonl")
    assert again.first()["app"] == "a" and RS.manifest_report(again, folder)["missing"] == ["p.pcap"] and RS.manifest_report(again, folder)["with_interval"] == 0


def test_captures_in_folders(spark, tmp_path):
    folder = tmp_path / "caps" / "deep"
    folder.mkdir(parents=True)
    frames = [(1.0 + i, C.frame("10.0.0.1", 5, "10.0.0.2", 443, b"x" * i)) for i in range(4)]
    C.write_pcap(str(folder / "SET-X-qq_p002.pcap"), frames)
    C.write_pcap(str(folder.parent / "SET-X-qq.pcap"), frames, nano=True)
    (folder / "SET-X-zz.pcap").write_bytes(b"")
    (folder / "notes.txt").write_text("no")
    with pytest.raises(FileNotFoundError):
        C.discover(str(tmp_path / "nothing"))
    found = C.discover(f"file://{tmp_path}/caps")
    assert [f.rsplit("/", 1)[1] for f in found] == ["SET-X-qq.pcap", "SET-X-qq_p002.pcap", "SET-X-zz.pcap"] and all(f.startswith("file://") for f in found)
    spark.dataSource.register(C.CaptureSource)
    raw = spark.read.format("capture").load(f"file://{tmp_path}/caps")
    stats = {r["capture"]: r for r in C.statistics(raw).collect()}
    assert stats["SET-X-qq.pcap"]["tcp"] == 4 and stats["SET-X-qq.pcap"]["with_payload"] == 3 and stats["SET-X-qq.pcap"]["payload_bytes"] == 6
    audit = {(r["class"], r["format"]): (r["files"], r["anomalies"]) for r in MF.audit(spark, f"{tmp_path}/caps").collect()}
    assert audit == {("qq", "pcap"): (1, 0), ("qq", "pcap_ns"): (1, 0), ("zz", "unknown"): (1, 1)}
    assert [(r["class"], r["part"]) for r in MF.catalog(spark, f"{tmp_path}/caps").collect()] == [("qq", None), ("qq", 2), ("zz", None)]
    acts = spark.createDataFrame([("a", {"chat": 3, "call": 0}), ("b", {"chat": 1, "call": 1})], "c string, activities map<string,int>")
    assert [(r["c"], r["activity"]) for r in MF.single_activity(acts).collect()] == [("a", "chat")]


def test_handshake_pieces():
    hello = H.hello("a.example", [0x1301], [29], [772])
    found, held = HS.fed(b"", hello[:50])
    assert found is None and held == hello[:50]
    found, held = HS.fed(held, hello[50:] + hello[:10])
    assert found["ch_sni"] == "a.example" and held == hello[:10] and HS.fed(b"", b"\x17xx") == (None, b"") and HS.fed(b"\x16\x03\x01\xff\xff", b"x" * 70_000)[1] == b""
    assert H.first_record(b"\0" * 20 + hello)["ja3_hash"] == found["ja3_hash"] and H.first_record(b"\0" * 200) is None and H.figures(b"\x17\0\0\0\0") is None
    assert H.server_hello(b"short") is None and H.server_hello(b"\3\3" + b"\0" * 32)["cipher"] == 0 and H.certificates(b"\0\0\0\0\0\2ab\0\0") == [2] and H.certificates(b"") == []
    empty = H.figures(struct.pack("!BHH", 22, 771, 4) + b"\x14\0\0\0")
    assert empty["has_finished"] == 1 and empty["num_certificates"] == 0 and "ch_sni" not in empty


def test_rule_operators(spark):
    d = spark.createDataFrame([("alpha beta", ["x", "y"], 2.0), ("gamma", [], None)], "s string, l array<string>, n double")
    types = dict(d.dtypes)
    ask = lambda **c: [bool(r[0]) for r in d.select(R.condition(c, types)).collect()]
    assert ask(feature="s", op="contains", value=["nope", "beta"]) == [True, False] and ask(feature="l", op="contains", value=["q", "y"]) == [True, False] and ask(feature="l", op="contains", value="x") == [True, False]
    assert ask(feature="n", op="range", min=1, max=2) == [True, False] and ask(feature="n", op="range", min=3) == [False, False] and ask(feature="n", op="range", value=[0, 5]) == [True, False]


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, (i * 37) % 100, i) for i in range(500)], "k int, o int, i int").repartition(5)
    for keys in (["k"], []):
        got = {}
        for r in numbered(rows, keys, ["o", "i"], "n", "t").collect():
            got.setdefault(r["k"] if keys else 0, []).append((r["n"], r["o"], r["i"], r["t"]))
        for v in got.values():
            v.sort()
            assert [x[0] for x in v] == list(range(1, len(v) + 1)) and [x[1:3] for x in v] == sorted(x[1:3] for x in v) and {x[3] for x in v} == {len(v)}
    ranked = L.ranks(spark.createDataFrame([(0, 0, 5.0), (1, 0, 5.0), (2, 0, 1.0), (3, 0, 9.0), (4, 0, None)], "id int, feature int, x double")).collect()
    assert sorted((r["x"], r["r"]) for r in ranked) == [(1.0, 1.0), (5.0, 2.5), (5.0, 2.5), (9.0, 4.0)]
    order = K.shuffled(rows.withColumn("f", F.lit("a")), "k", "f", "i", "s").filter("k = 1").orderBy("place").collect()
    assert [r["place"] for r in order] == list(range(1, len(order) + 1)) and [r["i"] for r in order] != sorted(r["i"] for r in order)


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(0)
    rows = [(i, int(i % 4), *(r.normal(size=3) * 0.3 + np.array([[3, 3, 0], [-3, 0, 3], [0, -3, -3], [6, 6, 6]])[i % 4]).tolist()) for i in range(240)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double")


def test_models(spark, blobs, tmp_path):
    f = ["a", "b", "c"]
    for name in ("extra_rf", "lr", "gbt"):
        models = M.fit(blobs, f, "y", name)
        got = M.probabilities(models, blobs.withColumn("a", F.when(F.col("id") == 0, float("nan")).otherwise(F.col("a"))), f, 4).collect()
        assert all(abs(sum(r["proba"]) - 1) < 1e-6 for r in got) and sum(int(np.argmax(r["proba"])) == r["y"] for r in got) > 225
    with pytest.raises(ValueError):
        M.learner("x", 1)
    folds = M.out_of_fold(blobs, f, "y", "id", "lr", 4, folds=3).collect()
    assert len(folds) == 240 and {r["fold"] for r in folds} == {0, 1, 2} and sum(int(np.argmax(r["proba"])) == r["y"] for r in folds) > 225
    for soft in (True, False):
        moe = M.latent_domains(blobs, blobs, f, "y", [0, 0, 1, 1], "lr", soft=soft).collect()
        assert sum(int(np.argmax(r["proba"])) == r["y"] for r in moe) > 225
    labels = {i: f"app{i}_chat_long" for i in range(4)}
    M.save_model(f"file://{tmp_path}/m", M.fit(blobs, f, "y", "extra_rf"), f, labels, 0.6)
    models, features, config = M.load_model(f"file://{tmp_path}/m")
    assert features == f and config["labels"] == labels and len(models) == 2
    rules = [{"rule_id": "r", "label": "z_w", "priority": 0, "confidence": 0.9, "conditions": [{"feature": "id", "op": "<", "value": 5}]}]
    proba = M.probabilities(models, blobs, f, 4)
    one = M.matched(proba, labels, 0.6, rules).filter("id = 7").first()["match"]
    assert (one["rule_id"], one["app"], one["behavior"], one["source"]) == ("ENS_0001", "app3", "chat_long", "classifier")
    unsure = M.matched(proba, labels, 1.1, [rules[0] | {"confidence": 2.0}]).orderBy("id").collect()
    assert unsure[0]["match"]["source"] == "rules" and unsure[9]["match"]["label"] == "unknown" and M.low_confidence(proba, 1.1).first()["predicted"] == -1
    assert {r["source"]: r["n"] for r in M.match_statistics(M.matched(proba, labels, 0.0)).collect()} == {"classifier": 240}
    with pytest.raises(FileNotFoundError):
        M.load_model(f"file://{tmp_path}/none")
    _, made = M.generated(blobs, f, "y", labels)
    kinds = [r["type"] for r in made]
    assert kinds[0] == "ensemble_classifier" and "decision_tree" in kinds and "statistical" in kinds
    replay = R.first_match(blobs, made).filter(F.col("match.label") == F.concat(F.lit("app"), "y", F.lit("_chat_long"))).count()
    assert replay > 200 and len(M.DEMO) == 5


def test_tuned_bias_raises_recall(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(600):
        y = i % 2
        p = min(max((0.55 if y else 0.20) + r.normal() * 0.027, 0.01), 0.99)  # some of class 1 are told just below a half
        rows.append((y, [1 - p, p]))
    d = spark.createDataFrame(rows, "label int, proba array<double>")
    bias = E.tune_bias(d, 2)
    z = np.log([x[1] for x in rows]) + np.array(bias)
    truth = [x[0] for x in rows]
    assert (np.array([x[1] for x in rows]).argmax(1) == truth).mean() < 1 == (z.argmax(1) == truth).mean()
    assert E.tune_bias(d, 2, rounds=0) == [0.0, 0.0]


def test_experiments(spark, tmp_path):
    assert E.quotas(400) == (232, 80, 88) and E.quotas(2000) == (1800, 100, 100)
    with pytest.raises(ValueError):
        E.quotas(90)
    sizes = {"a": {"f1": 90, "f2": 40, "f3": 30}, "b": {"f1": 100, "f2": 25}, "c": {"f1": 50, "f2": 19, "f3": 60}}
    obs = spark.createDataFrame([(c, f, f"{c}{f}{i}") for c, fs in sizes.items() for f, n in fs.items() for i in range(n)], "label string, file string, observation_id string")
    plan = E.no_leaks(E.split_plan(obs, 100, "s"), "observation_id").collect()
    modes = {r["label"]: r["mode"] for r in plan}
    assert modes == {"a": "capture_group", "b": "capture_group_test_only", "c": "session_level"}
    count = lambda c, s: sum(r["label"] == c and r["split"] == s for r in plan)
    assert [count(c, s) for c in "abc" for s in ("train", "validation", "test")] == [60, 20, 20] * 3
    files = {(r["label"], r["split"], r["file"]) for r in plan}
    assert ("a", "validation", "f2") in files and ("a", "test", "f3") in files and ("a", "train", "f2") not in files and ("b", "test", "f2") in files
    with pytest.raises(ValueError):
        E.no_leaks(spark.createDataFrame([(1, "x"), (1, "y")], "k int, split string"), "k")
    surveys = {10: [("f", 3, True)], None: [("f", 9, False)]}
    rows, trace = E.tiers(lambda cap: spark.createDataFrame(surveys[cap], "file string, qualified int, capped boolean"), [10, None], 5)
    assert [t["qualified"] for t in trace] == [3, 9] and rows.first()["qualified"] == 9
    board = spark.createDataFrame([("x", 0.99, 0.99, 0.97, 0.01), ("y", 0.96, 0.96, 0.985, 0.02), ("z", 0.5, 0.5, 0.99, 0.3)], "candidate string, accuracy double, macro_precision double, macro_recall double, max_fpr double")
    assert [r["candidate"] for r in E.leaderboard(board).collect()] == ["y", "z", "x"] and not E.meets({"accuracy": 1, "macro_precision": 1, "macro_recall": 1, "max_fpr": 0.06})
    folder = f"file://{tmp_path}/seal"
    with pytest.raises(ValueError):
        E.sealed(folder, {"k": 1}, dict)
    E.opened(folder, {"k": 1})
    with pytest.raises(ValueError):
        E.sealed(folder, {"k": 2}, dict)
    assert E.sealed(folder, {"k": 1}, lambda: {"accuracy": 1.0})["accuracy"] == 1.0
    with pytest.raises(ValueError):
        E.sealed(folder, {"k": 1}, dict)
    # An F value of 4.26 with 2 and 9 degrees of freedom, and 1 with 10 and 10.
    assert abs(E.f_tail(4.2565, 2, 9) - 0.05) < 1e-4 and abs(E.f_tail(1.0, 10, 10) - 0.5) < 1e-9 and E.f_tail(0, 2, 2) == 1.0
    scores = spark.createDataFrame([("good", 50.0, 2, 40), ("flat", 0.1, 2, 40)], "feature string, f double, k int, n int")
    told = E.effectiveness(scores, None, {"good", "flat"}, {"good"})
    assert told["effective"] == ["good"] and told["rate"] == 0.5 and E.effectiveness(scores, None, None, {"good"})["pending"] == ["flat", "good"]
    assert E.accounting(["a", "b"], {"a"}, {"a", "b"})["E_over_A"] == 0.5
    reviews = spark.createDataFrame([("keep",), ("modify",), ("drop",), (None,)], "decision string")
    assert abs(E.usable_rate(reviews) - 2 / 3) < 1e-12
    with pytest.raises(ValueError):
        E.usable_rate(reviews.filter("decision IS NULL"))


def test_alignment_and_folds_by_capture(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(400, 2)) @ np.array([[2.0, 0.5], [0.0, 1.0]]) + 5, r.normal(size=(400, 2)) * [1.0, 3.0] - 2
    frame = lambda x, n: spark.createDataFrame([(n, *map(float, v)) for v in x], "p string, a double, b double")
    moved = np.array([[x["a"], x["b"]] for x in E.coral(frame(a, "s"), frame(b, "t"), ["a", "b"], 1e-6).collect()])
    assert np.allclose(moved.mean(0), b.mean(0), atol=1e-6) and np.allclose(np.cov(moved.T), np.cov(b.T), atol=1e-4)
    rows = spark.createDataFrame([(i, i % 3, i % 2) for i in range(90)], "id long, capture int, label int")
    seen = []

    def run(train, test):
        seen.append((train.select("capture").distinct().count(), test.select("capture").distinct().count()))
        return test.select("id", F.col("label").alias("predicted"))

    done = E.by_capture(rows, E.leave_one_out(rows, "capture", run)).collect()
    assert seen == [(2, 1)] * 3 and {x["label"]: (x["n_captures"], x["mean_accuracy"], x["majority_wrong"]) for x in done} == {0: (3, 1.0, 0), 1: (3, 1.0, 0)}
    both = E.transfer(rows.withColumn("platform", F.when(F.col("id") < 45, "x").otherwise("y")), "platform", lambda tr, te: te.select("id")).collect()
    assert {(x["trained_on"], x["tested_on"]) for x in both} == {("x", "y"), ("y", "x")} and len(both) == 90
    taken, scores = L.select(spark.createDataFrame([(i, i % 2, f, float(i % 2 if f == 0 else (i * (f + 3)) % 7)) for i in range(60) for f in range(4)], "id int, label int, feature int, x double"), spark.createDataFrame([(f, 1.0 - f / 10) for f in range(4)], "feature int, score double"), most=2, least=1)
    assert taken[0] == 0 and len(taken) == 2 and scores.count() == 4


def test_hurst_needs_ten_gaps():
    x = np.cumsum(np.random.default_rng(0).normal(size=40))
    assert complexity.hurst(x[:9]) == 0.5 and complexity.hurst(x) != 0.5
