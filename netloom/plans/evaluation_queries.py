"""Queries on joins of predictions and truth, metrics, and grouped statistics.

Truth: label quality of `labels` over documents. Prediction: documents of at least 400
characters are good; the confidence grows with the length. Every 7th document has no prediction, every 11th an unknown one.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.functions import exprs as X
from netloom.operators import evaluation as E
from netloom.operators import sessions as S
from netloom.plans import binding as B
from netloom.plans.window_queries import LABEL_SQL, _labelled

QUERIES: dict = {}
ORACLES: dict = {}


def _predictions(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").filter("doc_id % 7 <> 3")
    return d.select("doc_id", F.when(F.col("doc_id") % 11 == 5, -1).otherwise((F.col("n_chars") >= 400).cast("int")).alias("predicted"), F.round(F.least(F.col("n_chars") / 4000, F.lit(1.0)), 4).alias("confidence"))


def _truth(spark, sf_dir):
    return B.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"))


PRED = """pred AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN -1 WHEN n_chars >= 400 THEN 1 ELSE 0 END AS predicted, round(least(n_chars / 4000, 1.0), 4) AS confidence FROM documents WHERE doc_id % 7 <> 3),
truth AS (SELECT doc_id, quality AS truth FROM labels), al AS (SELECT doc_id, truth, coalesce(predicted, -1) AS predicted, confidence, predicted IS NULL AS is_missing FROM truth LEFT JOIN pred USING (doc_id))"""


def _aligned(spark, sf_dir):
    return E.align(_truth(spark, sf_dir), _predictions(spark, sf_dir), "doc_id")


def q_join_truth_left(spark, sf_dir):
    return _aligned(spark, sf_dir).select("doc_id", "truth", "predicted", "is_missing")


QUERIES["q_join_truth_left"] = q_join_truth_left
ORACLES["q_join_truth_left"] = f"WITH {PRED} SELECT doc_id, truth, predicted, is_missing FROM al"


def q_anti_unpaired(spark, sf_dir):
    p, t = _predictions(spark, sf_dir), _truth(spark, sf_dir)
    return E.unpaired(p, t, "doc_id").select("doc_id", F.lit("prediction").alias("side")).unionAll(E.unpaired(t, p, "doc_id").select("doc_id", F.lit("truth").alias("side")))


QUERIES["q_anti_unpaired"] = q_anti_unpaired
ORACLES["q_anti_unpaired"] = f"WITH {PRED} SELECT doc_id, 'prediction' AS side FROM pred WHERE doc_id NOT IN (SELECT doc_id FROM truth) UNION ALL SELECT doc_id, 'truth' FROM truth WHERE doc_id NOT IN (SELECT doc_id FROM pred)"


def q_join_obs_list(spark, sf_dir):
    """A list of observations is the denominator: first of several predictions, what is missing, what is extra."""
    many = _predictions(spark, sf_dir)
    twice = many.withColumn("seq", F.lit(0)).unionByName(many.filter("doc_id % 5 = 0").withColumn("seq", F.lit(1)).withColumn("predicted", F.lit(-1)))
    first = E.first_predictions(twice, "doc_id", "seq")
    a = E.align(_truth(spark, sf_dir), first, "doc_id")
    return a.groupBy("truth").agg(F.count("*").alias("n"), F.count_if("is_missing").alias("missing"), F.count_if(F.col("n_predictions") > 1).alias("repeated"), F.count_if(F.col("truth") == F.col("predicted")).alias("hits"))


QUERIES["q_join_obs_list"] = q_join_obs_list
ORACLES["q_join_obs_list"] = f"WITH {PRED} SELECT truth, count(*) AS n, count_if(is_missing) AS missing, count_if(NOT is_missing AND doc_id % 5 = 0) AS repeated, count_if(truth = predicted) AS hits FROM al GROUP BY truth"


def q_confusion(spark, sf_dir):
    return E.confusion(_aligned(spark, sf_dir))


QUERIES["q_confusion"] = q_confusion
ORACLES["q_confusion"] = f"WITH {PRED} SELECT truth, predicted, count(*) AS n FROM al GROUP BY ALL"


def _classes(spark, sf_dir):
    a = _aligned(spark, sf_dir)
    return E.by_class(E.confusion(a), _truth(spark, sf_dir).select(F.col("truth").alias("label")).distinct())


CLS = f"""{PRED}, n AS (SELECT count(*) AS total FROM al), cl AS (SELECT label, CAST((SELECT count(*) FROM al WHERE truth = label) AS BIGINT) AS support, (SELECT count(*) FROM al WHERE truth = label AND predicted = label) AS tp,
(SELECT count(*) FROM al WHERE truth <> label AND predicted = label) AS fp, (SELECT count(*) FROM al WHERE truth = label AND predicted <> label) AS fn, (SELECT count(*) FROM al WHERE truth <> label AND predicted <> label) AS tn FROM (SELECT DISTINCT truth AS label FROM truth)),
ra AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM cl), rf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ra)"""


def q_class_metrics(spark, sf_dir):
    return E.rates(_classes(spark, sf_dir)).select("label", "support", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


QUERIES["q_class_metrics"] = q_class_metrics
ORACLES["q_class_metrics"] = f"WITH {CLS} SELECT label, support, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM rf"


def q_metrics_macro(spark, sf_dir):
    return E.macro(_classes(spark, sf_dir))


QUERIES["q_metrics_macro"] = q_metrics_macro
ORACLES["q_metrics_macro"] = f"""WITH {CLS}, m AS (SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(avg(fpr), 6) AS macro_fpr, round(max(fpr), 6) AS max_fpr, count(*) AS n_classes FROM rf)
SELECT *, round(least(accuracy - 0.95::DOUBLE, macro_precision - 0.95::DOUBLE, macro_recall - 0.98::DOUBLE, 0.05::DOUBLE - max_fpr), 6) AS slack FROM m"""

STEPS = [round(0.3 + 0.05 * i, 2) for i in range(14)]


def q_threshold_search(spark, sf_dir):
    return E.thresholds(_aligned(spark, sf_dir).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))), STEPS)


QUERIES["q_threshold_search"] = q_threshold_search
ORACLES["q_threshold_search"] = f"WITH {PRED}, t AS (SELECT CAST(unnest([{', '.join(map(str, STEPS))}]) AS DOUBLE) AS threshold) SELECT threshold, round(count_if(coalesce(confidence, 0) >= threshold AND truth = predicted) / count(*), 6) AS accuracy, round(count_if(coalesce(confidence, 0) < threshold) / count(*), 6) AS rejected_rate FROM al, t GROUP BY threshold"


def q_background_fpr(spark, sf_dir):
    t = _labelled(spark, sf_dir).withColumn("alarm", F.col("confidence") >= 0.6)
    bg = F.col("label") == "background"
    return t.groupBy("capture_id").agg(F.count_if(bg).alias("background_windows"), F.count_if(bg & F.col("alarm")).alias("false_alarms"), F.round(F.count_if(bg & F.col("alarm")) / F.greatest(F.count_if(bg), F.lit(1)), 6).alias("background_fpr"), F.count_if(~bg & ~F.col("alarm")).alias("rejected"))


QUERIES["q_background_fpr"] = q_background_fpr
ORACLES["q_background_fpr"] = f"WITH {LABEL_SQL} SELECT capture_id, count_if(label = 'background') AS background_windows, count_if(label = 'background' AND confidence >= 0.6) AS false_alarms, round(count_if(label = 'background' AND confidence >= 0.6) / greatest(count_if(label = 'background'), 1), 6) AS background_fpr, count_if(label <> 'background' AND confidence < 0.6) AS rejected FROM lw GROUP BY capture_id"


def _events(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), (F.col("o_custkey") % 50).alias("terminal"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / 86400).alias("t"))
    return e.filter("id % 2 = 0").select(F.col("id").alias("predicted_id"), "label", "terminal", "t"), e.filter("id % 2 = 1").select(F.col("id").alias("truth_id"), "label", "terminal", "t")


TOLERANCE = 2.0
EV = f"""ev AS (SELECT o_orderkey AS id, o_orderstatus AS label, o_custkey % 50 AS terminal, epoch_us(o_orderdate) / 1e6 / 86400 AS t FROM orders),
pp AS (SELECT a.terminal, a.label, a.id AS predicted_id, b.id AS truth_id, round(a.t - b.t, 6) AS dt FROM ev a JOIN ev b ON a.terminal = b.terminal AND a.label = b.label AND a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.t - b.t) <= {TOLERANCE})"""


def q_interval_join(spark, sf_dir):
    p, t = _events(spark, sf_dir)
    return E.near_pairs(p, t, TOLERANCE, ["terminal", "label"]).select("terminal", "label", "predicted_id", "truth_id", F.round(F.col("t") - F.col("truth_t"), 6).alias("dt"))


QUERIES["q_interval_join"] = q_interval_join
ORACLES["q_interval_join"] = f"WITH {EV} SELECT terminal, label, predicted_id, truth_id, dt FROM pp"


def q_event_matching(spark, sf_dir):
    p, t = _events(spark, sf_dir)
    pairs = E.near_pairs(p, t, TOLERANCE, ["terminal", "label"])
    return E.match(E.connected_runs(pairs, ["terminal", "label"], "t", TOLERANCE), ["terminal", "label", "run"]).drop("run")


QUERIES["q_event_matching"] = q_event_matching


def q_ip_feed_fallback(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select("c_custkey", (F.lit(167772160) + (F.col("c_custkey") * 37 % 4096)).cast("long").alias("ip_u32"))
    feed = B.table(spark, sf_dir, "supplier").select((F.lit(167772160) + (F.col("s_suppkey") * 53 % 2048)).cast("long").alias("ip_u32"), F.concat(F.lit("app"), F.col("s_suppkey") % 6).alias("label"), F.col("s_suppkey").alias("row"))
    return E.feed_lookup(c, feed).select("c_custkey", "ip_u32", "net24", "exact", "feed_label")


QUERIES["q_ip_feed_fallback"] = q_ip_feed_fallback
ORACLES["q_ip_feed_fallback"] = """WITH c AS (SELECT c_custkey, 167772160 + c_custkey * 37 % 4096 AS ip_u32 FROM customer), f AS (SELECT 167772160 + s_suppkey * 53 % 2048 AS ip_u32, 'app' || (s_suppkey % 6) AS label, s_suppkey AS row_no FROM supplier),
e AS (SELECT ip_u32, arg_min(label, row_no) AS exact FROM f GROUP BY 1), n AS (SELECT ip_u32 & 4294967040 AS net24, arg_min(label, row_no) AS by_net FROM f GROUP BY 1)
SELECT c_custkey, ip_u32, ip_u32 & 4294967040 AS net24, exact, coalesce(exact, by_net) AS feed_label FROM c LEFT JOIN e USING (ip_u32) LEFT JOIN n ON n.net24 = ip_u32 & 4294967040"""


def q_parity_join(spark, sf_dir):
    """Two extractions of one long table, the second with planted differences."""
    a = B.matrix(spark, sf_dir)
    b = a.filter("NOT (id % 50 = 1 AND feature = 3)").withColumn("x", F.when((F.col("id") % 40 == 2) & (F.col("feature") == 5), F.col("x") + 1).otherwise(F.col("x")))
    return E.parity(a, b, ["id", "feature"]).select("id", "feature", F.col("right").isNull().alias("only_left"))


QUERIES["q_parity_join"] = q_parity_join
ORACLES["q_parity_join"] = f"WITH {B.MAT} SELECT id, feature, id % 50 = 1 AND feature = 3 AS only_left FROM mat WHERE (id % 50 = 1 AND feature = 3) OR (id % 40 = 2 AND feature = 5)"


def q_split_join(spark, sf_dir):
    """Three tables joined by key, columns kept apart by suffix, a checked registered split."""
    n, r, c = (B.table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    a = c.groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    s = B.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"))
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(a, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.select("n_nationkey", "r_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


QUERIES["q_split_join"] = q_split_join
ORACLES["q_split_join"] = "SELECT n_nationkey, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation JOIN region ON n_regionkey = r_regionkey"


def q_endpoint_pool(spark, sf_dir):
    """Mean probability of each class over rows that share a capture and an endpoint, given to every such row."""
    w = Window.partitionBy("capture", "endpoint")
    rows = B.wide(spark, sf_dir).select("id", (F.col("id") % 7).alias("capture"), (F.col("id") % 13).alias("endpoint"), *[F.abs(F.col(f"f{i}")).alias(f"p{i}") for i in range(64)])
    return rows.select("id", *[F.round(F.avg(f"p{i}").over(w), 6).alias(f"pooled{i}") for i in range(64)])


QUERIES["q_endpoint_pool"] = q_endpoint_pool
ORACLES["q_endpoint_pool"] = f"WITH {B.WIDE} SELECT id, " + ", ".join(f"round(avg(abs(f{i})) OVER (PARTITION BY id % 7, id % 13), 6) AS pooled{i}" for i in range(64)) + " FROM wide"


def q_capture_z(spark, sf_dir):
    w = Window.partitionBy("label", "feature")
    m = B.matrix(spark, sf_dir)
    z = (F.col("x") - F.avg("x").over(w)) / F.stddev_samp("x").over(w)
    ok = F.coalesce(F.stddev_samp("x").over(w), F.lit(0.0)) > 1e-12
    return m.select("id", "feature", F.round(F.when(ok, z).otherwise(0.0), 5).alias("z"))


QUERIES["q_capture_z"] = q_capture_z
ORACLES["q_capture_z"] = f"WITH {B.MAT} SELECT id, feature, round(CASE WHEN coalesce(stddev_samp(x) OVER w, 0) > 1e-12 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w ELSE 0 END, 5) AS z FROM mat WINDOW w AS (PARTITION BY label, feature)"


def q_capture_pctrank(spark, sf_dir):
    """Rank as a share, ties at their mean."""
    w = Window.partitionBy("l_suppkey")
    o, same = w.orderBy("l_quantity"), Window.partitionBy("l_suppkey", "l_quantity")
    r = (F.rank().over(o) + (F.count("*").over(same) - 1) / 2) / F.count("*").over(w)
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.round(r, 6).alias("pct"))


QUERIES["q_capture_pctrank"] = q_capture_pctrank
ORACLES["q_capture_pctrank"] = "SELECT l_orderkey, l_linenumber, l_suppkey, round((rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2) / count(*) OVER (PARTITION BY l_suppkey), 6) AS pct FROM lineitem"

_ROLL = {f"{p}_{f}": e for p in ("quantity", "extendedprice") for f, e in {"mean": f"avg(l_{p})", "std": f"coalesce(stddev_samp(l_{p}), 0)", "max": f"max(l_{p})"}.items()} | {"n_windows": "count(*)"}


def q_session_rollup(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(*X.rounded(_ROLL, 4))


QUERIES["q_session_rollup"] = q_session_rollup
ORACLES["q_session_rollup"] = f"SELECT l_suppkey, l_returnflag, {X.rounded_ansi(_ROLL, 4)} FROM lineitem GROUP BY ALL"


def q_capture_context(spark, sf_dir):
    w = Window.partitionBy("l_suppkey")
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.avg("l_quantity").over(w), 6).alias("ctx_quantity"), F.round(F.avg("l_discount").over(w), 6).alias("ctx_discount"))


QUERIES["q_capture_context"] = q_capture_context
ORACLES["q_capture_context"] = "SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER w, 6) AS ctx_quantity, round(avg(l_discount) OVER w, 6) AS ctx_discount FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)"


def q_capture_majority(spark, sf_dir):
    """The most frequent label of each capture (ties: first in order), with its share and the number of labels."""
    c = _labelled(spark, sf_dir).groupBy("capture_id", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("capture_id")
    r = c.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "label"))).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("n_labels", F.count("*").over(w))
    return r.filter("r = 1").select("capture_id", "label", "n", "share", "n_labels")


QUERIES["q_capture_majority"] = q_capture_majority
ORACLES["q_capture_majority"] = f"WITH {LABEL_SQL}, c AS (SELECT capture_id, label, count(*) AS n FROM lw GROUP BY ALL) SELECT capture_id, label, n, round(n / sum(n) OVER (PARTITION BY capture_id), 6) AS share, count(*) OVER (PARTITION BY capture_id) AS n_labels FROM c QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, label) = 1"


def q_misclassified_kinds(spark, sf_dir):
    return E.kinds(_aligned(spark, sf_dir)).groupBy("kind", "truth", "predicted").agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


QUERIES["q_misclassified_kinds"] = q_misclassified_kinds
ORACLES["q_misclassified_kinds"] = f"WITH {PRED}, k AS (SELECT *, CASE WHEN is_missing THEN 'unpaired_truth' WHEN predicted = -1 THEN 'miss_unknown' WHEN predicted <> truth THEN 'confusion' END AS kind FROM al) SELECT kind, truth, predicted, count(*) AS n, min(doc_id) AS example FROM k WHERE kind IS NOT NULL GROUP BY ALL"


def q_per_pair_report(spark, sf_dir):
    a = _aligned(spark, sf_dir).withColumn("pair", F.col("doc_id") % 6)
    hit = F.col("truth") == F.col("predicted")
    return a.groupBy("pair").agg(F.count("*").alias("n"), F.round(F.count_if(hit) / F.count("*"), 6).alias("accuracy"), F.round(F.count_if(hit & (F.col("truth") == 1)) / F.greatest(F.count_if(F.col("truth") == 1), F.lit(1)), 6).alias("recall"))


QUERIES["q_per_pair_report"] = q_per_pair_report
ORACLES["q_per_pair_report"] = f"WITH {PRED} SELECT doc_id % 6 AS pair, count(*) AS n, round(count_if(truth = predicted) / count(*), 6) AS accuracy, round(count_if(truth = predicted AND truth = 1) / greatest(count_if(truth = 1), 1), 6) AS recall FROM al GROUP BY 1"


def q_vocab(spark, sf_dir):
    return E.vocabulary(B.table(spark, sf_dir, "events"), "event_type")


QUERIES["q_vocab"] = q_vocab
ORACLES["q_vocab"] = "SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type <> '')"


def q_label_histogram(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    v = E.vocabulary(e.filter("event_type <> 'error'"), "event_type")
    return E.with_ids(e, "event_type", v, "label_id").groupBy("label_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


QUERIES["q_label_histogram"] = q_label_histogram
ORACLES["q_label_histogram"] = "WITH v AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type <> 'error')) SELECT CAST(coalesce(i, -1) AS INTEGER) AS label_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM events LEFT JOIN v ON event_type = label GROUP BY 1"


def q_required_join(spark, sf_dir):
    """Orders with their customers; an order without one would be an error."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")
    return E.required_join(o, c, ["key"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))


QUERIES["q_required_join"] = q_required_join
ORACLES["q_required_join"] = "SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"


def q_merge_suffixes(spark, sf_dir):
    """Three tables of figures by nation; columns of one name are told apart."""
    t = lambda name, key, bal: B.table(spark, sf_dir, name).groupBy(F.col(key).alias("nation")).agg(F.count("*").alias("n"), F.round(F.avg(bal), 4).alias("balance"))
    n = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    return E.merged({"customer": t("customer", "c_nationkey", "c_acctbal"), "supplier": t("supplier", "s_nationkey", "s_acctbal"), "nation": n}, ["nation"])


QUERIES["q_merge_suffixes"] = q_merge_suffixes
ORACLES["q_merge_suffixes"] = """SELECT n_nationkey AS nation, n_customer, balance_customer, n_supplier, balance_supplier, n_name AS name FROM nation
JOIN (SELECT c_nationkey, count(*) AS n_customer, round(avg(c_acctbal), 4) AS balance_customer FROM customer GROUP BY 1) ON n_nationkey = c_nationkey JOIN (SELECT s_nationkey, count(*) AS n_supplier, round(avg(s_acctbal), 4) AS balance_supplier FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey"""


def q_observation_endpoints(spark, sf_dir):
    """Remote endpoints of the sessions that a list of observations asks for."""
    from netloom.plans import flow_queries as FQ

    wanted = B.ctx(spark, sf_dir).filter("flow % 3 = 0 AND sid = 0").select("capture_id", "flow", "sid")
    return E.endpoints_of(FQ.q_remote_endpoint(spark, sf_dir), wanted, ["capture_id", "flow", "sid"])


def _endpoint_sql() -> str:
    from netloom.plans import flow_queries as FQ

    return f"SELECT capture_id, flow, sid, remote_ip FROM ({FQ.ORACLES['q_remote_endpoint']}) WHERE flow % 3 = 0 AND sid = 0"


QUERIES["q_observation_endpoints"] = q_observation_endpoints
ORACLES["q_observation_endpoints"] = _endpoint_sql()


def q_expired_sessions(spark, sf_dir):
    """Sessions that are idle for over a timeout when their capture ends."""
    s = S.summaries(B.sessions(spark, sf_dir))
    ends = s.groupBy("capture_id").agg(F.max("end_ts").alias("now"))
    return S.expired(s.join(ends, "capture_id"), F.col("now"), 48.0).groupBy("capture_id").agg(F.count("*").alias("expired"), F.sum("n_packets").alias("packets"))


QUERIES["q_expired_sessions"] = q_expired_sessions
ORACLES["q_expired_sessions"] = f"WITH {B.SES}, s AS (SELECT capture_id, flow, sid, count(*) AS n, arg_max(ts, pkt_idx) AS e FROM ses GROUP BY ALL), t AS (SELECT *, max(e) OVER (PARTITION BY capture_id) AS now FROM s) SELECT capture_id, count(*) AS expired, CAST(sum(n) AS BIGINT) AS packets FROM t WHERE now - e > 48 GROUP BY capture_id"


def q_state_counters(spark, sf_dir):
    return S.state_counters(S.summaries(B.sessions(spark, sf_dir)), 20)


QUERIES["q_state_counters"] = q_state_counters
ORACLES["q_state_counters"] = f"WITH {B.SES}, s AS (SELECT capture_id, flow, sid, max(sid) OVER (PARTITION BY capture_id, flow) AS last FROM (SELECT DISTINCT capture_id, flow, sid FROM ses)) SELECT capture_id, count(*) AS sessions, count_if(sid < last) AS closed, greatest(count_if(sid < last) - 20, 0) AS dropped, 0 AS evicted FROM s GROUP BY capture_id"


def q_matrix_aggregate(spark, sf_dir):
    from netloom.operators import selection as L

    a = L.aggregated(B.matrix(spark, sf_dir), ["label"])
    return a.select("label", "feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "sum")], "n")


QUERIES["q_matrix_aggregate"] = q_matrix_aggregate
ORACLES["q_matrix_aggregate"] = f"WITH {B.MAT} SELECT label, feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(median(x), 6) AS median, round(sum(x), 6) AS sum, count(x) AS n FROM mat GROUP BY ALL"
