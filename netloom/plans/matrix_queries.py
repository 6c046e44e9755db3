"""Queries on feature matrices: rules, selection, splits, rankings, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import exprs as X
from netloom.operators import flow_features as FF
from netloom.operators import ranking as K
from netloom.operators import rules as R
from netloom.operators import selection as L
from netloom.operators import sessions as S
from netloom.plans import binding as B
from netloom.plans.flow_queries import KEYS

QUERIES: dict = {}
ORACLES: dict = {}

RULES = [
    {"rule_id": "r0", "label": "low", "priority": 2, "confidence": 0.9, "conditions": [{"feature": "f0", "op": "<=", "value": -0.05}, {"feature": "f1", "op": "range", "value": [-0.3, 0.1]}]},
    {"rule_id": "r1", "label": "high", "priority": 1, "confidence": 0.8, "conditions": [{"feature": "f0", "op": ">", "value": 0.1}]},
    {"rule_id": "r2", "label": "odd", "priority": 0, "confidence": 0.2, "conditions": [{"feature": "f2", "op": ">=", "value": -1}]},
    {"rule_id": "r3", "label": "never", "priority": 0, "confidence": 1.0, "conditions": []},
    {"rule_id": "r4", "label": "rest", "priority": 5, "confidence": 0.7, "conditions": [{"feature": "f3", "op": "!=", "value": 0}, {"feature": "f4", "op": "<", "value": 0.05}]},
]
CASE = """CASE WHEN f0 > 0.1 THEN 'r1' WHEN f0 <= -0.05 AND f1 BETWEEN -0.3 AND 0.1 THEN 'r0' WHEN f3 <> 0 AND f4 < 0.05 THEN 'r4' END"""


def q_rule_match_priority(spark, sf_dir):
    return R.first_match(B.wide(spark, sf_dir), RULES, 0.5).select("id", "match.rule_id", "match.label", "match.confidence")


QUERIES["q_rule_match_priority"] = q_rule_match_priority
ORACLES["q_rule_match_priority"] = f"WITH {B.WIDE}, m AS (SELECT id, {CASE} AS rule_id FROM wide) SELECT id, rule_id, CASE rule_id WHEN 'r0' THEN 'low' WHEN 'r1' THEN 'high' WHEN 'r4' THEN 'rest' ELSE 'unknown' END AS label, CAST(CASE rule_id WHEN 'r0' THEN 0.9 WHEN 'r1' THEN 0.8 WHEN 'r4' THEN 0.7 ELSE 0 END AS DOUBLE) AS confidence FROM m"


def q_rule_exists_missing(spark, sf_dir):
    """Missing and NaN features: every operator on a column that has them; then the same with a sentinel for missing values."""
    d = B.wide(spark, sf_dir).select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, float("nan")).otherwise(F.col("f0")).alias("x"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "alpha beta").alias("s"))
    types = dict(d.dtypes)
    tests = {"le": ("x", "<=", 0.0), "ge": ("x", ">=", 0.0), "ne": ("x", "!=", 0.0), "rng": ("x", "range", [-1.0, 1.0]), "ex": ("x", "exists", None), "nex": ("x", "not_exists", None), "sex": ("s", "exists", None), "snex": ("s", "not_exists", None), "has": ("s", "contains", "beta"), "eq": ("s", "==", "alpha beta"), "gone": ("zz", "<=", 1.0), "gone_nex": ("zz", "not_exists", None), "bad": ("x", "~", 1.0)}
    cols = [R.condition({"feature": f, "op": o, "value": v}, types).alias(n) for n, (f, o, v) in tests.items()]
    return d.select("id", *cols, R.condition({"feature": "x", "op": "<=", "value": -0.5}, types, missing=-1.0).alias("sentinel_le"))


QUERIES["q_rule_exists_missing"] = q_rule_exists_missing
ORACLES["q_rule_exists_missing"] = f"""WITH {B.WIDE}, d AS (SELECT id, id % 5 = 0 AS nul, id % 5 = 1 AS nan, f0 AS x, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'alpha beta' END AS s FROM wide)
SELECT id, NOT nul AND NOT nan AND x <= 0 AS le, NOT nul AND NOT nan AND x >= 0 AS ge, NOT nul AND (nan OR x <> 0) AS ne, NOT nul AND NOT nan AND x BETWEEN -1 AND 1 AS rng, NOT nul AS ex, nul AS nex,
s IS NOT NULL AND s <> '' AS sex, s IS NULL OR s = '' AS snex, coalesce(contains(s, 'beta'), FALSE) AS has, coalesce(s = 'alpha beta', FALSE) AS eq, FALSE AS gone, TRUE AS gone_nex, FALSE AS bad, nul OR (NOT nan AND x <= -0.5) AS sentinel_le FROM d"""


def q_stat_rules(spark, sf_dir):
    m = B.matrix(spark, sf_dir)
    return R.statistical_rules(m, outside=0.95)


QUERIES["q_stat_rules"] = q_stat_rules
STAT_SQL = f"""{B.MAT}, q AS (SELECT label AS rule_label, feature, round(quantile_cont(x, 0.05), 4) AS low, round(quantile_cont(x, 0.95), 4) AS high FROM mat GROUP BY ALL HAVING count(*) >= 3),
i AS (SELECT rule_label, feature, low, high, avg(CASE WHEN x BETWEEN low AND high THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS outside FROM mat JOIN q USING (feature) WHERE label <> rule_label GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_label ORDER BY round(outside, 9), feature) AS r, count(*) OVER (PARTITION BY rule_label) AS n FROM i WHERE outside < 0.95)"""
ORACLES["q_stat_rules"] = f"WITH {STAT_SQL} SELECT rule_label AS label, feature, low, high, round(outside, 6) AS outside FROM r WHERE r <= 8 AND n >= 2"


def q_rule_replay(spark, sf_dir):
    """Precision and recall of each range rule when replayed on the rows it was made from."""
    m = B.matrix(spark, sf_dir)
    rules = R.statistical_rules(m, outside=0.95).withColumnRenamed("label", "rule_label")
    hit = m.join(rules, "feature").withColumn("hit", F.col("x").between(F.col("low"), F.col("high")))
    per = hit.groupBy("rule_label", "id", "label").agg(F.bool_and("hit").alias("hit"))
    mine = F.col("label") == F.col("rule_label")
    return per.groupBy("rule_label").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & mine).alias("true_hits"), F.count_if(mine).alias("support"))


QUERIES["q_rule_replay"] = q_rule_replay
ORACLES["q_rule_replay"] = f"WITH {STAT_SQL}, p AS (SELECT rule_label, id, label, bool_and(x BETWEEN low AND high) AS hit FROM mat JOIN r USING (feature) WHERE r <= 8 AND n >= 2 GROUP BY ALL) SELECT rule_label, count_if(hit) AS hits, count_if(hit AND label = rule_label) AS true_hits, count_if(label = rule_label) AS support FROM p GROUP BY rule_label"


def q_rule_revision_diff(spark, sf_dir):
    """Rows whose label changes when one rule is disabled and another edited."""
    edited = R.revise(RULES, [{"rule_id": "r1", "action": "disable"}, {"rule_id": "r4", "action": "edit", "conditions": [{"feature": "f4", "op": "<", "value": 0.0}]}], [f"f{i}" for i in range(64)])
    both = R.first_match(R.first_match(B.wide(spark, sf_dir), RULES, 0.5, out="before"), edited, 0.5, out="after")
    return both.select("id", F.col("before.label").alias("before_label"), F.col("after.label").alias("after_label")).filter("before_label <> after_label")


QUERIES["q_rule_revision_diff"] = q_rule_revision_diff
ORACLES["q_rule_revision_diff"] = f"WITH {B.WIDE}, m AS (SELECT id, coalesce(CASE {CASE} WHEN 'r0' THEN 'low' WHEN 'r1' THEN 'high' WHEN 'r4' THEN 'rest' END, 'unknown') AS before_label, CASE WHEN f0 <= -0.05 AND f1 BETWEEN -0.3 AND 0.1 THEN 'low' WHEN f4 < 0.0 THEN 'rest' ELSE 'unknown' END AS after_label FROM wide) SELECT * FROM m WHERE before_label <> after_label"


def q_tree_rules(spark, sf_dir):
    rules = R.tree_rules(B.wide(spark, sf_dir), [f"f{i}" for i in range(64)], "label", purity=0.3, depth=4)
    rows = [(r["rule_id"], r["label"], len(r["conditions"]), r["confidence"], "; ".join(f"{c['feature']} {c['op']} {c['value']:.4g}" for c in r["conditions"])) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, label int, n_conditions int, confidence double, text string")


QUERIES["q_tree_rules"] = q_tree_rules

DETECT = [
    {"rule_id": "d0", "label": "bulk", "priority": 0, "confidence": 0.9, "conditions": [{"feature": "size_mean", "op": ">=", "value": 300}, {"feature": "total_packets", "op": ">=", "value": 4}]},
    {"rule_id": "d1", "label": "chat", "priority": 1, "confidence": 0.8, "conditions": [{"feature": "size_mean", "op": "range", "value": [100, 240]}]},
    {"rule_id": "d2", "label": "steady", "priority": 2, "confidence": 0.7, "conditions": [{"feature": "iat_mean", "op": "<", "value": 8}]},
]
_FAST = {"total_packets": "count(*)", "total_bytes": "sum(length)", "size_mean": "avg(length)", "size_std": "stddev_pop(length)", "iat_mean": "coalesce(avg(iat), 0)", "fwd_share": "count_if(direction = 1) / cast(count(*) as double)"}


def q_detect(spark, sf_dir):
    f = B.ctx(spark, sf_dir).groupBy(*S.SESSION).agg(*X.rounded(_FAST))
    return R.first_match(f, DETECT, 0.5).select(*S.SESSION, *_FAST, "match.rule_id", "match.label", "match.confidence")


QUERIES["q_detect"] = q_detect
ORACLES["q_detect"] = f"WITH {B.CTX}, f AS (SELECT {KEYS}, {X.rounded_ansi(_FAST)} FROM ctx GROUP BY {KEYS}), m AS (SELECT *, CASE WHEN size_mean >= 300 AND total_packets >= 4 THEN 'd0' WHEN size_mean BETWEEN 100 AND 240 THEN 'd1' WHEN iat_mean < 8 THEN 'd2' END AS rule_id FROM f) SELECT *, CASE rule_id WHEN 'd0' THEN 'bulk' WHEN 'd1' THEN 'chat' WHEN 'd2' THEN 'steady' ELSE 'unknown' END AS label, CAST(CASE rule_id WHEN 'd0' THEN 0.9 WHEN 'd1' THEN 0.8 WHEN 'd2' THEN 0.7 ELSE 0 END AS DOUBLE) AS confidence FROM m"


def _r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def q_basic_filter(spark, sf_dir):
    m = B.matrix(spark, sf_dir).withColumn("x", F.when((F.col("feature") == 3) & (F.col("id") % 3 > 0), None).when(F.col("feature") == 4, 1.0).otherwise(F.col("x")))
    return _r6(L.basic_filter(m), "missing", "std")


QUERIES["q_basic_filter"] = q_basic_filter
ORACLES["q_basic_filter"] = f"WITH {B.MAT}, m AS (SELECT feature, CASE WHEN feature = 3 AND id % 3 > 0 THEN NULL WHEN feature = 4 THEN 1.0 ELSE x END AS x FROM mat) SELECT feature, round(avg(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS missing, round(stddev_samp(x), 6) AS std FROM m GROUP BY feature HAVING avg(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) <= 0.5 AND coalesce(stddev_samp(x), 0) >= 1e-10"


def q_spearman(spark, sf_dir):
    return L.spearman(B.matrix(spark, sf_dir)).select("a", "b", F.round("rho", 5).alias("rho"))


QUERIES["q_spearman"] = q_spearman
ORACLES["q_spearman"] = f"WITH {B.MAT}, r AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS r FROM mat) SELECT p.feature AS a, q.feature AS b, round(corr(p.r, q.r), 5) AS rho FROM r p JOIN r q ON p.id = q.id AND p.feature < q.feature GROUP BY ALL"


def q_anova_f(spark, sf_dir):
    return L.anova_f(B.matrix(spark, sf_dir)).select("feature", F.round("f", 5).alias("f"))


QUERIES["q_anova_f"] = q_anova_f
ORACLES["q_anova_f"] = f"WITH {B.MAT}, g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM mat GROUP BY ALL), t AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS gr FROM g) SELECT feature, round((sum(n * (m - gr) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f FROM t GROUP BY feature"

BIN_SQL = f"{B.MAT}, en AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM mat GROUP BY feature), bn AS (SELECT mat.*, CAST(least(floor((x - lo) / greatest(hi - lo, 1e-12) * 8), 7) AS BIGINT) AS bin FROM mat JOIN en USING (feature))"


def q_mi_binned(spark, sf_dir):
    return L.mutual_information(B.matrix(spark, sf_dir)).select("feature", F.round("mi", 6).alias("mi"))


QUERIES["q_mi_binned"] = q_mi_binned
MI_SQL = f"{BIN_SQL}, c AS (SELECT feature, bin, label, count(*) AS c FROM bn GROUP BY ALL), pc AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS cb, sum(c) OVER (PARTITION BY feature, label) AS cl FROM c), mi AS (SELECT feature, sum(c / n * ln(c * n / (cb * cl))) AS mi FROM pc GROUP BY feature)"
ORACLES["q_mi_binned"] = f"WITH {MI_SQL} SELECT feature, round(mi, 6) AS mi FROM mi"


def q_conditional_mi(spark, sf_dir):
    return L.conditional_information(B.matrix(spark, sf_dir), 0).select("feature", F.round("cmi", 6).alias("cmi"))


QUERIES["q_conditional_mi"] = q_conditional_mi
ORACLES["q_conditional_mi"] = f"WITH {BIN_SQL.replace('* 8), 7)', '* 4), 3)')}, z AS (SELECT id, bin AS z FROM bn WHERE feature = 0), c AS (SELECT feature, z, bin, label, count(*) AS c FROM bn JOIN z USING (id) WHERE feature > 0 GROUP BY ALL), p AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, z) AS cz, sum(c) OVER (PARTITION BY feature, z, bin) AS cb, sum(c) OVER (PARTITION BY feature, z, label) AS cl FROM c) SELECT feature, round(sum(c / n * ln(c * cz / (cb * cl))), 6) AS cmi FROM p GROUP BY feature"


def q_discriminative_power(spark, sf_dir):
    return L.discriminative_power(B.matrix(spark, sf_dir)).select("feature", F.round("power", 6).alias("power"))


QUERIES["q_discriminative_power"] = q_discriminative_power
ORACLES["q_discriminative_power"] = f"WITH {B.MAT}, m AS (SELECT feature, label, avg(x) AS m FROM mat GROUP BY ALL), v AS (SELECT feature, var_samp(x) AS v FROM mat GROUP BY feature) SELECT feature, round(var_pop(m) / (any_value(v) + 1e-10), 6) AS power FROM m JOIN v USING (feature) GROUP BY feature"


def _fused(spark, sf_dir):
    m = B.matrix(spark, sf_dir)
    return L.fused(L.discriminative_power(m).select("feature", F.col("power").alias("score")), L.mutual_information(m).select("feature", F.col("mi").alias("score")))


def q_fused_scores(spark, sf_dir):
    return _fused(spark, sf_dir).select("feature", F.round("score", 5).alias("score"))


QUERIES["q_fused_scores"] = q_fused_scores
ORACLES["q_fused_scores"] = f"WITH {MI_SQL}, m AS (SELECT feature, label, avg(x) AS m FROM mat GROUP BY ALL), v AS (SELECT feature, var_samp(x) AS v FROM mat GROUP BY feature), d AS (SELECT feature, var_pop(m) / (any_value(v) + 1e-10) AS p FROM m JOIN v USING (feature) GROUP BY feature), j AS (SELECT feature, p, mi FROM d JOIN mi USING (feature)) SELECT feature, round(0.6 * (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()) + 0.4 * (mi - min(mi) OVER ()) / (max(mi) OVER () - min(mi) OVER ()), 5) AS score FROM j"


def q_greedy_topk(spark, sf_dir):
    m = B.matrix(spark, sf_dir)
    scores = L.mutual_information(m).select("feature", F.col("mi").alias("score"))
    taken = L.greedy(scores, L.spearman(m, 0.08), 12)
    return spark.createDataFrame(list(enumerate(taken)), "place int, feature int")


QUERIES["q_greedy_topk"] = q_greedy_topk
ORACLES["q_greedy_topk"] = f"""WITH RECURSIVE {MI_SQL}, rr AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS r FROM mat),
sp AS (SELECT p.feature AS a, q.feature AS b FROM rr p JOIN rr q ON p.id = q.id AND p.feature < q.feature GROUP BY ALL HAVING abs(corr(p.r, q.r)) > 0.08), nb AS (SELECT a, list(b) AS l FROM (SELECT a, b FROM sp UNION ALL SELECT b, a FROM sp) GROUP BY a),
od AS (SELECT feature, coalesce(l, []::INTEGER[]) AS l, row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS rn FROM mi LEFT JOIN nb ON a = feature),
g(step, taken) AS (SELECT 0::BIGINT, []::INTEGER[] UNION ALL SELECT step + 1, CASE WHEN len(taken) < 12 AND len(list_intersect(taken, l)) = 0 THEN list_append(taken, feature) ELSE taken END FROM g JOIN od ON rn = step + 1),
z AS (SELECT taken FROM g ORDER BY step DESC LIMIT 1), y AS (SELECT taken || (SELECT list(feature ORDER BY rn) FROM od WHERE NOT list_contains(taken, feature))[1:greatest(4 - len(taken), 0)] AS taken FROM z)
SELECT CAST(unnest(range(len(taken))) AS INTEGER) AS place, unnest(taken) AS feature FROM y"""


def q_importance(spark, sf_dir):
    """Importances of a random forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = [f"f{i}" for i in range(64)]
    d = VectorAssembler(inputCols=names, outputCol="v").transform(B.wide(spark, sf_dir).withColumn("label", F.col("label").cast("double")))
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=20, maxDepth=5, seed=7).fit(d)
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


QUERIES["q_importance"] = q_importance


def q_group_split(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return K.group_split(rows, "o_custkey", "s7").groupBy("o_custkey", "split").agg(F.count("*").alias("n"))


QUERIES["q_group_split"] = q_group_split
ORACLES["q_group_split"] = "WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('s7:' || o_custkey), o_custkey) AS i, count(*) OVER () AS n FROM g), s AS (SELECT o_custkey, CASE WHEN i <= round_even(n * 0.6, 0) THEN 'train' WHEN i <= round_even(n * 0.8, 0) THEN 'validation' ELSE 'test' END AS split FROM r) SELECT o_custkey, split, count(*) AS n FROM orders JOIN s USING (o_custkey) GROUP BY ALL"


def q_stratified_split(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return K.stratified_split(e, "label", "vec_id", "s7").select("vec_id", "label", "split")


QUERIES["q_stratified_split"] = q_stratified_split
ORACLES["q_stratified_split"] = "WITH s AS (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('s7:' || label || ':' || vec_id), vec_id) - 1) / count(*) OVER (PARTITION BY label) AS s FROM embeddings) SELECT vec_id, label, CASE WHEN s < 0.6 THEN 'train' WHEN s < 0.8 THEN 'validation' ELSE 'test' END AS split FROM s"


def q_leakage_audit(spark, sf_dir):
    """Customers whose orders a split by order leaves in several parts."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return K.leaks(K.stratified_split(o, "o_orderstatus", "o_orderkey", "s7"), "o_custkey")


QUERIES["q_leakage_audit"] = q_leakage_audit
ORACLES["q_leakage_audit"] = "WITH s AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('s7:' || o_orderstatus || ':' || o_orderkey), o_orderkey) - 1) / count(*) OVER (PARTITION BY o_orderstatus) AS s FROM orders), p AS (SELECT o_custkey, CASE WHEN s < 0.6 THEN 'train' WHEN s < 0.8 THEN 'validation' ELSE 'test' END AS split FROM s) SELECT o_custkey, count(DISTINCT split) AS n_splits, array_to_string(list_sort(list(DISTINCT split)), '+') AS splits FROM p GROUP BY o_custkey HAVING count(DISTINCT split) > 1"


def q_round_robin(spark, sf_dir):
    p = B.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("pool"))
    return K.round_robin(p, "pool", [K.seeded("s7", F.col("p_partkey"))], 100).select("pool", "p_partkey", "turn")


QUERIES["q_round_robin"] = q_round_robin
ORACLES["q_round_robin"] = "WITH r AS (SELECT p_partkey % 7 AS pool, p_partkey, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY md5('s7:' || p_partkey)) AS turn FROM part) SELECT * FROM r ORDER BY turn, pool LIMIT 100"


def q_priority_head(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return K.heads(o, "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], 10)


QUERIES["q_priority_head"] = q_priority_head
ORACLES["q_priority_head"] = "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER w AS place FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 10"


def _scores(spark, sf_dir):
    m = B.matrix(spark, sf_dir).withColumn("dataset", F.col("id") % 4)
    g = m.groupBy("dataset", "feature", "label").agg(F.avg("x").alias("m"))
    return g.groupBy("dataset", "feature").agg(F.round(F.var_pop("m"), 9).alias("score"))


SCORE_SQL = f"{B.MAT}, g AS (SELECT id % 4 AS dataset, feature, label, avg(x) AS m FROM mat GROUP BY ALL), sc AS (SELECT dataset, feature, round(var_pop(m), 9) AS score FROM g GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, feature) AS place FROM sc)"


def q_score_table(spark, sf_dir):
    return _r6(K.top_support(_scores(spark, sf_dir), 20), "mean", "std", "min", "max")


QUERIES["q_score_table"] = q_score_table
ORACLES["q_score_table"] = f"WITH {SCORE_SQL} SELECT feature, count_if(place <= 20) AS support, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max FROM rk GROUP BY feature"


def q_jaccard_support(spark, sf_dir):
    return _r6(K.jaccard(_scores(spark, sf_dir), 20), "jaccard")


QUERIES["q_jaccard_support"] = q_jaccard_support
ORACLES["q_jaccard_support"] = f"WITH {SCORE_SQL}, t AS (SELECT * FROM rk WHERE place <= 20), d AS (SELECT DISTINCT dataset FROM t) SELECT p.dataset AS a, q.dataset AS b, round((SELECT count(*) FROM t x JOIN t y USING (feature) WHERE x.dataset = p.dataset AND y.dataset = q.dataset) / (40 - (SELECT count(*) FROM t x JOIN t y USING (feature) WHERE x.dataset = p.dataset AND y.dataset = q.dataset)), 6) AS jaccard FROM d p JOIN d q ON p.dataset < q.dataset"


def q_oversample(spark, sf_dir):
    l = B.table(spark, sf_dir, "labels").select("doc_id", "quality")  # noqa: E741
    return K.oversample(l, "quality", "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.max("copy").alias("most"), F.count_distinct("doc_id").alias("n_docs"))


QUERIES["q_oversample"] = q_oversample
ORACLES["q_oversample"] = "WITH s AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), m AS (SELECT quantile_cont(n, 0.5) AS m FROM s) SELECT quality, greatest(n, CAST(floor(m) AS BIGINT)) AS n, greatest(CAST(floor((m - 1) / n) AS BIGINT), 0) AS most, n AS n_docs FROM s, m"


def q_schema_union(spark, sf_dir):
    """Tables of different columns, one below the other; what a table lacks is null."""
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    s = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return c.withColumn("kind", F.lit("c")).unionByName(s.withColumn("kind", F.lit("s")), allowMissingColumns=True)


QUERIES["q_schema_union"] = q_schema_union
ORACLES["q_schema_union"] = "SELECT c_custkey AS key, c_nationkey AS nation, NULL::DOUBLE AS balance, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal, 's' FROM supplier"


def q_class_profile(spark, sf_dir):
    m = B.matrix(spark, sf_dir)
    return m.groupBy("label", "feature").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.count("*").alias("n"))


QUERIES["q_class_profile"] = q_class_profile
ORACLES["q_class_profile"] = f"WITH {B.MAT} SELECT label, feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, count(*) AS n FROM mat GROUP BY ALL"


def q_catalog_cost(spark, sf_dir):
    """The feature catalogue: every name, its family and whether it needs order."""
    return spark.createDataFrame(catalog(), "feature string, family string, needs_order boolean")


def catalog() -> list[tuple[str, str, bool]]:
    from netloom.operators import sequence as Q
    from netloom.operators import windows as W

    families = {"session": FF.session_info, "flow_stats": FF.flow_stats, "timing": FF.timing, "flags": FF.flag_counts, "structure": FF.structure, "directions": FF.directions, "sizes": FF.size_distribution, "cross": FF.crosses, "moments": FF.moments, "progress": Q.progress_features, "histograms": Q.histograms, "transitions": Q.transitions, "positions": Q.positions, "density": Q.density, "slots": W.slot_features, "window64": W.window64, "flow_window64": W.flow_window64}
    return [(name, family, any(w in e for w in ("iat", "prev_", "pos", "slot", "sofar"))) for family, build in families.items() for name, e in build().items()]


QUERIES["q_catalog_cost"] = q_catalog_cost


def q_nearest_neighbour(spark, sf_dir):
    """For every 20th vector, the closest other one by Euclidean distance: a stated query set against all rows, in blocks of them."""
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    asked = e.filter("vec_id % 20 = 0").select("vec_id", F.col("x").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("block"))
    rows = e.select(F.col("vec_id").alias("near_id"), F.col("label").alias("near_label"), "x", F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int").alias("block"))
    d2 = F.aggregate(F.zip_with("q", "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = asked.join(rows, "block").filter("vec_id <> near_id").select("vec_id", "near_id", "near_label", F.round(d2, 6).alias("d2"))
    best = near.groupBy("vec_id").agg(F.min(F.struct("d2", "near_id", "near_label")).alias("b"))
    return best.select("vec_id", "b.near_id", "b.near_label", "b.d2")


QUERIES["q_nearest_neighbour"] = q_nearest_neighbour
ORACLES["q_nearest_neighbour"] = "WITH d AS (SELECT a.vec_id, b.vec_id AS near_id, b.label AS near_label, round(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT vec_id, near_id, near_label, d2 FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, near_id) = 1"


def q_coral(spark, sf_dir):
    """Covariances of all features in two domains, as sums over rows: the input of an alignment, whose matrices are as small as features squared."""
    m = B.matrix(spark, sf_dir)
    parts = [L.products(m.filter(F.col("id") % 2 == d), "x").select(F.lit(d).alias("domain"), "a", "b", F.round("cov", 6).alias("cov")) for d in (0, 1)]
    return parts[0].unionAll(parts[1])


QUERIES["q_coral"] = q_coral
ORACLES["q_coral"] = f"WITH {B.MAT} SELECT p.id % 2 AS domain, p.feature AS a, q.feature AS b, round(covar_samp(p.x, q.x), 6) AS cov FROM mat p JOIN mat q ON p.id = q.id AND p.feature <= q.feature GROUP BY ALL"
