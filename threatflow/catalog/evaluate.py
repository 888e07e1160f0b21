"""Queries for labels, features, balance, split, scaling and model evaluation."""

from pyspark.sql import functions as F

from threatflow.catalog.fields import _rows_sql, listed
from threatflow.catalog.registry import query, rounded
from threatflow.functions import values as V
from threatflow.operators import evaluate, models, prep
from threatflow.plans import ordered, views

FEATURES = ["quantity", "price", "discount", "tax"]


@query(
    "label_classes",
    f"WITH d(raw, cls) AS (VALUES {_rows_sql(list(V.LABEL_CLASSES.items()))}) SELECT flow_id, coalesce(cls, label) AS label FROM "
    "(SELECT flow_id, CASE WHEN flow_id % 50 = 0 THEN 'Odd' ELSE label END AS label FROM flows) LEFT JOIN d ON raw = label",
    over=["flows"],
)
def label_classes(spark, sf):
    f = views.flows(spark, sf).select("flow_id", F.when(F.col("flow_id") % 50 == 0, "Odd").otherwise(F.col("label")).alias("label"))
    return prep.relabel(f, "label")


@query(
    "binary_labels",
    """SELECT flow_id, CASE flow_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE CAST(trim(l) <> 'Normal' AS INT) END AS y, CAST(lower(trim(label)) <> 'benign' AS INT) AS attack
    FROM (SELECT flow_id, label, CASE label WHEN 'Benign' THEN ' Normal ' ELSE label END AS l FROM flows)""",
    over=["flows"],
)
def binary_labels(spark, sf):
    f = views.flows(spark, sf)
    text = F.expr("CASE flow_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE CASE label WHEN 'Benign' THEN ' Normal ' ELSE label END END")
    return f.withColumn("t", text).select("flow_id", prep.binary_label("t").alias("y"), prep.is_attack("label").alias("attack"))


def cic_table(spark, sf):
    """Flow table under its CSV headers, with one preferred column missing."""
    f = views.flows(spark, sf)
    return f.select(
        "flow_id",
        F.col("quantity").alias("Dst Port"), F.col("price").alias("TotLen Fwd Pkts"), F.col("discount").alias("Flow Byts/s"),
        F.col("tax").alias("Fwd Pkts/s"), F.col("quantity").alias("Tot Fwd Pkts"), F.col("tax").alias("Pkt Len Std"), F.col("label").alias("Label"),
    )


@query(
    "select_features",
    "SELECT flow_id, quantity AS \"Dst Port\", price AS \"TotLen Fwd Pkts\", discount AS \"Flow Byts/s\", tax AS \"Fwd Pkts/s\", quantity AS \"Tot Fwd Pkts\", label AS \"Label\" FROM flows",
    over=["flows"],
)
def select_features(spark, sf):
    return prep.select_features(cic_table(spark, sf), count=5, keep=("flow_id", "Label"))[0]


ODD = "CASE WHEN flow_id % 7 = 0 THEN 'Infinity' WHEN flow_id % 11 = 0 THEN 'n/a' ELSE CAST(quantity AS {STR}) END"


@query(
    "align_features",
    "SELECT flow_id, CASE WHEN flow_id % 7 = 0 OR flow_id % 11 = 0 THEN 0.0 ELSE quantity END AS quantity, price, discount, tax, 0.0::DOUBLE AS absent FROM flows",
    over=["flows"],
)
def align_features(spark, sf):
    f = views.flows(spark, sf).withColumn("quantity", F.expr(ODD.replace("{STR}", "STRING")))
    return prep.align_features(f, [*FEATURES, "absent"], keep=["flow_id"])


@query(
    "finite_rows",
    "SELECT day, count(*) FILTER (flow_id % 7 <> 0 AND flow_id % 11 <> 0) AS kept, count(*) FILTER (flow_id % 7 = 0 OR flow_id % 11 = 0) AS dropped FROM flows GROUP BY 1",
    over=["flows"],
)
def finite_rows(spark, sf):
    f = views.flows(spark, sf).withColumn("quantity", F.expr(ODD.replace("{STR}", "STRING")))
    rows = prep.finite_rows(prep.align_features(f, FEATURES, keep=["day"], fill=None), FEATURES)
    return rows.groupBy("day").agg(F.count_if("valid").alias("kept"), F.count_if(~F.col("valid")).alias("dropped"))


@query("constant_features", "SELECT flow_id, quantity, price, discount, tax FROM flows", over=["flows"])
def constant_features(spark, sf):
    f = views.flows(spark, sf).select("flow_id", *FEATURES, F.lit(3.0).alias("same"))
    return f.drop(*prep.constant_features(f, [*FEATURES, "same"]))


@query(
    "balance_plan",
    "SELECT label, count(*) AS have, least(greatest(count(*), 16000), 20000) AS want FROM flows GROUP BY 1",
    over=["flows"],
)
def balance_plan(spark, sf):
    return prep.balance_plan(views.flows(spark, sf), "label", least=16_000, most=20_000)


@query(
    "balanced_classes",
    """WITH h AS (SELECT label, count(*) AS n FROM flows GROUP BY 1), m AS (SELECT max(n) AS hi, min(n) AS lo FROM h),
    t AS (SELECT 'hybrid' AS method, label, n, least(greatest(n, 16000), 20000) AS want FROM h UNION ALL
      SELECT 'undersample', label, n, least(n, greatest(lo, 10000)) FROM h, m UNION ALL SELECT 'oversample', label, n, hi FROM h, m)
    SELECT method, label, want AS n, least(n, want) AS n_distinct FROM t""",
    over=["flows"],
)
def balanced_classes(spark, sf):
    f = views.flows(spark, sf).select("flow_id", "label")
    out = None
    for method, least, most in (("hybrid", 16_000, 20_000), ("undersample", 10_000, 0), ("oversample", 0, 0)):
        b = prep.balance(f, "label", "flow_id", method, least, most)
        b = b.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copy") == 1).alias("n_distinct"))
        b = b.select(F.lit(method).alias("method"), "label", "n", "n_distinct")
        out = b if out is None else out.unionByName(b)
    return out


@query(
    "split_random",
    "SELECT label, is_test, CASE WHEN is_test THEN t ELSE n - t END AS n FROM (SELECT label, count(*) AS n, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS t FROM flows GROUP BY 1), (VALUES (true), (false)) v(is_test)",
    over=["flows"],
)
def split_random(spark, sf):
    s = prep.split_random(views.flows(spark, sf).select("flow_id", "label"), "label", "flow_id")
    return s.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


def _group_split_sql(col):
    return (
        f"WITH g AS (SELECT {col} AS k, row_number() OVER (ORDER BY {col}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT {col} FROM flows)) "
        f"SELECT flow_id, rn > n - greatest(1, floor(n * 0.2)) AS is_test FROM flows JOIN g ON g.k = flows.{col}"
    )


@query("split_by_day", _group_split_sql("day"), over=["flows"])
def split_by_day(spark, sf):
    return prep.split_by_group(views.flows(spark, sf).select("flow_id", "day"), "day").select("flow_id", "is_test")


@query("split_by_source", _group_split_sql("src"), over=["flows"])
def split_by_source(spark, sf):
    return prep.split_by_group(views.flows(spark, sf).select("flow_id", "src"), "src").select("flow_id", "is_test")


@query(
    "split_by_time",
    "SELECT alert_id, row_number() OVER (ORDER BY ts_us, alert_id) > floor(count(*) OVER () * 0.8) AS is_test FROM alerts",
    over=["alerts"],
)
def split_by_time(spark, sf):
    return prep.split_by_time(views.alerts(spark, sf).select("alert_id", "ts_us"), "ts_us", "alert_id").select("alert_id", "is_test")


def scale_sql(kind):
    c, w = {
        "standard": ("avg({f})", "stddev_pop({f})"),
        "minmax": ("min({f})", "max({f}) - min({f})"),
        "robust": ("quantile_cont({f}, 0.5)", "quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)"),
    }[kind]
    stats = ", ".join(f"{c.format(f=f)} AS c_{f}, {w.format(f=f)} AS w_{f}" for f in FEATURES)
    cols = ", ".join(f"round(({f} - c_{f}) / CASE WHEN w_{f} = 0 THEN 1 ELSE w_{f} END, 6) AS {f}" for f in FEATURES)
    return f"WITH s AS (SELECT {stats} FROM flows WHERE day < '1997-01-01') SELECT flow_id, {cols} FROM flows, s"


def scaled(spark, sf, kind):
    f = views.flows(spark, sf)
    stats = prep.fit_scaler(f.where("day < '1997-01-01'"), FEATURES, kind)
    return rounded(prep.scale(f.select("flow_id", *FEATURES), FEATURES, stats))


@query("scale_standard", scale_sql("standard"), over=["flows"])
def scale_standard(spark, sf):
    return scaled(spark, sf, "standard")


@query("scale_minmax", scale_sql("minmax"), over=["flows"])
def scale_minmax(spark, sf):
    return scaled(spark, sf, "minmax")


@query("scale_robust", scale_sql("robust"), over=["flows"])
def scale_robust(spark, sf):
    return scaled(spark, sf, "robust")


FEEDBACK = "fb AS (SELECT CASE WHEN alert_id % 13 = 0 THEN NULL WHEN alert_id % 17 = 0 THEN -alert_id ELSE alert_id END AS alert_id, CASE alert_id % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'attack' ELSE '' END AS label, CASE WHEN alert_id % 4 = 0 THEN NULL ELSE (alert_id % 4) * 1.0E0 END AS weight FROM alerts WHERE confidence >= 0.3)"


def feedback(spark, sf):
    a = views.alerts(spark, sf).where("confidence >= 0.3")
    return a.selectExpr(
        "CASE WHEN alert_id % 13 = 0 THEN NULL WHEN alert_id % 17 = 0 THEN -alert_id ELSE alert_id END AS alert_id",
        "CASE alert_id % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'attack' ELSE '' END AS label",
        "CASE WHEN alert_id % 4 = 0 THEN NULL ELSE (alert_id % 4) * 1.0D END AS weight",
    )


def snapshots(spark, sf):
    empty = "CAST(map() AS MAP<STRING, DOUBLE>)"
    return views.alerts(spark, sf).selectExpr(
        "alert_id", "ts_us", f"IF(event_type = 'view', {empty}, map('value', value, 'confidence', CAST(confidence AS DOUBLE))) AS features"
    )


@query(
    "feedback_samples",
    f"WITH {FEEDBACK} SELECT alert_id, CASE WHEN label = '' THEN 'unknown' ELSE label END AS label, coalesce(weight, 5.0) AS weight, value FROM fb JOIN (SELECT alert_id, event_type, value FROM alerts) USING (alert_id) WHERE event_type <> 'view'",
    over=["alerts"],
)
def feedback_samples(spark, sf):
    return prep.feedback_samples(feedback(spark, sf), snapshots(spark, sf)).select("alert_id", "label", "weight", F.col("features")["value"].alias("value"))


@query(
    "weighted_training",
    f"""WITH {FEEDBACK}, s AS (SELECT CASE WHEN label = 'benign' THEN 0 ELSE 1 END AS y, coalesce(weight, 5.0) AS weight, value, confidence FROM fb JOIN (SELECT alert_id, event_type, value, confidence FROM alerts) USING (alert_id) WHERE event_type <> 'view'),
    u AS (SELECT y, weight, value, confidence FROM s UNION ALL SELECT CAST(event_type = 'error' AS INT), 1.0, value, confidence FROM alerts)
    SELECT y, CAST(weight AS DOUBLE) AS weight, count(*) AS n, round(sum(value), 6) AS total FROM u GROUP BY 1, 2""",
    over=["alerts"],
)
def weighted_training(spark, sf):
    base = views.alerts(spark, sf).select("value", "confidence", (F.col("event_type") == "error").cast("int").alias("label"))
    out = prep.weighted_training(base, prep.feedback_samples(feedback(spark, sf), snapshots(spark, sf)), ["value", "confidence"])
    return rounded(out.groupBy("y", "weight").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query(
    "verdict_override",
    """WITH v AS (SELECT alert_id, CASE WHEN alert_id % 2 = 0 THEN 'true_positive' ELSE 'false_positive' END AS verdict FROM alerts WHERE value > 40)
    SELECT alert_id, coalesce(verdict = 'true_positive', confidence >= 0.5) AS is_tp, coalesce((verdict = 'true_positive') <> (confidence >= 0.5), false) AS corrected FROM alerts LEFT JOIN v USING (alert_id)""",
    over=["alerts"],
)
def verdict_override(spark, sf):
    a = views.alerts(spark, sf).select("alert_id", "ts_us", "value", (F.col("confidence") >= 0.5).alias("is_tp"))
    v = a.where("value > 40").select("alert_id", "ts_us", F.expr("IF(alert_id % 2 = 0, 'true_positive', 'false_positive')").alias("verdict"))
    return prep.override_votes(a, v).select("alert_id", "is_tp", "corrected")


# --------------------------------------------------------------- evaluation

COUNTS = "count(*) FILTER (y = 1 AND q = 1) AS tp, count(*) FILTER (y = 0 AND q = 0) AS tn, count(*) FILTER (y = 0 AND q = 1) AS fp, count(*) FILTER (y = 1 AND q = 0) AS fn"
METRICS = (
    "round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, "
    "round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
)


@query(
    "confusion_by_file",
    f"WITH s AS (SELECT *, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST(p >= 0.5 AS INT) END AS q FROM scored), c AS (SELECT grp, {COUNTS}, count(*) FILTER (q IS NULL) AS dropped_rows FROM s GROUP BY ROLLUP (grp)) SELECT *, {METRICS} FROM c",
    over=["scored"],
)
def confusion_by_file(spark, sf):
    s = views.scored(spark, sf).withColumn("q", F.when(F.col("doc_id") % 19 != 0, (F.col("p") >= 0.5).cast("int")))
    return rounded(evaluate.confusion(s, "y", "q", ["grp"]))


@query(
    "metrics_at_threshold",
    f"WITH s AS (SELECT y, CAST(p >= 0.3 AS INT) AS q FROM scored), c AS (SELECT {COUNTS} FROM s) SELECT *, {METRICS} FROM c",
    over=["scored"],
)
def metrics_at_threshold(spark, sf):
    return rounded(evaluate.at_threshold(views.scored(spark, sf), "y", "p", 0.3))


@query(
    "classification_report",
    """WITH s AS (SELECT label AS l, CASE WHEN quantity < 10 THEN 'Botnet' WHEN quantity < 30 THEN 'DoS-Hulk' ELSE 'Benign' END AS p FROM flows),
    n AS (SELECT DISTINCT l AS name FROM s UNION SELECT p FROM s),
    c AS (SELECT name, (SELECT count(*) FROM s WHERE l = name) AS support, (SELECT count(*) FROM s WHERE p = name) AS predicted, (SELECT count(*) FROM s WHERE l = name AND p = name) AS hits FROM n),
    m AS (SELECT name, support, hits, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1 FROM c),
    a AS (SELECT name, precision, recall, f1, support FROM m UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m
      UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM m)
    SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a""",
    over=["flows"],
)
def classification_report(spark, sf):
    p = F.when(F.col("quantity") < 10, "Botnet").when(F.col("quantity") < 30, "DoS-Hulk").otherwise("Benign")
    return rounded(evaluate.classification_report(views.flows(spark, sf).withColumn("p", p), "label", "p"))


STEPS = """d AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM d)"""


@query(
    "ranking_scores",
    f"WITH {STEPS} SELECT CAST(max(np) AS BIGINT) AS positives, CAST(max(nn) AS BIGINT) AS negatives, round(sum(neg / nn * (tp - pos / 2) / np), 6) AS roc_auc, round(sum(pos / np * tp / (tp + fp)), 6) AS pr_auc FROM c",
    over=["scored"],
)
def ranking_scores(spark, sf):
    return rounded(evaluate.ranking(views.scored(spark, sf), "y", "p"))


@query(
    "tuned_thresholds",
    f"""WITH {STEPS}, f AS (SELECT *, 2 * (tp / (tp + fp)) * (tp / np) / (tp / (tp + fp) + tp / np + 1e-12) AS f1, tp / np AS tpr, fp / nn AS fpr FROM c)
    SELECT round((SELECT max(f1) FROM f), 6) AS best_f1, (SELECT p FROM f ORDER BY f1 DESC, p LIMIT 1) AS best_f1_threshold,
      round((SELECT tpr FROM f WHERE fpr <= 0.1 ORDER BY tpr DESC, p DESC LIMIT 1), 6) AS recall_at_fpr_target, (SELECT p FROM f WHERE fpr <= 0.1 ORDER BY tpr DESC, p DESC LIMIT 1) AS threshold_at_fpr_target""",
    over=["scored"],
)
def tuned_thresholds(spark, sf):
    out = evaluate.tune_threshold(views.scored(spark, sf), "y", "p", 0.1)
    keep = ["best_f1_threshold", "threshold_at_fpr_target"]
    return rounded(out.select("best_f1", "recall_at_fpr_target", *[F.col(k).cast("string").alias(k) for k in keep])).select(
        "best_f1", "recall_at_fpr_target", *[F.col(k).cast("double").alias(k) for k in keep]
    )


@query("score_threshold", "SELECT count(*) AS n, round(quantile_cont(value, 0.01), 6) AS threshold FROM alerts", over=["alerts"])
def score_threshold(spark, sf):
    return rounded(evaluate.score_threshold(views.alerts(spark, sf), "value"))


@query(
    "feature_quantiles",
    "SELECT label, count(*) AS n, round(quantile_cont(price, 0.25), 6) AS q0, round(quantile_cont(price, 0.5), 6) AS q1, round(quantile_cont(price, 0.99), 6) AS q2 FROM flows GROUP BY 1",
    over=["flows"],
)
def feature_quantiles(spark, sf):
    return rounded(ordered.quantiles(views.flows(spark, sf), ["label"], "price", [0.25, 0.5, 0.99]))


@query(
    "shadow_comparison",
    """WITH r AS (SELECT alert_id, row_number() OVER (ORDER BY ts_us, alert_id) AS rn, confidence >= 0.5 AS a, confidence >= 0.6 AS s, value > 45 AS y FROM alerts WHERE event_type = 'click')
    SELECT count(*) AS n, round(avg(CAST(a = y AS INT)), 6) AS active_accuracy, round(avg(CAST(s = y AS INT)), 6) AS shadow_accuracy,
      CASE WHEN avg(CAST(s = y AS INT)) >= avg(CAST(a = y AS INT)) THEN 'swap' ELSE 'keep' END AS decision FROM r WHERE rn <= 100""",
    over=["alerts"],
)
def shadow_comparison(spark, sf):
    a = views.alerts(spark, sf)
    truth = F.col("value") > 45
    active = a.select("alert_id", "ts_us", ((F.col("confidence") >= 0.5) == truth).alias("correct"))
    shadow = a.where("event_type = 'click'").select("alert_id", ((F.col("confidence") >= 0.6) == truth).alias("correct"))
    return rounded(models.shadow_comparison(active, shadow, "alert_id"))


@query(
    "promotion_decision",
    """WITH g AS (SELECT grp, y, p FROM scored UNION ALL SELECT NULL, y, p FROM scored),
    s AS (SELECT grp, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM g GROUP BY 1, 2),
    t AS (SELECT *, sum(pos) OVER (PARTITION BY grp ORDER BY p DESC) AS tp FROM s),
    a AS (SELECT grp, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc, 2 * sum(pos) FILTER (p >= 0.5) / (sum(pos + neg) FILTER (p >= 0.5) + sum(pos)) AS f1 FROM t GROUP BY 1)
    SELECT m.grp, CASE WHEN m.f1 >= o.f1 OR (m.auc >= o.auc AND m.f1 >= 0.95 * o.f1) THEN 'swap' ELSE 'keep' END AS decision
    FROM a m, a o WHERE o.grp IS NULL AND m.grp IS NOT NULL""",
    over=["scored"],
)
def promotion_decision(spark, sf):
    """Each group's scores as a new model's, against those of all groups as the model's in use."""
    rows = views.scored(spark, sf).withColumn("hit", (F.col("p") >= 0.5).cast("int"))
    marks = evaluate.confusion(rows, "y", "hit", ["grp"]).select("grp", "f1")
    ranks = evaluate.ranking(rows, "y", "p", by=["grp"]).select("grp", "roc_auc")
    old = marks.where("grp is null").withColumn("roc_auc", evaluate.ranking(rows, "y", "p").select("roc_auc").scalar())
    return models.promotion(marks.join(ranks, "grp"), old).select("grp", "decision")
