"""Queries for the policy, neighbours, forest, classifier and plug-in detectors."""

from pyspark.sql import Window, functions as F

from threatflow.catalog.registry import query, rounded
from threatflow.operators import forest, models, neighbours, plugins, policy, prep
from threatflow.plans import views

VOTES = "votes AS (SELECT alert_id, ts_us, location, attack_type NOT IN ('Anomaly', 'Port Scanning') OR alert_id % 4 = 0 AS is_tp FROM alerts)"
BLOCKS = """n AS (SELECT location, CAST(is_tp AS INT) AS tp, row_number() OVER (PARTITION BY location ORDER BY ts_us, alert_id) AS rn FROM votes),
b AS (SELECT location, (rn - 1) // 50 + 1 AS block, count(*) AS n, sum(tp) AS tp FROM n GROUP BY 1, 2),
c AS (SELECT location, block, n, sum(tp) OVER w / sum(n) OVER w AS good, (sum(n) OVER w - sum(tp) OVER w) / sum(n) OVER w AS bad FROM b WINDOW w AS (PARTITION BY location ORDER BY block)),
blocks AS (SELECT location, block, good AS attack_rate, bad AS fp_rate, CAST(least(4, floor(good * 5)) AS INT) AS attack_bin, CAST(least(4, floor(bad * 5)) AS INT) AS fp_bin, good - bad * bad AS reward FROM c WHERE n = 50)"""


def votes(spark, sf):
    a = views.alerts(spark, sf)
    vote = ~F.col("attack_type").isin("Anomaly", "Port Scanning") | (F.col("alert_id") % 4 == 0)
    return a.select("alert_id", "ts_us", "location", vote.alias("is_tp"))


@query(
    "policy_blocks",
    f"WITH {VOTES}, {BLOCKS} SELECT location, block, round(attack_rate, 6) AS attack_rate, round(fp_rate, 6) AS fp_rate, attack_bin, fp_bin, round(reward, 6) AS reward FROM blocks",
    over=["alerts"],
)
def policy_blocks(spark, sf):
    return rounded(policy.policy_blocks(votes(spark, sf), "location", ["ts_us", "alert_id"]))


RUN = f"""{BLOCKS},
v AS (SELECT *, row_number() OVER (PARTITION BY location, attack_bin, fp_bin ORDER BY block) AS visit FROM blocks),
q AS (SELECT location, attack_bin, fp_bin, visit, block, 1 AS a, 0.3 * reward AS q1, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS q3 FROM v WHERE visit = 1
  UNION ALL SELECT v.location, v.attack_bin, v.fp_bin, v.visit, v.block, CASE WHEN q1 >= q2 AND q1 >= q3 THEN 1 WHEN q2 >= q3 THEN 2 ELSE 3 END,
    CASE WHEN q1 >= q2 AND q1 >= q3 THEN q1 + 0.3 * (v.reward + 0.85 * q1 - q1) ELSE q1 END,
    CASE WHEN NOT (q1 >= q2 AND q1 >= q3) AND q2 >= q3 THEN q2 + 0.3 * (v.reward + 0.85 * q2 - q2) ELSE q2 END,
    CASE WHEN NOT (q1 >= q2 AND q1 >= q3) AND NOT q2 >= q3 THEN q3 + 0.3 * (v.reward + 0.85 * q3 - q3) ELSE q3 END
  FROM q JOIN v ON v.location = q.location AND v.attack_bin = q.attack_bin AND v.fp_bin = q.fp_bin AND v.visit = q.visit + 1),
t AS (SELECT location, block, CASE a WHEN 1 THEN least(0.99, 0.5 + 0.02) WHEN 3 THEN greatest(0.3, 0.5 - 0.02) ELSE 0.5 END::DOUBLE AS thr, a FROM q WHERE block = 1
  UNION ALL SELECT q.location, q.block, CASE q.a WHEN 1 THEN least(0.99, thr + 0.02) WHEN 3 THEN greatest(0.3, thr - 0.02) ELSE thr END::DOUBLE, q.a FROM t JOIN q ON q.location = t.location AND q.block = t.block + 1)"""
ACTION = "CASE a WHEN 1 THEN 'decrease_sensitivity' WHEN 2 THEN 'hold' ELSE 'increase_sensitivity' END"


@query("policy_run", f"WITH RECURSIVE {VOTES}, {RUN} SELECT location, block, {ACTION} AS action, round(thr, 6) AS new_threshold FROM t", over=["alerts"])
def policy_run(spark, sf):
    blocks = policy.policy_blocks(votes(spark, sf), "location", ["ts_us", "alert_id"])
    return rounded(policy.policy_run(blocks, "location").select("location", "block", "action", "new_threshold"))


PAIRS = "p AS (SELECT a.vec_id AS id, b.vec_id AS other, a.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)"


@query(
    "class_neighbours",
    f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), {PAIRS} SELECT id, CAST(rank AS INT) AS rank, other FROM p WHERE rank <= 5",
)
def class_neighbours(spark, sf):
    e = views.table(spark, sf, "embeddings")
    return neighbours.class_neighbours(e, "label", "vec_id", "embedding", pivots=8, block_rows=64).select("id", "rank", "other")


@query(
    "smote_rows",
    "WITH h AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT max(n) AS hi FROM h) SELECT label, hi - n AS made, true AS inside FROM h, m WHERE hi > n",
)
def smote_rows(spark, sf):
    made = neighbours.smote(views.table(spark, sf, "embeddings"), "label", "vec_id", "embedding", pivots=8, block_rows=64)
    rows = views.table(spark, sf, "embeddings")
    near = neighbours.class_neighbours(rows, "label", "vec_id", "embedding", pivots=8, block_rows=64).select(
        F.col("id").alias("base_id"), F.col("other").alias("other_id"), F.lit(True).alias("near")
    )
    # the other row is among the neighbours in the class, and the new one lies between the two
    made = made.join(near, ["base_id", "other_id"], "left")
    inside = (F.col("share") >= 0) & (F.col("share") < 1) & F.coalesce("near", F.lit(False))
    return made.groupBy("label").agg(F.count(F.lit(1)).alias("made"), F.bool_and(inside).alias("inside"))


FEATURES = ["quantity", "price", "discount", "tax"]


def as_labelled(f):
    """Flows with a label that the features tell, and the day."""
    y = (F.col("price") / F.col("quantity") + F.col("discount") * 3000 > 1600).cast("int")
    return f.select(F.col("flow_id").alias("row_id"), *FEATURES, y.alias("y"), F.substring("day", 1, 4).alias("_day"), "label")


def labelled(spark, sf):
    return as_labelled(views.flows(spark, sf))


#: The labelled rows in SQL.
ROWS = "l AS (SELECT flow_id, quantity, price, discount, tax, label, CAST(price / quantity + discount * 3000 > 1600 AS INT) AS y, substr(day, 1, 4) AS _day FROM flows)"
COUNTS = "count(*) AS n_rows, count(*) FILTER (y = 1) AS positives, 0 AS dropped_rows, true AS well_ranked, true AS accurate"


def checked(found, by):
    """Rows and positives per group and overall, and whether the figures are as good as this label allows."""
    return found.select(
        by,
        (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n_rows"),
        (F.col("tp") + F.col("fn")).alias("positives"),
        F.col("dropped_rows").cast("int").alias("dropped_rows"),
        (F.col("roc_auc") >= 0.98).alias("well_ranked"),
        (F.col("accuracy") >= 0.95).alias("accurate"),
    )


@query(
    "classifier_evaluation",
    f"""WITH {ROWS}, d AS (SELECT DISTINCT _day FROM l), k AS (SELECT _day, row_number() OVER (ORDER BY _day DESC) AS back, count(*) OVER () AS n FROM d),
    t AS (SELECT l.* FROM l JOIN k USING (_day) WHERE back <= greatest(1, floor(n * 0.2)))
    SELECT _day, {COUNTS} FROM t GROUP BY _day UNION ALL SELECT NULL, {COUNTS} FROM t""",
    over=["flows"],
)
def classifier_evaluation(spark, sf):
    rows = labelled(spark, sf)
    parts = prep.split_by_group(rows, "_day")
    model = models.train_classifier(parts.where(~F.col("is_test")), FEATURES, raise_rare=True)
    return checked(models.evaluate_days(model, parts.where("is_test"), FEATURES), "_day")


@query(
    "classifier_alerts",
    f"WITH {ROWS} SELECT 'XGBoost Detection' AS attacks, count(*) AS n_rows, count(*) FILTER (y = 1) AS positives, true AS about_as_many, true AS right, true AS confident FROM l",
    over=["flows"],
)
def classifier_alerts(spark, sf):
    """Alerts of a trained model on all flows: as many as there are attacks, nearly all of them attacks, none below the threshold."""
    rows = labelled(spark, sf)
    model = models.train_classifier(rows, FEATURES, scaler=prep.fit_scaler(rows, FEATURES))
    scored = models.score(model, rows, FEATURES).withColumn("packet_id", F.struct("row_id", "y"))
    found = models.classifier_alerts(scored, models.runtime_threshold(0.2))
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y") == 1).alias("positives"))
    told = found.groupBy(F.array_join("attack_types", ",").alias("attacks")).agg(
        F.count(F.lit(1)).alias("_alerts"), F.avg(F.col("packet_id.y")).alias("_right"), F.min("confidence").alias("_least")
    )
    return told.select(
        "attacks", n.select("n_rows").scalar().alias("n_rows"), n.select("positives").scalar().alias("positives"),
        (F.abs(F.col("_alerts") - n.select("positives").scalar()) <= n.select("n_rows").scalar() * 0.02).alias("about_as_many"),
        (F.col("_right") >= 0.98).alias("right"), (F.col("_least") >= 0.5).alias("confident"),
    )


@query(
    "multiclass_evaluation",
    f"""WITH {ROWS}, g AS (SELECT CASE WHEN y = 1 THEN 'steep' WHEN discount > 0.05 THEN 'cut' ELSE 'plain' END AS name FROM l)
    SELECT name, count(*) AS support, true AS found FROM g GROUP BY 1
    UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), count(*), true FROM g""",
    over=["flows"],
)
def multiclass_evaluation(spark, sf):
    from threatflow.operators import evaluate

    kind = F.when(F.col("y") == 1, "steep").when(F.col("discount") > 0.05, "cut").otherwise("plain")
    rows = labelled(spark, sf).withColumn("kind", kind)
    model = models.train_classifier(rows, FEATURES, "kind", multiclass=True)
    report = evaluate.classification_report(models.predict_classes(model, rows, FEATURES), "kind", "predicted")
    return report.select("name", "support", (F.col("f1") >= 0.95).alias("found"))


@query(
    "generalisation_suite",
    f"WITH {ROWS}, t AS (SELECT *, _day AS dataset FROM l WHERE _day >= '1998') SELECT dataset, {COUNTS} FROM t GROUP BY 1 UNION ALL SELECT NULL, {COUNTS} FROM t",
    over=["flows"],
)
def generalisation_suite(spark, sf):
    rows = labelled(spark, sf)
    model = models.train_classifier(rows.where("_day < '1998'"), FEATURES)
    later = rows.where("_day >= '1998'").withColumnRenamed("_day", "dataset")
    return checked(models.generalisation(model, later, FEATURES), "dataset")


@query(
    "tuning_leaderboard",
    "SELECT CAST(unnest(range(1, 51)) AS INT) AS place, 'roc_auc' AS score_metric, true AS in_order, true AS well_ranked, true AS within_trees, CAST(9 AS INT) AS dimensions",
)
def tuning_leaderboard(spark, sf):
    """All trials of the whole space: place by place, with what can be said of each without training."""
    parts = prep.split_random(labelled(spark, sf), "y", "row_id")
    train = parts.where(~F.col("is_test")).withColumn("watch", F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0)
    board = models.random_search(train, parts.where("is_test"), FEATURES, early_stop="watch")
    asked = F.from_json("params", "map<string, double>")
    place = Window.orderBy(F.desc("score"), "trial")  # one row per trial
    return board.select(
        F.row_number().over(place).alias("place"), "score_metric",
        F.coalesce(F.col("score") <= F.lag("score").over(place), F.lit(True)).alias("in_order"),
        (F.col("score") >= 0.98).alias("well_ranked"),
        (F.col("trees") <= asked["n_estimators"]).alias("within_trees"),
        F.size(asked).alias("dimensions"),
    )


@query(
    "feedback_retraining",
    f"""WITH {ROWS}, c AS (SELECT y, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS take FROM l GROUP BY 1),
    d AS (SELECT count(*) AS recent FROM alerts WHERE attack_type = 'Anomaly' AND ts_us >= (SELECT max(ts_us) - 86400000000 FROM alerts))
    SELECT CAST(sum(take) AS BIGINT) AS n_rows, CAST(sum(take) FILTER (y = 1) AS BIGINT) AS positives, true AS accurate FROM c, d WHERE recent > 0 HAVING count(*) > 0""",
    over=["flows", "alerts"],
)
def feedback_retraining(spark, sf):
    """Figures of the model retrained with feedback; no row where no drift alert asks for one."""
    from threatflow.catalog.evaluate import feedback

    a = views.alerts(spark, sf)
    now = a.agg(F.max("ts_us").alias("t")).first()["t"]
    drift = a.where("attack_type = 'Anomaly'").select("ts_us", F.array(F.lit("Drift")).alias("attack_types"))
    if now is None or not models.should_retrain(drift, now):
        return spark.createDataFrame([], "n_rows bigint, positives bigint, accurate boolean")
    snaps = a.select("alert_id", "ts_us", F.create_map(F.lit("quantity"), F.col("value"), F.lit("tax"), F.col("confidence")).alias("features"))
    _, figures = models.retrain(labelled(spark, sf), feedback(spark, sf), snaps, FEATURES)
    return figures.select(
        (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n_rows"), (F.col("tp") + F.col("fn")).alias("positives"),
        (F.col("accuracy") >= 0.9).alias("accurate"),
    )


@query(
    "forest_anomalies",
    "SELECT event_type, count(*) AS n_rows, true AS few_of_the_normal, true AS confident, true AS below_offset FROM packets GROUP BY 1",
    over=["packets"],
)
def forest_anomalies(spark, sf):
    """Anomalies by kind of event, from a forest of normal rows: the offset leaves a hundredth of these below it."""
    cols = ["size", "payload_len", "value", "src_port"]
    p = views.packets(spark, sf).select("packet_id", "event_type", *[F.col(c).cast("double") for c in cols])
    normal = p.where("event_type = 'view'")
    nodes = forest.fit_forest(normal, cols, "packet_id").cache()
    offset = forest.forest_threshold(normal, cols, nodes)
    found = forest.anomalies(p, cols, nodes, offset)
    odd = F.col("is_anomaly")
    return found.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.first("event_type") != "view") | (F.count_if(odd) <= F.floor((F.count(F.lit(1)) - 1) * 0.01) + 1)).alias("few_of_the_normal"),
        F.bool_and(F.when(odd, F.col("confidence").between(0.5, 0.99)).otherwise(F.col("confidence") == 0.8)).alias("confident"),
        F.bool_and(odd == (F.col("raw_score") < F.lit(float(offset)))).alias("below_offset"),
    )


@query(
    "hashed_neighbours",
    "SELECT label, count(*) AS n_rows, true AS own_class, true AS found_most FROM embeddings WHERE label IS NOT NULL GROUP BY 1",
)
def hashed_neighbours(spark, sf):
    """Neighbours of every row by hashed buckets, by class, and whether nine in ten of the true ones are among them.

    The true ones are those of every twentieth row, compared with all rows of its class.
    """
    e = views.table(spark, sf, "embeddings").where("label is not null")
    near = neighbours.hashed_neighbours(e, "label", "vec_id", "embedding", tables=24, bits=3)
    label = e.select("label", "vec_id")
    counts = e.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    ranked = neighbours.true_neighbours(e.where("vec_id % 20 = 0"), e, "label", "vec_id", "embedding")
    hit = ranked.join(near.select("id", "other", F.lit(1).alias("_hit")), ["id", "other"], "left")
    recall = hit.agg((F.avg(F.coalesce("_hit", F.lit(0))) >= 0.9).alias("found_most")).scalar()
    own = near.join(label.withColumnsRenamed({"vec_id": "id", "label": "_mine"}), "id").join(
        label.withColumnsRenamed({"vec_id": "other", "label": "_theirs"}), "other"
    )
    own = own.groupBy(F.col("_mine").alias("label")).agg(F.bool_and(F.col("_mine") == F.col("_theirs")).alias("own_class"))
    return counts.join(own, "label", "left").select(
        "label", "n_rows", F.coalesce("own_class", F.lit(True)).alias("own_class"), F.coalesce(recall, F.lit(True)).alias("found_most")
    )


@query(
    "plugin_detectors",
    "SELECT packet_id, 0 AS ord, 'big' AS detector FROM packets WHERE size > 200 UNION ALL SELECT packet_id, 1, 'reset' FROM packets WHERE flags = 'R' AND size > 100",
    over=["packets"],
)
def plugin_detectors(spark, sf):
    def reset(packet):
        if packet["flags"] == "R" and packet["size"] > 100:
            return {"packet_id": packet["packet_id"], "detector": "reset"}
        return None

    detectors = plugins.Detectors()
    detectors.add("rule", lambda p: p.where("size > 200").select("packet_id", F.lit("big").alias("detector")))
    detectors.add("dos", plugins.row_detector(reset, "packet_id bigint, detector string"))
    return detectors.run(views.packets(spark, sf)).select("packet_id", "ord", "detector")
