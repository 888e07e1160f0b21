"""Preparation of labelled flow tables: labels, features, balance, split, scale."""

from pyspark.sql import DataFrame, functions as F

from threatflow.functions import values as V
from threatflow.plans import ordered
from threatflow.plans.sizes import broadcast_if_small


# ------------------------------------------------------------------- labels


def relabel(df: DataFrame, label="Label"):
    classes = F.create_map(*[F.lit(x) for kv in V.LABEL_CLASSES.items() for x in kv])
    return df.withColumn(label, F.coalesce(F.try_element_at(classes, F.col(label)), F.col(label)))


def binary_label(label, normal="Normal"):
    """0 for the normal class, 1 for any other; labels that are 0 or 1 stay."""
    text = F.trim(F.col(label).cast("string"))
    return F.when(text.isin("0", "1"), text.cast("int")).otherwise((text != normal).cast("int"))


def is_attack(label):
    """1 unless the label says benign in any spelling."""
    return (F.lower(F.trim(F.col(label).cast("string"))) != "benign").cast("int")


# ----------------------------------------------------------------- features


def select_features(df: DataFrame, count=17, keep=("Label",)):
    """The preferred columns that exist, filled up from the backups to ``count``."""
    have = set(df.columns)
    chosen = [c for c in V.PACKET_FEATURES if c in have]
    chosen += [c for c in V.BACKUP_FEATURES if c in have and c not in chosen][: max(0, count - len(chosen))]
    chosen = chosen[:count]
    return df.select(*[F.col(f"`{c}`") for c in chosen], *[k for k in keep if k in have]), chosen


def align_features(df: DataFrame, features, keep=(), max_missing=0.2, fill=0.0):
    """Features as doubles in model order; absent columns are 0, bad values ``fill``.

    Fails if too many columns are absent.  With ``fill=None`` bad values stay NULL.
    """
    missing = [f for f in features if f not in df.columns]
    if len(missing) / max(len(features), 1) > max_missing:
        raise ValueError(f"{len(missing)} of {len(features)} features are missing: {missing}")

    def clean(name):
        if name in missing:
            return F.lit(0.0).alias(name)
        x = F.col(f"`{name}`").cast("string").try_cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        return (x if fill is None else F.coalesce(x, F.lit(fill))).alias(name)

    return df.select(*keep, *[clean(f) for f in features])


def finite_rows(df: DataFrame, features):
    """Mark rows of which every feature is a number."""
    good = F.lit(True)
    for f in features:
        good = good & F.col(f"`{f}`").isNotNull()
    return df.withColumn("valid", good)


def constant_features(df: DataFrame, features, below=1e-8):
    """Names of the features with hardly any variance."""
    row = df.agg(*[F.var_samp(F.col(f"`{f}`")).alias(f) for f in features]).first()
    return [f for f in features if row[f] is not None and row[f] < below]


# ------------------------------------------------------------------ balance


def balance_plan(df: DataFrame, label, method="hybrid", least=10_000, most=100_000):
    """Rows to have per class: clamped, cut to the smallest, or raised to the largest."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("have"))
    if method == "hybrid":
        want = F.least(F.greatest(F.col("have"), F.lit(least)), F.lit(most))
    elif method == "undersample":
        want = F.least(F.col("have"), F.greatest(counts.agg(F.min("have")).scalar(), F.lit(least)))
    elif method in ("oversample", "smote"):
        want = counts.agg(F.max("have")).scalar()
    else:
        raise ValueError(f"unknown balance method {method!r}")
    return counts.withColumn("want", want)


def balance(df: DataFrame, label, row_id, method="hybrid", least=10_000, most=100_000, seed=42, chunk_rows=ordered.CHUNK_ROWS):
    """Exactly the planned rows per class: too many are thinned, too few repeated.

    Rows are drawn in the order of a hash of their id. All rows of a class come equally often, but for the first
    ones, which come once more, so only these have to be told from the rest.
    """
    plan = balance_plan(df, label, method, least, most).withColumn("_take", F.col("want") % F.col("have"))
    rows = df.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed)))
    rows = ordered.mark_first(rows, [label], "_h", row_id, plan.select(label, "_take"), "_more", chunk_rows)
    rows = rows.join(broadcast_if_small(plan), label)
    copies = F.floor(F.col("want") / F.col("have")) + F.col("_more").cast("long")
    rows = rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))))
    return rows.select(*df.columns, "copy")


# -------------------------------------------------------------------- split


def split_random(df: DataFrame, label, row_id, test_size=0.2, seed=42, chunk_rows=ordered.CHUNK_ROWS):
    """Add ``is_test``: the same share of each class, exact to the row."""
    rows = df.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed)))
    counts = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) * test_size + 0.5).alias("_take"))
    return ordered.mark_first(rows, [label], "_h", row_id, counts, "is_test", chunk_rows).select(*df.columns, "is_test")


def split_by_group(df: DataFrame, group, test_size=0.2, chunk_rows=ordered.CHUNK_ROWS):
    """Add ``is_test``: the last share of the sorted distinct groups is held out.

    Only the first held-out group is looked up; a comparison then splits the rows
    without a join, whatever the size of a group.
    """
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    if dict(df.dtypes)[group] == "string":
        place = F.conv(F.hex(F.rpad(F.substring(F.encode(group, "UTF-8"), 1, 7), 7, F.lit(b"\x00"))), 16, 10).cast("decimal(20,0)")
    else:
        place = F.col(group)
    rows = groups.withColumn("_at", place.cast("double")).withColumn("_k", F.lit(0))
    rows = ordered.number_rows(rows, ["_k"], ["_at", group], "_rn", chunk_rows)
    total = groups.agg(F.count(F.lit(1))).scalar()
    held = F.greatest(F.lit(1), F.floor(total * test_size))
    first = rows.where(F.col("_rn") > total - held).agg(F.min(group)).scalar()
    return df.withColumn("is_test", F.coalesce(F.col(group) >= first, F.lit(False)))


def split_by_time(df: DataFrame, at, row_id, test_size=0.2, chunk_rows=ordered.CHUNK_ROWS):
    """Add ``is_test``: the last share of the rows in time order."""
    rows = ordered.number_rows(df.withColumn("_k", F.lit(0)), ["_k"], [at, row_id], "_rn", chunk_rows)
    total = df.agg(F.count(F.lit(1))).scalar()
    return rows.withColumn("is_test", F.col("_rn") > F.floor(total * (1 - test_size))).drop("_k", "_rn")


# -------------------------------------------------------------------- scale


def fit_scaler(train: DataFrame, features, kind="standard", chunk_rows=ordered.CHUNK_ROWS):
    """Centre and width per feature, as one small row per feature; no width counts as 1."""
    if kind == "robust":
        long = train.select(F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("v")) for f in features
        ])).alias("x")).select("x.*")
        q = ordered.quantiles(long, ["feature"], "v", [0.25, 0.5, 0.75], chunk_rows)
        stats = q.select("feature", F.col("q1").alias("centre"), (F.col("q2") - F.col("q0")).alias("width"))
    else:
        def pair(f):
            x = F.col(f"`{f}`").cast("double")
            if kind == "standard":
                return F.avg(x), F.stddev_pop(x)
            return F.min(x), F.max(x) - F.min(x)

        one = train.agg(*[
            F.struct(F.lit(f).alias("feature"), c.alias("centre"), w.alias("width")).alias(f"_{i}")
            for i, f in enumerate(features) for c, w in [pair(f)]
        ])
        stats = one.select(F.explode(F.array(*[f"_{i}" for i in range(len(features))])).alias("s")).select("s.*")
    return stats.withColumn("width", F.when(F.col("width") == 0, 1.0).otherwise(F.col("width")))


def scale(df: DataFrame, features, stats: DataFrame):
    """Apply a fitted scaler; it is as many rows as features, so it enters as literals."""
    fitted = {r["feature"]: (r["centre"], r["width"]) for r in stats.collect()}
    return df.select(*[
        ((F.col(f"`{c}`") - F.lit(fitted[c][0])) / F.lit(fitted[c][1])).alias(c) if c in features else F.col(f"`{c}`")
        for c in df.columns
    ])


# ----------------------------------------------------------------- feedback


def feedback_samples(feedback: DataFrame, alerts: DataFrame, features="features"):
    """Analyst labels with the features of their alert; one alert row per id is used."""
    told = feedback.where(F.col("alert_id").isNotNull())
    # far fewer alerts are labelled than stored: drop the others before they are grouped
    known = alerts.join(broadcast_if_small(told.select("alert_id").distinct()), "alert_id", "left_semi")
    known = known.groupBy("alert_id").agg(F.min_by(F.col(features), "ts_us").alias("features"))
    rows = told.join(known, "alert_id")
    return rows.where(F.coalesce(F.size("features"), F.lit(0)) > 0).select(
        "alert_id",
        F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("unknown")).alias("label"),
        F.coalesce(F.when(F.col("weight") != 0, F.col("weight")), F.lit(5.0)).alias("weight"),
        "features",
    )


def weighted_training(base: DataFrame, samples: DataFrame, features, label="label"):
    """Training rows with weight 1 plus analyst samples with their own weight."""
    base = base.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("int").alias("y"), F.lit(1.0).alias("weight"))
    benign = F.lower("label").isin("benign", "normal")
    extra = samples.select(
        *[F.coalesce(F.try_element_at("features", F.lit(f)).cast("double"), F.lit(0.0)).alias(f) for f in features],
        F.when(benign, 0).otherwise(1).alias("y"), F.col("weight").cast("double"),
    )
    return base.unionByName(extra)


def override_votes(alerts: DataFrame, verdicts_df: DataFrame, vote="is_tp"):
    """One vote per alert: the analyst verdict where there is one, else the rule of thumb."""
    late = verdicts_df.groupBy("alert_id").agg(F.max_by("verdict", "ts_us").alias("verdict"))
    rows = alerts.join(late, "alert_id", "left")
    told = F.col("verdict") == "true_positive"
    return rows.withColumn("corrected", F.coalesce(told != F.col(vote), F.lit(False))).withColumn(
        vote, F.coalesce(told, F.col(vote))
    )

