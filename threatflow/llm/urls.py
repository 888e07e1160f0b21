"""URL filters: allow and block rules, and boosted trees for the URLs no rule fits."""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threatflow.llm.shared import saved
from threatflow.plans.sizes import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Different labelled URLs the trees are fitted on at most, taken by a hash of the URL.
TRAIN_ROWS = 20_000
#: Parts that URLs are dealt to, for suffix counts that leave a URL's own part out.
FOLDS = 5

FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_letters", "f_hyphens",
    "f_entropy", "f_params", "f_fragment", "f_secure", "f_suffix", "f_suffix_rows",
)


def parts(urls, url="url"):
    """Add ``host`` (ASCII letters lower-cased) and ``path``; both are empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def fitting(rules):
    """The longest rule that fits ``host`` and ``path``, as struct (rule, verdict); null if none does.

    A rule like ``example.org/en/`` fits its host and all subdomains, where the path starts with its own.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules.items(), key=lambda r: len(r[0])):
        name, slash, below = rule.partition("/")
        own = (F.col("host") == name) | F.col("host").endswith("." + name)
        fits = own & F.col("path").startswith(slash + below)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _counted(text, character):
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def lexical(urls, url="url"):
    """Add the features that follow from the URL alone, and ``suffix``, the host's last two labels."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    length = F.greatest(F.length(u), F.lit(1))

    def surprise(state, c):
        share = (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / length
        return state - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    letters = F.length(u) - F.length(F.translate(u, UPPER + LOWER, ""))
    return (
        urls.withColumn("suffix", F.substring_index(host, ".", -2))
        .withColumn("f_length", F.length(u))
        .withColumn("f_host_length", F.length(host))
        .withColumn("f_path_length", F.length(path))
        .withColumn("f_depth", _counted(path, "/"))
        .withColumn("f_labels", _counted(host, "."))
        .withColumn("f_digits", digits / length)
        .withColumn("f_letters", letters / length)
        .withColumn("f_hyphens", _counted(u, "-"))
        .withColumn("f_entropy", F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), surprise))
        .withColumn(
            "f_params", F.when(F.instr(u, "?") > 0, 1 + _counted(u, "&")).otherwise(0)
        )
        .withColumn("f_fragment", F.instr(u, "#").cast("boolean").cast("int"))
        .withColumn("f_secure", F.startswith(u, F.lit("https:")).cast("int"))
    )


class UrlFilter:
    """Boosted trees on lexical features, trained from the URLs that rules label.

    At most ``rows`` different labelled URLs are used, chosen by a hash, each once. All labelled rows give the
    suffix statistics (smoothed share of blocked rows and number of rows per suffix). Without both
    verdicts among the URLs used, all URLs get the one verdict there is, or ``allow``.
    """

    def __init__(self, rules, rows=TRAIN_ROWS, trees=20, depth=4, seed=7):
        self.rules, self.rows, self.trees, self.depth, self.seed = rules, rows, trees, depth, seed

    def fit(self, urls, url="url"):
        """Train on a table's URLs, and count suffixes over all that a rule labels; returns the filter.

        A URL that is trained on takes its suffix's counts from the other FOLDS - 1 parts of the URLs, so that they
        tell nothing of its own verdict. Null URLs and those without a rule are left out.
        """
        judged = parts(urls.select(url), url).withColumn("_rule", fitting(self.rules)).where("_rule is not null")
        chosen = judged.select(url).distinct().orderBy(F.xxhash64(url), url).limit(self.rows)
        blocked = (F.col("_rule.verdict") == "block").cast("double")
        fold = F.pmod(F.xxhash64(F.lit(3), url), F.lit(FOLDS)).alias("_fold")
        chosen = lexical(parts(chosen, url), url).withColumn("_rule", fitting(self.rules))
        chosen = saved(chosen.select("*", blocked.alias("label"), fold).drop("_rule"))
        seen = chosen.agg(F.min("label").alias("least"), F.max("label").alias("most")).first()
        self.only, self.model = ("block" if seen.least == 1 else "allow"), None
        if seen.least == seen.most:
            return self
        counts = judged.groupBy(F.substring_index("host", ".", -2).alias("suffix"), fold).agg(
            F.sum(blocked).alias("blocked"), F.count("*").cast("double").alias("f_suffix_rows")
        )
        counts = saved(counts)
        self.mean = counts.agg(F.sum("blocked") / F.sum("f_suffix_rows")).first()[0]
        whole = counts.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("f_suffix_rows").alias("f_suffix_rows"))
        self.suffixes = broadcast_if_small(whole)
        own = counts.select("suffix", "_fold", F.col("blocked").alias("_blocked"), F.col("f_suffix_rows").alias("_rows"))
        trees = GBTClassifier(
            labelCol="label", featuresCol="features", maxIter=self.trees, maxDepth=self.depth, stepSize=0.2, seed=self.seed,
            maxMemoryInMB=64, cacheNodeIds=False,
        )
        fitted = self._vectors(chosen.join(broadcast_if_small(own), ["suffix", "_fold"], "left"), F.col("_blocked"), F.col("_rows"))
        self.model = trees.fit(fitted.select("features", "label").repartition(4, "features"))
        return self

    def _vectors(self, rows, own_blocked=None, own_rows=None):
        """Feature vectors, with the suffix's smoothed share of blocked rows and number of rows, less some own ones."""
        def less(name, own):
            whole = F.coalesce(name, F.lit(0.0))
            return whole if own is None else whole - F.coalesce(own, F.lit(0.0))

        rows = rows.join(self.suffixes, "suffix", "left")
        share = (less("blocked", own_blocked) + 5 * self.mean) / (less("f_suffix_rows", own_rows) + 5)
        rows = rows.withColumn("f_suffix", share).withColumn("f_suffix_rows", less("f_suffix_rows", own_rows))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def judge(self, urls, url="url"):
        """Add host, path, rule (null if none fits), score (of being blocked; null if a rule decides or there is
        no model) and verdict. Null URLs have an empty host and path; other columns stay, those
        named like the results are replaced."""
        made = {"host", "path", "rule", "verdict", "score"}
        kept = [c for c in urls.columns if c.lower() not in made or c == url]
        own = F.struct(*[F.col(c) for c in kept]).alias("_row")
        rows = parts(urls.select(own, F.col(url).alias("_url")), "_url").withColumn("_rule", fitting(self.rules))
        if self.model is None:
            rows = rows.withColumn("score", F.lit(None).cast("double"))
            guess = F.lit(self.only)
        else:
            rows = self.model.transform(self._vectors(lexical(rows, "_url")))
            rows = rows.withColumn("score", vector_to_array("probability")[1])
            guess = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
        return rows.select(
            "_row.*",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.when(F.col("_rule").isNull(), F.col("score")).alias("score"),
            F.coalesce(F.col("_rule.verdict"), guess).alias("verdict"),
        )
