"""Signature matching: packets against rules, per-packet alerts, rule statistics.

The rules are few and known before the job runs, so the theta join is written as one
SQL expression: each rule is a guard on protocol, ports and fields, followed by its
patterns as literal regular expressions, which Spark compiles once.  Matching
needs no join, and no shuffle where the input has enough splits.

Most patterns need one of a few texts to match. All these texts are sought together
beforehand, so a payload is passed over a few times instead of once per text.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from threatflow.functions import values as V
from threatflow.functions.fields import protocol_name
from threatflow.plans.sizes import spread
from threatflow.sources.rules import needed_texts


# Texts sought in one pass at most, so that their automaton stays small.
TOGETHER = 256
# Payloads searched at once.
ROWS = 500


def quoted(text):
    """A text as a SQL literal."""
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _guard(rule, cols):
    tests = []
    if rule.protocol and "protocol" in cols:
        # numbers are named first; a packet without protocol passes
        tests.append(f"coalesce(_protocol = {quoted(rule.protocol.lower())}, true)")
    for name, ports in (("src_port", rule.src_ports), ("dst_port", rule.dst_ports)):
        if ports and name in cols:
            # port 0 counts as not given
            tests.append(f"coalesce(nullif({name}, 0) IN ({', '.join(map(str, ports))}), true)")
    for name, value in rule.equals.items():
        known = f"coalesce(lower(CAST(`{name}` AS STRING)) = {quoted(str(value).lower())}, false)"
        tests.append(known if name in cols else "false")
    return " AND ".join(tests) or "true"


def needed_by(rules):
    """All texts that patterns cannot match without: short ones, which most payloads hold, first."""
    texts = {t for r in rules for p in r.patterns for t in needed_texts(p)}
    return sorted(texts, key=lambda t: (len(t), t))


def found_texts(payloads: pa.Array, texts):
    """For each payload the places in ``texts`` of those that it holds.

    Texts are sought all together; where one is found, by halves, down to single texts.
    """
    rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    sought = [
        (np.arange(len(payloads)), payloads, i, min(i + TOGETHER, len(texts))) for i in reversed(range(0, len(texts), TOGETHER))
    ]
    while sought:
        at, held, start, end = sought.pop()
        hits = pc.fill_null(pc.match_substring_regex(held, "|".join(map(re.escape, texts[start:end]))), False)
        at, held = at[hits.to_numpy(zero_copy_only=False)], held.filter(hits)
        if not len(at):
            continue
        if end - start == 1:
            rows.append(at)
            places.append(np.full(len(at), start, np.int32))
        else:
            middle = (start + end) // 2
            sought += [(at, held, middle, end), (at, held, start, middle)]
    rows, places = np.concatenate(rows), np.concatenate(places)
    ends = np.cumsum(np.bincount(rows, minlength=len(payloads)))
    offsets = pa.array(np.append(0, ends), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(places[np.argsort(rows, kind="stable")]))


def _held(texts):
    @F.arrow_udf("array<int>")
    def held(payloads: pa.Array) -> pa.Array:
        # a few rows at a time, so that little besides the batch is in memory
        found = [found_texts(payloads.slice(at, ROWS), texts) for at in range(0, len(payloads), ROWS)]
        return pa.concat_arrays(found) if found else found_texts(payloads, texts)

    return held(F.lower("payload"))


def _pattern_test(pattern, places):
    """The literal pattern, tried only where a text was found that it cannot match without."""
    found = f"payload RLIKE {quoted(pattern)}"
    near = " OR ".join(f"array_contains(_held, {places[t]})" for t in needed_texts(pattern))
    return f"({near}) AND {found}" if near else found


def match_sql(place, rule, cols, places):
    """One rule as a struct whose evidence is empty where the rule does not match.

    ``places`` are those of needed texts in the column ``_held``.
    """
    none = "CAST(array() AS ARRAY<STRING>)"
    if rule.patterns:
        hits = [f"IF({_pattern_test(p, places)}, array({quoted(p)}), {none})" for p in rule.patterns]
        evidence = f"concat({', '.join(hits)})"
    else:
        evidence = "array('metadata-match')"
    tags = f"array({', '.join(map(quoted, rule.tags))})" if rule.tags else none
    return (
        f"named_struct('ord', {place}, 'id', {quoted(rule.id)}, 'name', {quoted(rule.name)}, "
        f"'severity', {quoted(rule.severity)}, "
        f"'confidence', {V.SEVERITY_CONFIDENCE.get(rule.severity, V.OTHER_CONFIDENCE)}, "
        f"'tags', {tags}, 'evidence', IF({_guard(rule, cols)}, {evidence}, {none}))"
    )


def with_matches(packets: DataFrame, rules, out="signatures"):
    """Add the array of matching rules, in rule order, each with all its evidence."""
    cols = set(packets.columns)
    text = F.coalesce("payload", F.lit("")) if "payload" in cols else F.lit("")
    texts = needed_by(rules)
    none = F.array().cast("array<int>")
    rows = spread(packets).withColumn("payload", text)
    rows = rows.withColumn("_held", _held(texts) if texts and "payload" in cols else none)
    if "protocol" in cols:
        rows = rows.withColumn("_protocol", protocol_name(F.col("protocol")))
    tried = ", ".join(match_sql(i, r, cols, {t: n for n, t in enumerate(texts)}) for i, r in enumerate(rules))
    rows = rows.withColumn(out, F.expr(f"filter(array({tried}), m -> size(m.evidence) > 0)"))
    return rows.select(*packets.columns, out)


def matches(packets: DataFrame, rules, keep=("packet_id",)):
    """One row per packet and matching rule.

    The outer explode and the filter after it keep Spark from evaluating all rules
    twice, once to filter rows early and once for the result.
    """
    found = with_matches(packets, rules)
    return (
        found.select(*keep, F.explode_outer("signatures").alias("m"))
        .where(F.col("m").isNotNull())
        .select(*keep, "m.*")
    )


def packet_alerts(packets: DataFrame, rules):
    """One alert per packet with a match: names in rule order and the top confidence."""
    found = with_matches(packets, rules)
    some = F.when(F.size("signatures") > 0, F.array("signatures"))
    found = found.select(*packets.columns, F.explode_outer(some).alias("signatures"))
    return (
        found.where(F.col("signatures").isNotNull())
        .withColumn("attack_types", F.col("signatures.name"))
        .withColumn("attack_types_short", F.transform("attack_types", lambda a: F.split(a, " ")[0]))
        .withColumn("confidence", F.array_max(F.col("signatures.confidence")))
        .withColumn("detector", F.lit("rule-based-detector"))
        .withColumn("action", F.lit("flagged"))
        .withColumn("payload_snippet", F.substring("payload", 1, 512))
    )


def rule_stats(rules_df: DataFrame, matched: DataFrame):
    """Matches per rule, zero included; both sides shrink to one row per rule first."""
    counts = matched.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return rules_df.select("ord", "id", "name", "severity").join(counts, "id", "left").withColumn(
        "matches", F.coalesce("n", F.lit(0).cast("long"))
    ).drop("n")


def top_rules(stats: DataFrame, n=10):
    return stats.orderBy(F.desc("matches"), "ord").limit(n)


def severity_breakdown(stats: DataFrame):
    return stats.groupBy("severity").agg(
        F.count(F.lit(1)).alias("rules"), F.sum("matches").alias("matches")
    )
