"""Column expressions that judge an alert: severity, noise, gates, triage text."""

from pyspark.sql import Column, functions as F

from threatflow.functions import values as V


def _any_of(attacks, types):
    return F.exists(attacks, lambda a: a.isin(types))


def _all_of(attacks, types):
    """True for an empty list too."""
    return F.forall(attacks, lambda a: a.isin(types))


def is_noise(attacks: Column, source_ip: Column):
    first = F.get(attacks, F.lit(0))
    return F.coalesce(first.isin(V.NOISE_TYPES) & source_ip.rlike(V.LOCAL_ADDRESS), F.lit(False))


def is_true_positive(attacks: Column, confidence: Column):
    """Vote on an alert: confirmed by signature or strong DDoS, else not if only weak types."""
    confirmed = _any_of(attacks, V.CONFIRMED_TYPES)
    flood = F.array_contains(attacks, "DDoS") & F.coalesce(confidence >= 0.8, F.lit(False))
    weak_only = _all_of(attacks, V.UNCERTAIN_TYPES)
    return F.when(confirmed | flood, True).when(weak_only, False).otherwise(True)


def server_severity(primary: Column):
    return (
        F.when(primary.isin(V.SERVER_CRITICAL), "critical")
        .when(primary.isin(V.SERVER_HIGH), "high")
        .when(primary.isin(V.SERVER_LOW), "low")
        .otherwise("medium")
    )


def percent(confidence: Column):
    """Fractions become whole percent; larger numbers are percent already."""
    return F.floor(F.when(confidence > 1, confidence).otherwise(confidence * 100) + 0.5).cast("long")


def board_severity(primary: Column, confidence: Column):
    pct = percent(confidence)

    def named(types):
        hit = F.lit(False)
        for t in types:
            hit = hit | F.contains(primary, F.lit(t))
        return hit

    return (
        F.when(named(V.BOARD_CRITICAL) | (pct >= 95), "critical")
        .when(named(V.BOARD_HIGH) | (pct >= 85), "high")
        .when(pct >= 70, "medium")
        .otherwise("low")
    )


def may_alert(score: Column, signals: Column, at=V.RISK_ALERT_AT, least=1):
    return (score >= at) & (signals >= least)


def may_block(score: Column, signals: Column, source_ip: Column, enabled, at=V.RISK_BLOCK_AT, least=2):
    known = F.coalesce((F.trim(source_ip) != "") & (F.lower(F.trim(source_ip)) != "unknown"), F.lit(False))
    return F.lit(bool(enabled)) & known & F.coalesce((score >= at) & (signals >= least), F.lit(False))


def gate_mitigation(mitigation: Column, allowed: Column):
    """A block that the gate does not allow becomes a flag with a note."""
    asks = F.lower(F.trim(mitigation["action"])).isin("block", "blocked")
    return F.when(
        asks & ~allowed,
        mitigation.withField("action", F.lit("flagged")).withField("note", F.lit("auto_block_skipped_by_gate")),
    ).otherwise(mitigation.withField("note", F.lit(None).cast("string")))


def fallback_triage(attacks: Column):
    """Verdict and confidence when no analyst model answered."""
    confirmed = _any_of(attacks, V.TRIAGE_CONFIRMED_TYPES)
    weak_only = _all_of(attacks, V.TRIAGE_UNCERTAIN_TYPES)
    return F.struct(
        F.when(confirmed, "true_positive").otherwise("uncertain").alias("verdict"),
        F.when(confirmed, 0.85).when(weak_only, 0.4).otherwise(0.5).alias("confidence"),
    )


def triage_prompt(attacks, source_ip, dest_ip, protocol, confidence, payload, detector, description):
    """The question put to an analyst model; long texts are clipped to 200 characters."""

    def clip(col):
        return F.substring(F.coalesce(col, F.lit("")), 1, 200)

    def known(col, other):
        return F.coalesce(col.cast("string"), F.lit(other))

    return F.concat_ws(
        "\n",
        F.lit("Classify this alert."),
        F.concat(F.lit("Attack type: "), F.array_join(attacks, ", ")),
        F.concat(F.lit("Source: "), known(source_ip, "unknown")),
        F.concat(F.lit("Destination: "), known(dest_ip, "unknown")),
        F.concat(F.lit("Protocol: "), known(protocol, "TCP")),
        F.concat(F.lit("Confidence: "), known(confidence, "N/A")),
        F.concat(F.lit("Payload: "), clip(payload)),
        F.concat(F.lit("Detector: "), known(detector, "unknown")),
        F.concat(F.lit("Description: "), clip(description)),
        F.lit("Answer in JSON with verdict, confidence, reasoning, severity and recommended_action."),
    )


def triage_key(attacks, source_ip, dest_ip, payload, confidence):
    """Short digest under which a verdict can be found again."""
    blank = F.lit("")
    parts = F.concat_ws(
        "|",
        F.array_join(attacks, ","),
        F.coalesce(source_ip, blank),
        F.coalesce(dest_ip, blank),
        F.substring(F.coalesce(payload, blank), 1, 100),
        F.coalesce(confidence.cast("string"), blank),
    )
    return F.substring(F.sha2(F.encode(parts, "UTF-8"), 256), 1, 16)


def answer_json(text: Column):
    """The JSON object in a model's answer: fenced block, whole text, or first { to last }."""

    def as_object(candidate):
        trimmed = F.trim(candidate)
        return F.when(F.get_json_object(trimmed, "$").isNotNull(), trimmed)

    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(as_object(fenced), as_object(text), as_object(braces))


def narrative(severity, attack, source_ip, dest_ip, node, confidence, automated, manual):
    """Incident text: what was seen, and which actions run alone or need a person. Its wording is a fixed value."""
    shown = F.when(confidence <= 1, (confidence * 100).cast("int").cast("string")).otherwise(
        confidence.cast("int").cast("string")
    )

    def known(col):
        return F.coalesce(col, F.lit("unknown"))

    return F.concat_ws(
        " ",
        F.concat(F.lit("🚨 "), F.upper(severity), F.lit(" SEVERITY — "), attack, F.lit(" detected.")),
        F.concat(F.lit("Source: "), known(source_ip), F.lit(" → Target: "), known(dest_ip),
                 F.lit(" (node: "), known(node), F.lit(").")),
        F.concat(F.lit("Detection confidence: "), shown, F.lit("%.")),
        F.when(F.size(automated) > 0,
               F.concat(F.lit("Automated actions: "), F.array_join(automated, ", "), F.lit("."))),
        F.when(F.size(manual) > 0,
               F.concat(F.lit("Manual review required: "), F.array_join(manual, ", "), F.lit("."))),
    )
