"""Lookups in the small fixed tables: techniques, playbooks, kill-chain stages, sensors.

The tables hold at most 14 entries and never grow with the data, so they are
written as literal columns and a lookup is a map-only expression: no join, no
shuffle, nothing broadcast.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatflow.functions import values as V


def first_name_match(attack: Column, names):
    """The name equal to ``attack``, else the first with one text inside the other."""
    lowered = F.lower(attack)
    near = [
        F.when(F.contains(lowered, F.lit(n.lower())) | F.contains(F.lit(n.lower()), lowered), n) for n in names
    ]
    return F.when(attack.isin(list(names)), attack).otherwise(F.coalesce(*near))


def technique_of(attack: Column):
    rows = F.create_map(
        *[
            x
            for name, (tid, tname, taid, taname, weight) in V.TECHNIQUES.items()
            for x in (
                F.lit(name),
                F.struct(
                    F.lit(tid).alias("technique_id"), F.lit(tname).alias("technique_name"),
                    F.lit(taid).alias("tactic_id"), F.lit(taname).alias("tactic"),
                    F.lit(weight).alias("severity_weight"),
                ),
            )
        ]
    )
    return F.try_element_at(rows, first_name_match(attack, V.TECHNIQUES))


def map_techniques(df: DataFrame, attacks="attack_types"):
    """Add the techniques of all attack types, plus their distinct ids and tactics."""
    found = F.filter(F.transform(F.col(attacks), technique_of), lambda t: t.isNotNull())
    return (
        df.withColumn("mitre_attack", found)
        .withColumn("mitre_techniques", F.array_sort(F.array_distinct(F.col("mitre_attack.technique_id"))))
        .withColumn("mitre_tactics", F.array_sort(F.array_distinct(F.col("mitre_attack.tactic"))))
    )


def playbook_of(attack: Column):
    def row(severity, technique, steps):
        return F.struct(
            F.lit(severity).alias("severity"),
            F.lit(technique).alias("mitre_id"),
            F.array(
                *[
                    F.struct(F.lit(action).alias("action"), F.lit(i).alias("priority"), F.lit(automated).alias("automated"))
                    for i, (action, automated) in enumerate(steps, 1)
                ]
            ).alias("steps"),
        )

    rows = F.create_map(*[x for name, pb in V.PLAYBOOKS.items() for x in (F.lit(name), row(*pb))])
    found = F.try_element_at(rows, first_name_match(attack, V.PLAYBOOKS))
    return F.coalesce(found, row(*V.DEFAULT_PLAYBOOK))


def _order_of(name: Column, place):
    """Place of the stage that lists a type (place 0) or a tag (place 1)."""
    out = F.lit(None).cast("int")
    for i, lists in reversed(list(enumerate(V.STAGES.values(), 1))):
        out = F.when(name.isin(lists[place]), i).otherwise(out)
    return out


def stage_ord_of(attacks: Column, tags: Column | None = None):
    """Order of the first kill-chain stage that names one of the types or tags."""
    found = F.array_min(F.transform(attacks, lambda a: _order_of(a, 0)))
    if tags is not None:
        found = F.least(found, F.array_min(F.transform(tags, lambda t: _order_of(t, 1))))
    return found


def stage_name(order: Column):
    return F.get(F.array(*[F.lit(s) for s in V.STAGES]), order - 1)


def stage_of(attacks: Column, tags: Column | None = None):
    return stage_name(stage_ord_of(attacks, tags))


def route_sensor(location: Column, sensors):
    """Known sensor locations stay, all others go to the first sensor."""
    return F.when(location.isin(list(sensors)), location).otherwise(F.lit(sensors[0]))


def tactics_table(spark: SparkSession):
    rows = [(i, tid, name) for i, (tid, name) in enumerate(V.TACTICS.items())]
    return spark.createDataFrame(rows, "ord int, tactic_id string, tactic string")
