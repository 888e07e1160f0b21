"""JSON messages to packets and alerts."""

from pyspark.sql import DataFrame, functions as F

from threatflow.functions.fields import first_text

FIELDS = """timestamp STRING, id STRING, source_ip STRING, src_ip STRING, dest_ip STRING, dst_ip STRING,
protocol STRING, protocol_name STRING, src_port STRING, source_port STRING, dst_port STRING, dest_port STRING,
destination_port STRING, size STRING, flags STRING, header_len STRING, payload_len STRING, payload STRING, sensor_location STRING, location STRING, confidence DOUBLE,
attack_types STRING, attacks STRING"""


#: Whole numbers under one name, with the names they may come under.
WHOLE = {
    "src_port": ("src_port", "source_port"),
    "dst_port": ("dst_port", "dest_port", "destination_port"),
    "size": ("size",),
    "header_len": ("header_len",),
    "payload_len": ("payload_len",),
}


def seconds_of(text):
    """Seconds since 1970 from a number or a time written as text; NULL where it is neither."""
    moment = F.try_to_timestamp(text)
    return F.coalesce(text.try_cast("double"), F.unix_micros(moment) / 1e6)


def parse_messages(raw: DataFrame, value="value"):
    """Typed event rows; text that is no JSON object is left out, ``data`` is unwrapped.

    Fractions of whole-number fields are cut off. A time that is neither a number nor a readable date
    rejects its row, as it would else be filed under today. Works on a stream as on a table.
    Each text is parsed before the filters: Spark does not move a filter below an explode, where it would parse anew for each field it asks for.
    """
    text = F.get_json_object(F.col(value), "$")
    inner = F.get_json_object(F.col(value), "$.data")
    body = F.when(F.trim(inner).startswith("{"), inner).otherwise(text)
    rows = raw.select(F.explode(F.array(body)).alias("_body")).where(F.trim("_body").startswith("{"))
    rows = rows.select(F.explode(F.array(F.from_json("_body", FIELDS))).alias("e")).select("e.*")

    def names(col):
        # a list, a single text, or nothing; an empty list counts as nothing
        listed = F.filter(F.from_json(col, "array<string>"), lambda a: a != "")
        one = F.when((col != "") & ~F.startswith(F.trim(col), F.lit("[")), F.array(col))
        return F.when(F.startswith(F.trim(col), F.lit("[")), F.when(F.size(listed) > 0, listed)).otherwise(one)

    types = F.coalesce(names(F.col("attack_types")), names(F.col("attacks")))
    moment = seconds_of(F.col("timestamp"))
    rows = rows.where(F.col("timestamp").isNull() | moment.isNotNull())
    whole = {
        name: F.coalesce(*[F.col(c).try_cast("double") for c in sources]).try_cast("int") for name, sources in WHOLE.items()
    }
    spare = [c for sources in WHOLE.values() for c in sources[1:]]
    return rows.withColumns({**whole, "timestamp": moment, "attack_types": types}).drop("attacks", *spare)


def normalize(events: DataFrame, now=None):
    """One name per field, protocol in upper case, a time on every row."""
    now = F.unix_timestamp(F.current_timestamp()).cast("double") if now is None else F.lit(float(now))
    return (
        events.withColumn("source_ip", first_text(F.col("source_ip"), F.col("src_ip")))
        .withColumn("dest_ip", first_text(F.col("dest_ip"), F.col("dst_ip")))
        .withColumn("protocol_name", F.coalesce("protocol_name", F.when(~F.col("protocol").rlike("^[0-9]+$"), F.upper("protocol"))))
        .withColumn("timestamp", F.coalesce("timestamp", now))
        .withColumn("location", first_text(F.col("sensor_location"), F.col("location")))
        .drop("src_ip", "dst_ip", "sensor_location")
    )


def packets_of(events: DataFrame):
    return events.where(F.col("attack_types").isNull()).drop("attack_types", "confidence", "id")


def alerts_of(events: DataFrame):
    """Rows with attack types; confidence and id get their defaults."""
    return (
        events.where(F.col("attack_types").isNotNull())
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.75)))
        .withColumn("id", F.coalesce("id", F.concat(F.lit("ws-"), F.uuid())))
    )
