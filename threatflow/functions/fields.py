"""Column expressions that clean and derive packet and alert fields."""

from pyspark.sql import Column, functions as F, types as T

from threatflow.functions import values as V

INT64_MAX = 2**63 - 1


def first_text(*cols):
    """First text that is neither NULL nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def first_number(*cols):
    """First number that is neither NULL nor 0."""
    return F.coalesce(*[F.when(c != 0, c) for c in cols])


def number(col: Column):
    """Number in a text, NULL if there is none (no Java suffixes such as 1.5f)."""
    text = F.trim(col.cast("string"))
    return F.when(~text.rlike("[fFdD]$") | F.lower(text).rlike("inf$"), text.try_cast("double"))


def to_int(col: Column, default=0):
    """Text or number to a whole number, cut toward zero; anything else is ``default``."""
    n = number(col)
    fits = F.when(F.abs(n) < 9.2e18, n)
    whole = F.when(fits >= 0, F.floor(fits)).otherwise(F.ceil(fits))
    return F.coalesce(whole.cast("long"), F.lit(default).cast("long"))


def to_float(col: Column, default=0.0):
    return F.coalesce(number(col), F.lit(default))


def protocol_number(col: Column):
    text = F.lower(F.trim(col.cast("string")))
    named = F.create_map(*[F.lit(x) for kv in V.PROTOCOL_NUMBERS.items() for x in kv])
    digits = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.coalesce(F.try_element_at(named, text), digits, F.lit(0))


def protocol_name(col: Column):
    """Numbers to their names; names stay."""
    names = F.create_map(*[F.lit(x) for k, n in V.PROTOCOL_NUMBERS.items() for x in (str(n), k)])
    text = F.lower(col.cast("string"))
    return F.coalesce(F.try_element_at(names, text), text)


def confidence(col: Column):
    """Percent or fraction to [0, 1]; text that is no number gives 0."""
    raw = to_float(col)
    scaled = F.when((raw > 1) & (raw <= 100), raw / 100).otherwise(raw)
    return F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))


def severity_confidence(severity: Column):
    table = F.create_map(*[F.lit(x) for kv in V.SEVERITY_CONFIDENCE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, severity), F.lit(V.OTHER_CONFIDENCE))


def payload_text(raw: Column):
    """First 512 bytes as text: UTF-8, or Latin-1 where they are not valid UTF-8."""
    head = F.substring(raw, 1, 512)
    return F.coalesce(F.try_validate_utf8(head.cast("string")), F.decode(head, "ISO-8859-1"))


def payload_hex(raw: Column):
    return F.lower(F.hex(F.substring(raw, 1, 512)))


def http_fields(payload: Column, protocol: Column, dst_port: Column):
    """Struct of method, host and path of an HTTP request, NULL for other packets."""
    lines = F.split(payload, "\r\n")
    words = F.split(lines[0], " ")
    hosts = F.filter(lines, lambda line: line.startswith("Host: "))
    is_http = (F.upper(protocol) == "TCP") & dst_port.isin(V.HTTP_PORTS) & payload.contains("HTTP")
    return F.when(
        is_http,
        F.struct(
            F.when(words[0].isin(V.HTTP_METHODS), words[0]).alias("method"),
            F.trim(F.get(F.split(F.get(hosts, F.lit(0)), ": "), F.lit(1))).alias("host"),
            F.get(words, F.lit(1)).alias("path"),
        ),
    )


def clamp_int64(col: Column):
    wide = col.cast("decimal(38,0)")
    low, high = F.lit(-INT64_MAX - 1).cast("decimal(38,0)"), F.lit(INT64_MAX).cast("decimal(38,0)")
    return F.least(F.greatest(wide, low), high).cast("long")


def clamp_nested(col: Column, kind):
    """A value of type ``kind`` with all whole numbers in it, at any depth, within the 64-bit range."""
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return clamp_int64(col)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: clamp_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, x: clamp_nested(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[clamp_nested(col[f.name], f.dataType).alias(f.name) for f in kind]))
    return col


def dedup_key(attacks: Column, src, dst, node, protocol, src_port, dst_port, payload):
    """One text per kind of alert: same key means same alert seen again."""

    def known(col, other="unknown"):
        return F.coalesce(F.when(col.cast("string") != "", col.cast("string")), F.lit(other))

    def port(col):
        return F.coalesce(F.when(col != 0, col.cast("string")), F.lit("na"))

    digest = F.when(F.coalesce(payload, F.lit("")) == "", F.lit("nopayload")).otherwise(
        F.substring(F.sha1(F.encode(payload, "UTF-8")), 1, 8)
    )
    names = F.when(F.size(attacks) > 0, F.array_join(F.array_sort(attacks), ",")).otherwise("unknown")
    return F.concat_ws(
        ":", F.lit("alert"), names, known(src), known(dst), known(node), known(protocol),
        port(src_port), port(dst_port), digest,
    )


def snippet(payload: Column, length=512):
    return F.substring(payload, 1, length)


def short_names(attacks: Column):
    return F.transform(attacks, lambda a: F.split(a, " ")[0])


def flag_count(flags: Column, letter):
    """How often a flag letter occurs, upper or lower case."""
    return F.length(flags) - F.length(F.replace(F.upper(flags), F.lit(letter), F.lit("")))


def missing_and_extra(present: Column, expected: Column):
    return F.struct(
        F.array_sort(F.array_except(expected, present)).alias("missing"),
        F.array_sort(F.array_except(present, expected)).alias("extra"),
    )
