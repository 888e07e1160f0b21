"""Chat formatting: typed content parts become one marked text with attachments and a loss mask."""

from pyspark.sql import functions as F

#: Control strings begin with ``<|``, which no escaped text holds.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: Tokens that a unit of an attachment takes in a model: tiles of an image, seconds of audio, pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}

PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escaped(text):
    """``<|`` becomes ``<^|``, ``<^|`` becomes ``<^^|`` and so on."""
    return F.regexp_replace(text, r"<(\^*)\|", r"<^$1|")


def unescaped(text):
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, r"<\^(\^*)\|", r"<$1|")


def text_parts(text):
    """A plain text as a list with one part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("units"),
        )
    )


def line_parts(text):
    """A text as a list of parts, one per line, each with its line break."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    last = F.size(lines) - 1
    return F.transform(
        lines,
        lambda line, i: F.struct(
            F.lit("text").alias("kind"),
            F.when(i < last, F.concat(line, F.lit("\n"))).otherwise(line).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("units"),
        ),
    )


def _body(parts):
    """What a turn's parts read as: texts escaped, a marker of its kind for each attachment.

    Neighbouring texts are joined before they are escaped, so no control string can come about between them.
    """
    none = F.lit("")

    def marker(part):
        shown = F.lit(None).cast("string")
        for kind in UNIT_TOKENS:
            shown = F.when(part["kind"] == kind, F.lit(f"<|{kind}|>")).otherwise(shown)
        return shown

    def visit(state, part):
        mark = marker(part)
        pending = F.concat(state["text"], F.coalesce(part["text"], none))
        return F.struct(
            F.when(mark.isNull(), state["done"]).otherwise(F.concat(state["done"], escaped(state["text"]), mark)).alias("done"),
            F.when(mark.isNull(), pending).otherwise(none).alias("text"),
        )

    start = F.struct(none.alias("done"), none.alias("text"))
    return F.aggregate(parts, start, visit, lambda s: F.concat(s["done"], escaped(s["text"])))


def _tokens(part):
    cost = F.lit(0).cast("bigint")
    for kind, each in UNIT_TOKENS.items():
        cost = F.when(part["kind"] == kind, F.coalesce(part["units"], F.lit(1)) * each).otherwise(cost)
    return cost


def formatted(turns, conversation="conv_id", turn="turn", role="role", parts="parts", learned="assistant"):
    """One row per conversation: ``formatted``, ``loss`` and ``attachments``.

    A visitor reads each turn's ``parts`` (``PART``) in order: neighbouring texts are joined and escaped, an image, audio or document
    part becomes a placeholder, and ``attachments`` lists kind, reference, turn, the placeholder's number
    and its expanded tokens (units of the part times ``UNIT_TOKENS``; null units: 1). ``loss`` has for
    each turn of the role ``learned`` the turn's number and where the learned code points lie within
    the turn.

    Null roles and texts are empty, null parts are no parts, unknown kinds read as text. Turns of the same
    number are ordered by role and content, null numbers come first, null conversations are one
    conversation. A conversation is one text, so its turns meet in one task.
    """
    body = _body(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")))
    outside = F.filter(F.col(parts), lambda p: p["kind"].isin(*UNIT_TOKENS))
    files = F.transform(
        F.coalesce(outside, F.array().cast(f"array<{PART}>")),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
    )
    entry = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        body.alias("body"),
        files.alias("files"),
    )
    gathered = turns.groupBy(F.col(conversation)).agg(F.array_sort(F.collect_list(entry)).alias("_turns"))
    head = lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT))
    shown = F.transform("_turns", lambda t: F.concat(head(t), t["body"], F.lit(END)))
    spans = F.transform(
        "_turns",
        lambda t, i: F.struct(
            i.alias("turn"),
            F.length(head(t)).alias("start"),
            F.when(t["role"] == learned, F.length(t["body"])).otherwise(-1).alias("length"),
        ),
    )
    numbered = F.flatten(
        F.transform(
            "_turns",
            lambda t, i: F.transform(
                t["files"],
                lambda f, k: F.struct(
                    f["kind"].alias("kind"), f["ref"].alias("ref"), i.alias("turn"), k.alias("number"), f["tokens"].alias("tokens")
                ),
            ),
        )
    )
    return gathered.select(
        conversation,
        F.array_join(shown, "").alias("formatted"),
        F.filter(spans, lambda s: s["length"] >= 0).alias("loss"),
        numbered.alias("attachments"),
    )


def turn_texts(formatted_text):
    """The turns of a formatted conversation, still escaped, without the leading mark.

    Put the result in a column before the readers below use it.
    """
    pieces = F.split(formatted_text, r"<\|turn\|>")
    return F.slice(pieces, F.lit(2), F.size(pieces))


def read_turns(turns):
    """Roles and texts, read back from the turns of a formatted conversation."""
    return F.transform(
        turns,
        lambda t: F.struct(
            unescaped(F.substring_index(t, TEXT, 1)).alias("role"),
            unescaped(F.regexp_extract(t, r"(?s)^.*?<\|text\|>(.*)<\|end\|>$", 1)).alias("text"),
        ),
    )


def read_learned(turns, loss):
    """The unescaped texts under the loss mask, in order."""
    return F.transform(
        loss,
        lambda s: unescaped(F.substr(F.get(turns, s["turn"]), s["start"] - len(TURN) + 1, s["length"])),
    )
