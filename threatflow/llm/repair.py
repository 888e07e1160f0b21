"""Conversation structure repair: the cheapest audit of edits that gives a conversation a legal order of roles."""

from pyspark.sql import functions as F

#: White space besides which a text needs something, and the signs a whole text ends with.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: What edits cost; keeping or re-roling a text that breaks off costs CUT more.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Places in the order of roles: nothing yet, after the system text, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The place each role leads to from where it may stand.
NEXT = {(START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT, (START, "s"): SYSTEM}
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Texts of edits that share their beginnings: each is a node that names its last edit and the node before.

    A node knows the hash of its whole text and its ancestors at distances 1, 2, 4 and so on, so two texts
    are compared in the logarithm of their length, whatever they share.
    """

    def __init__(self):
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [[0]]

    def extend(self, node, edit):
        new = len(self.edit)
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(edit)) % MODULUS)
        above, k = [node], 0
        while above[k]:
            far = self.up[above[k]]
            if k >= len(far) or far[k] == 0:
                break
            above.append(far[k])
            k += 1
        self.up.append(above)
        return new

    def ancestor(self, node, depth):
        """The node of this text's first ``depth`` edits."""
        while self.depth[node] > depth:
            step = min((self.depth[node] - depth).bit_length(), len(self.up[node])) - 1
            node = self.up[node][step]
        return node

    def same(self, a, b):
        """Whether two texts are equal; equal hashes are verified down to the node both share."""
        if self.depth[a] != self.depth[b] or self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def fork(self, a, b):
        """The last nodes at equal depth of two texts, moved up to where they first differ; none if they do not."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.same(a, b):
            return None
        for k in reversed(range(max(depth.bit_length(), 1))):
            if k < len(self.up[a]) and k < len(self.up[b]) and not self.same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return a, b

    def less(self, x, y):
        """Whether the text of ``x`` comes before that of ``y``; both are (node, further edit)."""
        (a, e), (b, f) = x, y
        if a == b:
            return e < f
        if found := self.fork(a, b):
            return self.edit[found[0]] < self.edit[found[1]]
        at = min(self.depth[a], self.depth[b])
        mine = e if self.depth[a] == at else self.edit[self.ancestor(a, at + 1)]
        yours = f if self.depth[b] == at else self.edit[self.ancestor(b, at + 1)]
        if mine != yours:
            return mine < yours
        if self.depth[a] == self.depth[b]:
            return False
        # the shorter text ends here and is a beginning of the longer one
        return self.depth[a] < self.depth[b]

    def text(self, node):
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def faults(roles, texts):
    """Each row's first fault: ``blank``, ``duplicate``, ``truncated``, or None."""
    seen, out = set(), []
    for role, text in zip(roles, texts):
        body = text.rstrip(BLANK)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if body[-1] in ENDS else "truncated")
        seen.add((role, text))
    return out


def cheapest(roles, found):
    """Cost and text of the cheapest edits, of equally cheap ones the text that comes first in ASCII.

    Cheapest beginnings are kept for each place in the order of roles; all of them share their nodes.
    """
    audits = Audits()

    def better(best, place, cost, node, edit):
        old = best.get(place)
        if old is None or cost < old[0] or (cost == old[0] and audits.less((node, edit), old[1:])):
            best[place] = (cost, node, edit)
            return True
        return False

    def settled(best):
        return {p: (cost, audits.extend(node, edit)) for p, (cost, node, edit) in best.items()}

    def inserted(held):
        """The held beginnings and what inserted rows make of them, cheapest first."""
        moved = True
        while moved:
            moved, best = False, {}
            for place, (cost, node) in held.items():
                for role in "ua":
                    goal = NEXT.get((place, role))
                    if goal is not None:
                        better(best, goal, cost + INSERT, node, "I")
            for goal, (cost, node, edit) in best.items():
                old = held.get(goal)
                if old is None or cost < old[0] or (cost == old[0] and audits.less((node, edit), (audits.up[old[1]][0], audits.edit[old[1]]))):
                    held[goal] = (cost, audits.extend(node, edit))
                    moved = True
        return held

    held = inserted({START: (0, 0)})
    for role, fault in zip(roles, found):
        best, more = {}, CUT if fault == "truncated" else 0
        for place, (cost, node) in held.items():
            better(best, place, cost + DELETE, node, "D")
            if fault in ("blank", "duplicate"):
                continue
            goal = NEXT.get((place, role[:1]))
            if goal is not None:
                better(best, goal, cost + KEEP + more, node, "K")
            for other in "ua":
                goal = NEXT.get((place, other))
                if goal is not None:
                    better(best, goal, cost + REROLE + more, node, "R")
        held = inserted(settled(best))
    ends = [held[p] for p in (START, ASSISTANT) if p in held]
    cost, node = ends[0]
    for other, rival in ends[1:]:
        if other < cost or (other == cost and audits.text(rival) < audits.text(node)):
            cost, node = other, rival
    return cost, audits.text(node)


def applied(roles, texts, audit):
    """Roles and texts after the edits of an audit."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            out.append((None, ""))
            continue
        if edit == "K":
            out.append((roles[i], texts[i]))
        elif edit == "R":
            out.append((None, texts[i]))
        i += 1
    after, done = "", []
    for role, text in out:
        if role is None:
            role = "assistant" if after == "u" else "user"
        after = role[:1]
        done.append((role, text))
    return [r for r, _ in done], [t for _, t in done]


def _repaired(batches):
    import pyarrow as pa

    for batch in batches:
        out = {n: [] for n in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "texts")}
        at = batch.schema.get_field_index("_rows")
        # one conversation at a time, so that a long one is in memory alone
        for cell in batch.column(at):
            rows = cell.as_py()
            roles, texts = [r["role"] for r in rows], [r["text"] for r in rows]
            found = faults(roles, texts)
            for name in ("blank", "duplicate", "truncated"):
                out[name].append(found.count(name))
            starts = [r[:1] for r in roles]
            out["illegal"].append(sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])))
            cost, audit = cheapest(roles, found)
            out["cost"].append(cost)
            out["audit"].append(audit)
            for name, values in zip(("roles", "texts"), applied(roles, texts, audit)):
                out[name].append(values)
        kinds = {"audit": pa.string(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}
        keep = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in keep], *[pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()]],
            [*[batch.schema.names[i] for i in keep], *out],
        )


def repair(rows, conv="conv_id", turn="turn", role="role", text="text", present=None):
    """One row per conversation: its faults, the cheapest audit of edits and what they make of it.

    Columns: ``conv``, ``n_rows``, ``gaps`` (turn numbers missing between the least and the greatest),
    ``blank``, ``duplicate``, ``truncated`` (rows by their first fault), ``illegal`` (neighbours whose roles may
    not follow each other), ``cost``, ``audit``, and ``roles`` and ``texts`` after the edits.

    Rows are taken by turn, nulls first, and at equal turns by role and text. A null role or text is one space.
    Conversations without an id are one. Rows that ``present`` (a column) denies count as gone, but their
    conversation keeps its row: no faults, an empty audit. Repeated rows are duplicates. A conversation is one
    text, so its rows meet in one task, one conversation at a time; other columns are ignored.
    """
    here = F.lit(True) if present is None else present
    row = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")
    )
    # nulls come first in an ascending array_sort of structs only if the field says so
    line = F.struct(F.col(turn).isNotNull().alias("known"), row.alias("row"))
    held = rows.groupBy(F.col(conv).alias("_conv")).agg(
        F.array_sort(F.collect_list(F.when(here, line))).alias("_lines")
    )
    turns = F.transform(F.filter("_lines", lambda x: x["known"]), lambda x: x["row"]["turn"])
    gaps = F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns))
    named = held.select(
        F.col("_conv").alias(conv),
        F.size("_lines").cast("bigint").alias("n_rows"),
        F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"),
        F.transform("_lines", lambda x: F.struct(x["row"]["role"].alias("role"), x["row"]["text"].alias("text"))).alias("_rows"),
    )
    kind = named.schema[conv].dataType.simpleString()
    schema = f"`{conv}` {kind}, n_rows bigint, gaps bigint, " + ", ".join(
        f"{n} bigint" for n in ("blank", "duplicate", "truncated", "illegal", "cost")
    )
    return named.mapInArrow(_repaired, schema + ", audit string, roles array<string>, texts array<string>")


def damaged(rows, conv="conv_id", turn="turn", role="role", text="text"):
    """Rows damaged by the checksum of ``conv:turn`` modulo 20, with a column ``_here`` that is false for dropped rows.

    0 drops a row, 1 empties its text, 2 takes the ends of sentences out of it, 3 repeats it, 4 makes it a user's.
    Nulls are one space throughout, but a null turn stays one.
    """
    spoken = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    code = F.crc32(F.concat(spoken[0], F.lit(":"), spoken[1]).cast("binary")) % 20
    return (
        rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spoken[2].alias("role"), spoken[3].alias("text"), code.alias("_code"))
        .withColumn("role", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")))
        .withColumn("text", F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("_copy", F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text", (F.col("_code") != 0).alias("_here"))
    )
