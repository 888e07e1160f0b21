"""Conversation repair against all edits of short conversations, and its cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from threatflow.llm import audit_query, repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def all_edits(roles, found):
    """The cheapest audit, ASCII-least, by trying all edits with at most two inserted rows at each place."""
    best = None
    options = []
    for role, fault in zip(roles, found):
        keep = [] if fault in ("blank", "duplicate") else [("K", 0), ("Ru", 1), ("Ra", 1)]
        options.append([("D", 2), *[(e, c + 5 * (fault == "truncated")) for e, c in keep]])
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for edits in itertools.product(*options):
        for extra in itertools.product(inserts, repeat=len(roles) + 1):
            if sum(map(len, extra)) > 2:
                continue
            starts, audit, cost = "", "", 0
            for i in range(len(roles) + 1):
                for ins in extra[i]:
                    starts, audit, cost = starts + ins, audit + "I", cost + 5
                if i < len(roles):
                    edit, price = edits[i]
                    cost, audit = cost + price, audit + edit[0]
                    starts += "" if edit == "D" else (roles[i][:1] or "-") if edit == "K" else edit[1]
            if LEGAL.match(starts) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def plain(roles, found):
    """The same by carrying whole texts from row to row."""
    held = {0: (0, "")}

    def put(to, place, cost, text):
        if place not in to or (cost, text) < to[place]:
            to[place] = (cost, text)

    def inserted(held):
        for _ in range(4):
            for place, (cost, text) in list(held.items()):
                for role in "ua":
                    if (place, role) in repair.NEXT:
                        put(held, repair.NEXT[place, role], cost + 5, text + "I")
        return held

    inserted(held)
    for role, fault in zip(roles, found):
        new, cut = {}, 5 * (fault == "truncated")
        for place, (cost, text) in held.items():
            put(new, place, cost + 2, text + "D")
            if fault not in ("blank", "duplicate"):
                if (place, role[:1]) in repair.NEXT:
                    put(new, repair.NEXT[place, role[:1]], cost + cut, text + "K")
                for other in "ua":
                    if (place, other) in repair.NEXT:
                        put(new, repair.NEXT[place, other], cost + 1 + cut, text + "R")
        held = inserted(new)
    return min(held[p] for p in (0, 3) if p in held)


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_equals_all_edits(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(5)
    roles = [rnd.choice(["system", "user", "assistant", "tool", ""]) for _ in range(n)]
    found = [rnd.choice([None, None, "truncated", "blank", "duplicate"]) for _ in range(n)]
    assert repair.cheapest(roles, found) == all_edits(roles, found) == plain(roles, found)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7])
def test_long_ones_and_collisions(monkeypatch, modulus):
    """Equal hashes of different texts are found out, so a tiny modulus changes nothing."""
    monkeypatch.setattr(repair, "MODULUS", modulus)
    rnd = random.Random(5)
    for n in (40, 400):
        for _ in range(4):
            roles = rnd.choices(["system", "user", "assistant"], [1, 4, 4], k=n)
            found = rnd.choices([None, "truncated", "blank", "duplicate"], [6, 2, 1, 1], k=n)
            cost, audit = repair.cheapest(roles, found)
            assert (cost, audit) == plain(roles, found)
            after, _ = repair.applied(roles, [""] * n, audit)
            assert LEGAL.match("".join(r[0] for r in after))


def test_comparing_nodes():
    audits, rnd = repair.Audits(), random.Random(2)
    nodes = [0]
    for _ in range(400):
        nodes.append(audits.extend(rnd.choice(nodes[-30:]), rnd.choice("DIKR")))
    for _ in range(2000):
        x, y = [(rnd.choice(nodes), rnd.choice("DIKR")) for _ in range(2)]
        mine, yours = audits.text(x[0]) + x[1], audits.text(y[0]) + y[1]
        assert audits.less(x, y) == (mine < yours)
        depth = rnd.randrange(audits.depth[x[0]] + 1)
        assert audits.text(audits.ancestor(x[0], depth)) == audits.text(x[0])[:depth]


def test_faults_and_order(spark):
    rows = [
        (1, 2, "assistant", "Yes."), (1, 1, "user", "Is it?"), (1, None, "system", "Be short."), (1, 5, "assistant", "Yes."),
        (2, 0, None, None), (3, 1, "user", "no end"), (3, 1, "assistant", " \t"), (None, 1, "user", "Alone!"), (None, None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'a' AS audit", "0 AS n_rows", "1 AS _rows")
    done = {r.conv_id: r for r in repair.repair(df).collect()}
    one = done[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (2, 0, 1, 0, 1)
    assert (one.cost, one.audit) == (2, "KKKD") and one.roles == ["system", "user", "assistant"]
    assert (done[2].blank, done[2].audit, done[2].roles, done[2].cost, done[2].gaps) == (1, "D", [], 2, 0)
    assert (done[3].truncated, done[3].blank, done[3].audit, done[3].cost) == (1, 1, "DD", 4)
    assert done[None].n_rows == 2 and done[None].gaps == 0


def test_query_on_damaged_rows(spark, tmp_path):
    """Against a plain run of the whole contract, with nulls, ties, repeats, dropped conversations and long ones."""
    rnd = random.Random(9)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rnd.choice([1, 2, 5, 9, 300 if conv == 7 else 4])):
            kind = rnd.choice(["user", "assistant", "system", "user", "assistant", None, "tool"])
            text = rnd.choice([None, "", " \n", "Fine.", "Is it? Yes!", "cut off", "Fine.", f"Number {turn}.", f"open {turn}"])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 1]), kind, text))
    rows += rows[:20]
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(folder / "conversations.parquet"))
    got = {r.conv_id: r.asDict() for r in audit_query.op11(spark, str(folder)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        hurt = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            spoken = [" " if v is None else str(v) for v in (c, turn, role, text)]
            code = zlib.crc32(f"{spoken[0]}:{spoken[1]}".encode()) % 20
            role, text = spoken[2], spoken[3]
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            hurt += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found, seen = [], set()
        for _, role, text in hurt:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            found.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in hurt if t is not None]
        roles = [r for _, r, _ in hurt]
        cost, audit = plain(roles, found)
        after = repair.applied(roles, [t for _, _, t in hurt], audit)
        want = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{n: found.count(n) for n in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
            "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(*after)).encode()).hexdigest(),
        }
        assert got[conv] == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repair(repair.damaged(none), present=F.col("_here")).count() == 0
