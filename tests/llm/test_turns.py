"""Conversation repair against an enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from shoebox.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string, fault string, pos int, id long"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def all_edits(rows, found):
    """Cheapest (cost, audit, lines) of every way to edit; more inserts than these cost more than deleting all rows."""
    best = None
    spare = 2 * len(rows) // 5
    gaps = [g for n in range(spare + 1) for g in itertools.combinations_with_replacement(range(len(rows) + 1), n)]
    for letters in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["K", "D", "Ru", "Ra"] for f in found]):
        for gap in gaps:
            for roles in itertools.product("ua", repeat=len(gap)):
                audit, initials, lines, cost = "", "", [], 5 * len(gap)
                for i in range(len(rows) + 1):
                    for at, role in zip(gap, roles):
                        if at == i:
                            audit, initials = audit + "I", initials + role
                            lines.append({"u": "user", "a": "assistant"}[role] + ":")
                    if i < len(rows):
                        letter, (_, _, role, text) = letters[i], rows[i]
                        audit += letter[0]
                        cost += {"K": 0, "R": 1, "D": 2}[letter[0]] + (5 if found[i] == "truncated" and letter != "D" else 0)
                        if letter != "D":
                            role = {"K": role, "Ru": "user", "Ra": "assistant"}[letter]
                            initials += role[:1] or "?"  # an empty role fits no place
                            lines.append(f"{role}:{text}")
                if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, "\n".join(lines)
    return best


def expected(conv, rows):
    rows = sorted(harmed(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    found, known = faults(rows), [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    cost, audit, lines = all_edits(rows, found)
    return {
        "conv_id": conv, "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **{k: found.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "repaired": lines,
    }


def test_all_edits(spark):
    pick = random.Random(3)
    convs = {}
    for conv in [*range(70), None]:
        convs[conv] = [
            (conv, pick.choice([None, 0, 1, 2, 3, 3, 9, -4]), pick.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), pick.choice(["Yes.", "No!", "  \n", "half", "Why? \t", None, "", "ü"]))
            for _ in range(pick.randint(1, 4))
        ]
    rows = [(*r, "x", 1, 2) for v in convs.values() for r in v]
    got = {r["conv_id"]: r.asDict() for r in turns.repair_turns(turns.damage(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c, v in convs.items():
        assert got[c] == expected(c, v), v


def test_no_damage_and_ties(spark):
    """Rows as they are: a run of equal initials, a system turn alone, truncated ends, all blank."""
    cases = {
        1: [("user", "a."), ("user", "b."), ("assistant", "c.")], 2: [("system", "s.")], 3: [("user", "a."), ("assistant", "cut")], 4: [("user", " ")] * 3,
        5: [("system", "s."), ("system", "t."), ("user", "a."), ("assistant", "b.")], 6: [("assistant", "a."), ("user", "b.")], 7: [("user", "a."), ("assistant", "b."), ("assistant", "c."), ("user", "d.")],
    }
    rows = spark.createDataFrame([(c, i, *r, False) for c, v in cases.items() for i, r in enumerate(v)], "conv_id long, turn long, role string, text string, gone boolean")
    got = {r["conv_id"]: (r["cost"], r["audit"], r["repaired"]) for r in turns.repair_turns(rows).collect()}
    for c, v in cases.items():
        given = [(c, i, *r) for i, r in enumerate(v)]
        assert got[c] == all_edits(given, faults(given)), c


def test_lines_with_inserts(spark):
    """Letters that no cheapest edit has, replayed by hand."""
    rows = [("system", "s"), ("user", "x"), ("assistant", "y")]
    cases = {
        "KKKII": "system:s\nuser:x\nassistant:y\nuser:\nassistant:", "DIIDD": "user:\nassistant:", "KIRKI": "system:s\nuser:\nassistant:x\nassistant:y\nuser:", "IRIRD": "user:\nassistant:s\nuser:\nassistant:x",
        "DDIK": "user:\nassistant:y", "KIIKK": "system:s\nuser:\nassistant:\nuser:x\nassistant:y", "DKIIR": "user:x\nassistant:\nuser:\nassistant:y", "DDD": "",
    }
    turn = [{"initial": r[:1], "role": r, "text": t} for r, t in rows]
    df = spark.createDataFrame([(a, turn) for a in cases], "audit string, turns array<struct<initial: string, role: string, text: string>>")
    assert {r["audit"]: r["lines"] for r in df.select("audit", turns.repaired_text("turns", "audit").alias("lines")).collect()} == cases


def test_long_conversation_and_empty_table(spark):
    n = 3000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(False).alias("gone"))
    got = turns.repair_turns(rows).first()
    assert (got["cost"], got["audit"]) == (0, "K" * n)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_turns(turns.damage(none)).count() == 0


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(conv, 0, "user", "hm.")], "conv_id long, turn long, role string, text string")
    got = turns.repair_turns(turns.damage(one)).first().asDict()
    assert got == {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired": ""}


def test_query_is_native(spark):
    df = queries.QUERIES["op13_turn_repair"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange") == 1
    assert all(re.fullmatch("[0-9a-f]{64}", r["repaired_sha256"]) for r in df.collect())
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
