"""Conversation repair against plain dynamic programming over whole conversations."""

import hashlib
import random
import zlib

import pytest

from tickloom.llm import dialogue

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
SPACE = " \t\n\x0b\f\r"


def plain_damage(rows):
    """(conv_id, turn, role, text) after damage."""
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if harm == 1:
            text = ""
        elif harm == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        elif harm == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def plain_report(rows):
    """The report of one conversation, from all its edit scripts kept minimal by (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    turns = {r[1] for r in rows} - {None}
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    seen, best = set(), {"": (0, "", ())}

    def keep(at, state, value):
        if state not in at or value < at[state]:
            at[state] = value

    def inserted(at):
        at = dict(at)
        for _ in range(3):
            for s, (c, a, m) in list(at.items()):
                keep(at, NEXT[s], (c + 3, a + "I", m + (f"{'user' if NEXT[s] == 'u' else 'assistant'}:",)))
        return at

    for _, _, role, text in rows:
        body = text.rstrip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        after = {}
        for s, (c, a, m) in inserted(best).items():
            keep(after, s, (c + 4, a + "D", m))
            if fault in ("blank", "duplicate"):
                continue
            c += 3 * (fault == "truncated")
            if role[:1] == NEXT[s] or (s == "" and role[:1] == "s"):
                keep(after, role[:1], (c, a + "K", (*m, f"{role}:{text}")))
            keep(after, NEXT[s], (c + 3, a + "R", (*m, f"{'user' if NEXT[s] == 'u' else 'assistant'}:{text}")))
        best = after
    ends = inserted(best)
    cost, audit, messages = min(ends[s] for s in ("", "a") if s in ends)
    initials = [r[2][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(messages).encode()).hexdigest())


def conversations(rng, n):
    rows = []
    texts = ["Yes.", "No!", "Well", "", " \t\n", "What?", "ünd so weiter", "ends. \n", "\x1c", "a\x85"]
    for c in range(n):
        for t in range(rng.randrange(0, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice([*texts, None, f"{rng.random()}.", f"{rng.random()}."])
            turn = rng.choice([t, t, t, t, t + 3, None])
            rows += [(c if c else None, turn, role, text)] * rng.choice([1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("run", [dialogue.RUN, 3])
def test_reports(spark, monkeypatch, run):
    monkeypatch.setattr(dialogue, "RUN", run)
    rng = random.Random(run)
    rows = conversations(rng, 60)
    # one long conversation, longer than a lattice, over many tasks
    rows += [(1000, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"{t}.", f"{t}"])) for t in range(700)]
    rows += [(2000, 5, "user", "Again.")] * 400
    table = spark.createDataFrame([(*r, 9, "?", "?") for r in rows], "conv_id long, turn long, role string, text string, copies int, print string, piece string").repartition(3)
    ids = table.selectExpr("conv_id AS id")
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    got = dialogue.reports(dialogue.damaged(table), ids).collect()
    assert {r.id: tuple(r)[1:] for r in got} == {c: plain_report(own) for c, own in groups.items()} and len(got) == len(groups)
    assert dialogue.reports(dialogue.damaged(table.limit(0)), ids.limit(0)).count() == 0


def test_nothing_left(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    (row,) = dialogue.reports(dialogue.damaged(table), table.selectExpr("conv_id AS id")).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_messages(spark):
    rows = [("a", 0, "system", "Be brief."), ("a", 1, "assistant", "Hello."), ("a", 2, "user", "Go on."), ("a", 3, "user", "Go on."), ("a", 4, "assistant", "x" * 2_000_000 + ".")]
    table = spark.createDataFrame([*rows, ("b", 0, "tool", "1.")], "conv_id string, turn int, role string, text string")
    reports, messages = dialogue.repair(table)
    left = [tuple(r) for r in messages.where("id = 'a'").orderBy("place").collect()]
    assert left == [("a", 0, "system", "Be brief."), ("a", 1, "user", ""), ("a", 2, "assistant", "Hello."), ("a", 3, "user", "Go on."), ("a", 4, "assistant", "x" * 2_000_000 + ".")]
    assert {r.id: (r.cost, r.audit) for r in reports.collect()} == {"a": (7, "KIKKDK"), "b": (4, "D")}


def test_equal_costs_take_the_least_audit():
    u, a = ("u", False, False, 1), ("a", False, False, 1)
    # two users: an answer between them (3 + 3) costs as much as nothing else does; ties go to the least letters
    assert dialogue.chained([{"ways": [dict(zip(("x", "y", "cost", "audit"), w)) for w in dialogue.ways((u, u))]}])[:2] == (3, "KR")
    assert dialogue.cheapest((a,), "0", "a") == (3, "IK")
    assert dialogue.cheapest((), "0", "0") == (0, "") and dialogue.cheapest((), "0", "a") is None
