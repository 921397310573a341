"""Conversation repair against a search over all edits, and its defined cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.compare import difference, duck
from tilewright.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, at int, fault string, place string"
GOAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def search(rows):
    """All edits with at most two insertions before each row and at the end, cheapest and then least first."""
    fault = faults(rows)
    ways = [(0, "", "", ())]
    for (role, text), f in zip(rows, fault, strict=True):
        more = []
        for cost, audit, roles, lines in ways:
            starts = [(cost, audit, roles, lines)]
            for extra in ("u", "a", "ua", "au"):
                starts.append((cost + 3 * len(extra), audit + "I" * len(extra), roles + extra, lines + tuple(("user:" if x == "u" else "assistant:") for x in extra)))
            for c, a, r, o in starts:
                more.append((c + 4, a + "D", r, o))
                if f not in (1, 2):
                    c += 3 * (f == 3)
                    more.append((c, a + "K", r + (role[:1] or "?"), (*o, f"{role}:{text}")))
                    more += [(c + 3, a + "R", r + x, (*o, f"{name}:{text}")) for x, name in (("u", "user"), ("a", "assistant"))]
        ways = [w for w in more if re.match(r"(s?(ua)*u?)\Z", w[2])]
    ends = [(c + 3 * len(x), a + "I" * len(x), r + x, o + tuple(("user:" if y == "u" else "assistant:") for y in x)) for c, a, r, o in ways for x in ("", "u", "a", "ua")]
    cost, audit, _, lines = min(w for w in ends if GOAL.match(w[2]))
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_rows(rng, n):
    role = lambda: rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "usher"))
    return [(role(), rng.choice(("Yes.", "No!", "cut off", "", " \t", "Why?", "same.", "Ünï ☃."))) for _ in range(n)]


def result(spark, rows):
    plan, turns = repair.repair(spark.createDataFrame(rows, SCHEMA))
    digests = {r.conv_id: r.repaired_sha256 for r in repair.digest_turns(turns).collect()}
    return {r.conv_id: (r.cost, r.audit, digests.get(r.conv_id, hashlib.sha256().hexdigest())) for r in plan.collect()}, plan


def test_equals_search(spark):
    rng = random.Random(12)
    convs = {i: random_rows(rng, rng.randint(1, 5)) for i in range(150)}
    rows = [(c, t, role, text, 1, "x", "y") for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    got, _ = result(spark, rows)
    for c, turns in convs.items():
        assert got[c] == search(turns), turns


def test_programme_is_least_in_long_conversations():
    """Cost and audit against a machine that carries every audit as a string."""
    rng = random.Random(3)
    for _ in range(40):
        rows = random_rows(rng, 60)
        inf = (10**9, "")
        state = {"n": (0, ""), "s": inf, "u": inf, "a": inf}
        follow = {"n": "u", "s": "u", "u": "a", "a": "u"}
        programme = repair.Programme()
        for (role, _), f in zip(rows, faults(rows), strict=True):
            programme.add(role[:1], f)
            new = {p: [(c + 4, a + "D")] for p, (c, a) in state.items()}
            if f not in (1, 2):
                for p, (c, a) in state.items():
                    for k in (0, 1):
                        r = follow[p] if k == 0 else follow[follow[p]]
                        base = (c + 3 * k + 3 * (f == 3), a + "I" * k)
                        if role[:1] == r:
                            new[r].append((base[0], base[1] + "K"))
                        new[r].append((base[0] + 3, base[1] + "R"))
                c, a = state["n"]
                if role[:1] == "s":
                    new["s"].append((c + 3 * (f == 3), a + "K"))
            state = {p: min(x) for p, x in new.items()}
        want = min(state["n"], state["a"], (state["u"][0] + 3, state["u"][1] + "I"), (state["s"][0] + 6, state["s"][1] + "II"))
        cost, audit, roles = programme.result()
        assert (cost, audit) == want
        assert GOAL.match(roles) and len(roles) == len(audit) - audit.count("D")


def test_defined_cases(spark):
    rows = [
        (None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."),
        (1, None, None, None), (1, 5, "user", "Hi."), (1, 9, "assistant", "Ho."), (1, 9, "assistant", "Ho."),
        (2, 0, "user", "x" * 300_000 + "."), (2, 0, "assistant", "Long."),
        (3, 0, "user", "Cut"), (4, None, "user", ""), (5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b."),
    ]
    got, plan = result(spark, [(*r, 1, "x", "y") for r in rows])
    assert got[None][:2] == (0, "KK")
    assert got[1][:2] == (8, "DKKD")
    assert got[2][:2] == (6, "IKKI")  # the same turn: by role, so the assistant's row comes first
    assert got[3][:2] == (4, "D") and got[4] == (4, "D", hashlib.sha256().hexdigest())
    facts = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) for r in plan.collect()}
    assert facts[1] == (3, 1, 1, 0, 2) and facts[4] == (0, 1, 0, 0, 0) and facts[5][0] == 2**63 - 1
    assert repair.repair(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {c}?") for c in range(20) for t in (*range(6), None)] + [(None, 1, None, None)]
    src = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in repair.damage(src).fillna(-1, ["conv_id", "turn"]).collect())
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            want += [(-1 if c is None else c, -1 if t is None else t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    assert got == sorted(want)


def test_repaired_turns_read_as_pairs(spark):
    rng = random.Random(8)
    rows = [(c, t, role, text, 1, "x", "y") for c in range(40) for t, (role, text) in enumerate(random_rows(rng, 30))]
    _, turns = repair.repair(spark.createDataFrame(rows, SCHEMA))
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.substring("role", 1, 1).alias("r")))).alias("t"))
    for r in said.collect():
        assert [x.place for x in r.t] == list(range(1, len(r.t) + 1))
        assert GOAL.match("".join(x.r for x in r.t))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf):
    assert difference(repair.op12_conversation_repair(spark, sf), duck(sf), repair.OP12_SQL) is None
