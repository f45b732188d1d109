"""Conversation repair against plain search over edits, row by row and exhaustively."""

import hashlib
import random
import zlib

import pytest

from helixscan.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\v\f\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def judged(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        told = text.rstrip(WHITE)
        fault = "blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def choices(row, state):
    """Letter, cost, next state and line of what may be done with a row, or ``None`` for an insertion."""
    role, text, fault = row
    yield "D", 4, state, None
    if fault in ("blank", "duplicate"):
        return
    more = 3 * (fault == "truncated")
    if role[:1] in NEXT[state]:
        yield "K", more, role[:1], f"{role}:{text}"
    for name in ("user", "assistant"):
        if name[0] in NEXT[state]:
            yield "R", 3 + more, name[0], f"{name}:{text}"


def inserts(state):
    for name in ("user", "assistant"):
        if name[0] in NEXT[state]:
            yield name[0], f"{name}:"


def least(rows):
    now = {"": (0, "", ())}
    for row in [*rows, None]:
        for _ in range(2):
            for state, (cost, audit, lines) in list(now.items()):
                for new, line in inserts(state):
                    now[new] = min(now.get(new, (10**9,)), (cost + 3, audit + "I", (*lines, line)))
        if row is None:
            break
        after = {}
        for state, (cost, audit, lines) in now.items():
            for letter, x, new, line in choices(row, state):
                found = (cost + x, audit + letter, lines if line is None else (*lines, line))
                after[new] = min(after.get(new, (10**9,)), found)
        now = after
    return min(now[s] for s in ("", "a") if s in now)


def every(rows, most):
    """All repairs that cost ``most`` at most, insertions in any place."""

    def go(i, state, cost, audit, lines):
        if cost > most:
            return
        if i == len(rows) and state in ("", "a"):
            yield cost, audit, lines
        for new, line in inserts(state):
            yield from go(i, new, cost + 3, audit + "I", (*lines, line))
        if i < len(rows):
            for letter, x, new, line in choices(rows[i], state):
                yield from go(i + 1, new, cost + x, audit + letter, lines if line is None else (*lines, line))

    return go(0, "", 0, "", ())


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = after_damage([r for r in rows if r[0] == conv])
        faults = judged(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, lines = least(faults)
        kinds = [f for _, _, f in faults]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions).selectExpr("*", "1 AS symbols", "2 AS Cost", "3 AS `a``b`", "4 AS digest")
    found = c.repaired(df).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def made(g, conv, n, null=0.05):
    texts = ["Yes.", "no", "Why?  ", "", " \t", "a!\nb", "ok.", "x" * 3000 + "."]
    return [(conv, None if g.random() < null else g.randrange(n + 2), None if g.random() < null else g.choice(["user", "assistant", "system", "tool", "sys", "ux", "", "user", "assistant"]), None if g.random() < null else g.choice(texts) + (str(g.randrange(40)) + g.choice([".", "", "?"])) * (g.random() < 0.8)) for _ in range(n)]


def test_repairs_are_the_cheapest(spark):
    g = random.Random(3)
    rows = [r for conv in [None, *range(150)] for r in made(g, conv, g.randrange(1, 9))]
    rows += [(900, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(30)] + [(901, 5, "user", "same.")] * 7 + [(902, None, "user", "Hi.")] * 2
    rows += [(1000 + k, t, "user", None) for k in range(40) for t in range(1)]  # some have no rows left
    assert got(spark, rows) == want(rows)


def test_long_conversations_in_small_segments(spark, monkeypatch):
    monkeypatch.setattr(c, "SEGMENT", 5)
    g = random.Random(8)
    rows = [r for conv in range(6) for r in made(g, conv, 60)] + [r for conv in range(10, 20) for r in made(g, conv, 3)] + [(50, 1, "user", "Hot.")] * 300
    assert got(spark, rows) == want(rows)


def test_plain_search_is_exhaustive():
    g = random.Random(1)
    for _ in range(40):
        faults = judged(after_damage(made(g, g.randrange(99), g.randrange(0, 4))))
        found = least(faults)
        assert found == min(every(faults, found[0]))


def test_matrices_of_rules_are_those_of_their_symbols():
    rules = ["ua", "ĀĀ", "xU", "āĂ"]
    table = c.matrices(rules)
    for rule, text in (("ā", "uaua"), ("ă", "uauaxU")):
        for p in range(4):
            ends = c.reached(text, p, table)
            assert {q: e for q, e in enumerate(ends) if e} == {q: (x, str(r)) for (a, q), (x, r) in table[rule].items() if a == p}
    assert c.compressed("uauauaxU", rules) == "āĀĂ"


def test_rules_come_from_all_segments(spark, monkeypatch):
    df = spark.createDataFrame([("uaua",)] * 50 + [("sux",)] * 3 + [("OAx",)], "symbols string").repartition(4)
    counts = c.pair_counts(df, [])
    assert counts == {"ua": 100, "au": 50, "su": 3, "ux": 3, "OA": 1, "Ax": 1}
    assert c.pair_counts(spark.createDataFrame([("xxxxx",)], "symbols string"), []) == {"xx": 2}
    rules = c.repaired_pairs(df)
    assert rules[0] == "ua" and "ĀĀ" in rules
    assert len(rules) <= c.ROUNDS * c.RULES


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "a.")], [(None, None, None, None)]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == want(rows)
