"""Repairs against a search over all edits, and the streams against plain loops."""

import hashlib
import itertools
import random
import zlib

import pytest

from regolith.llm import conversation_repair as cr
from regolith.llm import queries

ACCEPTED = {"u": "user", "a": "assistant"}


def every_repair(initials, gone, cut, most):
    """(cost, audit) of all edit sequences with up to `most` inserts in a row."""
    def go(i, roles):
        if i == len(initials):
            yield 0, "", roles
        else:
            yield from ((c + 2, "D" + a, r) for c, a, r in go(i + 1, roles))
            if not gone[i]:
                stays = 5 if cut[i] else 0
                yield from ((c + stays, "K" + a, r) for c, a, r in go(i + 1, roles + initials[i]))
                for to in "ua":
                    yield from ((c + stays + 1, "R" + a, r) for c, a, r in go(i + 1, roles + to))

    def inserted(roles, audit):
        """All ways to put up to `most` inserts at each place between the edits."""
        kept = iter(roles)
        parts = [(e, next(kept) if e != "D" else "") for e in audit]
        fills = ["".join(f) for k in range(most + 1) for f in itertools.product("ua", repeat=k)]
        for choice in itertools.product(fills, repeat=len(parts) + 1):
            yield sum(map(len, choice)), "".join("I" * len(c) + e for c, (e, _) in zip(choice, [*parts, ("", "")])), "".join(c + r for c, (_, r) in zip(choice, [*parts, ("", "")]))

    import re

    for c, a, roles in go(0, ""):
        for n, audit, all_roles in inserted(roles, a):
            if re.fullmatch("(s?(ua)+)?", all_roles):
                yield c + 5 * n, audit


def test_cheapest_and_least_audit_of_all():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randint(0, 3)
        initials = [rng.choice("suax") for _ in range(n)]
        gone = [rng.random() < 0.2 for _ in initials]
        cut = [not g and rng.random() < 0.3 for g in gone]
        assert cr.repair_cost(initials, gone, cut) == min(every_repair(initials, gone, cut, 2)), (initials, gone, cut)


def test_long_conversations_take_linear_time():
    n = 200_000
    cost, audit = cr.repair_cost("ua" * (n // 2), [False] * n, [False] * n)
    assert cost == 0 and audit == "K" * n
    assert cr.repair_cost("u" * 1000, [False] * 1000, [False] * 1000) == (500, "KR" * 500)


CONVERSATIONS = {
    1: [(0, "system", "Be kind."), (1, "user", "Hello?"), (2, "assistant", "Yes.")],
    2: [(0, "user", "a."), (0, "user", "a."), (0, "assistant", "b!"), (5, None, None), (None, "tool", "x"), (None, "assistant", "\t\x0b")],
    3: [(3, "assistant", "unfinished"), (9, "assistant", "done.")],
    4: [(0, "user", ""), (1, "user", " \n")],
    5: [(0, "user", "long " * 200_000 + "."), (1, "assistant", "é漢🙂\0.")],
    6: [(-3, "user", "same."), (4, "assistant", "x."), (4, "user", "same."), (5, "user", "same.")],
    None: [(1, "user", "no id."), (None, "user", "no turn.")],
}


def frame(spark, conversations):
    rows = [(c, *r, "further", 7, "mine") for c, rows in conversations.items() for r in rows]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, copies_ int, digest string").repartition(3)


def plain(rows):
    """The figures of one conversation, by plain loops and a DP over whole strings."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    blank, duplicate, truncated, seen = [], [], [], set()
    for _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        blank.append(not kept)
        duplicate.append(bool(kept) and (role, text) in seen)
        truncated.append(bool(kept) and not duplicate[-1] and kept[-1] not in ".!?")
        seen.add((role, text))
    best = {"": (0, "", ())}
    following = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way
            for r in following[state].replace("s", ""):
                put(into, r, (way[0] + 5, way[1] + "I", (*way[2], ACCEPTED[r] + ":")))

    best = {}
    put(best, "", (0, "", ()))
    for (_, role, text), b, d, cut in zip(rows, blank, duplicate, truncated):
        after = {}
        for state, (c, a, t) in best.items():
            put(after, state, (c + 2, a + "D", t))
            if b or d:
                continue
            if role[:1] in list(following[state]):
                put(after, role[0], (c + 5 * cut, a + "K", (*t, f"{role}:{text}")))
            for r in following[state].replace("s", ""):
                put(after, r, (c + 5 * cut + 1, a + "R", (*t, f"{ACCEPTED[r]}:{text}")))
        best = after
    cost, audit, told = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    turns = {t for t, _, _ in rows} - {None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, sum(blank), sum(duplicate), sum(truncated), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest(), told


def damaged(conv, rows):
    out = []
    for t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
        if fate == 1:
            x = ""
        if fate == 2:
            x = x.translate(dict.fromkeys(map(ord, ".!?")))
        out += [(t, "user" if fate == 4 else r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def figures(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_figures_and_turns_of_odd_conversations(spark):
    rows = frame(spark, CONVERSATIONS)
    found = cr.audits(rows)
    want = {c: plain(r) for c, r in CONVERSATIONS.items()}
    assert figures(cr.with_digests(rows, found)) == {c: w[:-1] for c, w in want.items()}
    turns = {}
    for r in sorted(cr.repaired(rows, found).collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert turns == {c: list(w[-1]) for c, w in want.items() if w[-1]}
    assert want[4][6] == "DD" and want[1][6] == "KKK"


def test_random_conversations_after_damage(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", "Why?", "one. two", " "]
    told = {c: [(rng.randint(0, 6), rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(texts)) for _ in range(rng.randint(1, 9))] for c in range(400)}
    rows = cr.damaged(frame(spark, told))
    got = figures(cr.with_digests(rows, cr.audits(rows)))
    assert got == {c: plain(damaged(c, r))[:-1] for c, r in told.items()}
    assert any(not damaged(c, r) for c, r in told.items())  # conversations without rows are there


def test_no_conversations(spark):
    rows = cr.damaged(frame(spark, CONVERSATIONS).limit(0))
    found = cr.audits(rows)
    assert cr.with_digests(rows, found).collect() == [] and cr.repaired(rows, found).collect() == []


@pytest.mark.parametrize("name", ["op11_conversation_repair"])
def test_registered_query_is_that_of_plain_loops(spark, sf, name):
    told = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        told.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert figures(queries.QUERIES[name](spark, sf)) == {c: plain(damaged(c, r))[:-1] for c, r in told.items()}
