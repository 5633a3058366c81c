"""Conversation repair against an enumeration of all edits."""

import hashlib
import itertools
import re
import zlib

import pytest

from structaudit.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cut int, `at` string, several boolean"


@pytest.fixture
def talk(spark):
    return lambda rows: spark.createDataFrame([(*r, 5, "x", True) for r in rows], SCHEMA)


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, text) of rows that are in order, by trying all edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    front = {"": {(0, "", ())}}
    # Partial repairs by what they read so far; those that no word of the grammar begins with go.
    begins = re.compile(r"(s?(ua)*u?)?$")
    found = {(0, "", ())}
    for at in range(len(rows) + 1):
        grown = set()
        for cost, audit, out in found:
            for ins in inserts:
                grown.add((cost + 2 * len(ins), audit + "I" * len(ins), (*out, *[(r, "") for r in ins])))
        if at < len(rows):
            _, role, text = rows[at]
            more = 1 if faults[at] == "t" else 0
            found = set()
            for cost, audit, out in grown:
                found.add((cost + 3, audit + "D", out))
                if faults[at] not in "bd":
                    found.add((cost + more, audit + "K", (*out, (role, text))))
                    for r in ("user", "assistant"):
                        found.add((cost + 2 + more, audit + "R", (*out, (r, text))))
        else:
            found = grown
        found = {f for f in found if begins.match("".join(r[:1] or "-" for r, _ in f[2]))}
        cheapest = min(f[0] for f in found)
        found = {f for f in found if f[0] <= cheapest + 8}
    whole = re.compile(r"(s?(ua)+)?$")
    cost, audit, out = min((f for f in found if whole.match("".join(r[:1] or "-" for r, _ in f[2]))), key=lambda f: f[:2])
    said = "\n".join(f"{r}:{t}" for r, t in out)
    counts = [faults.count(f) for f in "bdt"]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


CASES = [
    [], [(0, "user", "Hi."), (1, "assistant", "Yes.")], [(0, "system", "S."), (1, "user", "Hi."), (2, "assistant", "No")],
    [(0, "assistant", "A.")], [(0, "user", "U.")], [(3, "user", " \t"), (5, "user", "a?"), (6, "user", "a?")],
    [(0, "user", "a."), (1, "system", "b."), (2, "assistant", "c."), (9, "tool", "d!")],
    [(None, "user", "x"), (None, "user", "x"), (2, " ", "y."), (4, "", "z.")],
    [(0, "system", "s."), (1, "system", "s2."), (2, "system", "s3.")],
    [(0, "user", "1."), (1, "user", "2."), (2, "user", "3."), (3, "assistant", "4."), (4, "assistant", "5")],
]


def random_cases(n, longest):
    import random

    r = random.Random(7)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool"], ["a.", "b!", "c", "", " \n", "d e?", "a."]
    return [
        [(r.choice([None, *range(9)]) if r.random() < 0.1 else i // r.choice([1, 1, 2]), r.choice(roles), r.choice(texts)) for i in range(r.randint(1, longest))]
        for _ in range(n)
    ]


@pytest.mark.parametrize("cut", [1, 3, 4096])
def test_equals_all_edits(talk, cut):
    cases = CASES + random_cases(60, 5)
    rows = [(i, *row) for i, case in enumerate(cases) for row in case]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_conversations(talk(rows), cut).collect()}
    assert got == {i: brute(ordered(case)) for i, case in enumerate(cases) if case}


def test_long_conversation_is_the_same_in_cuts(talk):
    rows = [(1, *r) for r in [(i, role, f"{i % 37}{'.' if i % 5 else ''}") for i, role in enumerate(["user", "user", "assistant", "system", "assistant"] * 60)]]
    one, many = (repair.repair_conversations(talk(rows), cut).collect() for cut in (4096, 7))
    assert one == many and one[0]["cost"] > 100


def test_damage(talk):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "A. b"), ("user", "One! Two?"), ("assistant", "Yes."), (None, None)])]
    want = []
    for c, t, r, x in rows:
        r, x, k = r or " ", x if x is not None else " ", zlib.crc32(f"{c}:{t}".encode()) % 20
        new = {1: (r, ""), 2: (r, re.sub("[.!?]", "", x)), 4: ("user", x)}.get(k, (r, x))
        want += [] if k == 0 else [(c, t, *new)] * (2 if k == 3 else 1)
    got = [tuple(r) for r in repair.damaged(talk(rows)).collect()]
    assert sorted(got) == sorted(want)
    kinds = {zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, _, _ in rows}
    assert kinds >= {0, 1, 2, 3, 4}


def test_odd_rows(talk):
    lost, same = (next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == k) for k in (0, 9))
    rows = [(lost, 0, "user", "gone."), (None, None, None, None), (None, 3, "user", "x" * 200_000), (same, 0, "user", "tie."), (same, 0, "user", "tie.")]
    got = {r["conv_id"]: r for r in repair.repaired_after_damage(talk(rows)).collect()}
    assert set(got) == {lost, None, same}
    empty = got[lost]
    assert tuple(empty)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[None]["blank"] == 1 and got[same]["duplicate"] == 1
    assert repair.repaired_after_damage(talk([])).collect() == []
