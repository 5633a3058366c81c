"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from structaudit.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, damage):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out, form = {}, {}
    for w, c in words.items():
        by = sorted((-words[x], x) for x in words if near(w, x))
        if by and -by[0][0] >= 5 * c:
            form[w] = by[0][1]
        out[w] = [c, len(by), form.get(w), words.get(form.get(w))]
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def variants(r, word, letters):
    at, kind = r.randrange(len(word)), r.randrange(3)
    return word[:at] + ("", r.choice(letters), r.choice(letters) + word[at])[kind] + word[at + 1 :]


def rows_of(seed, alphabet, n):
    """Documents whose words crowd together, some with large counts."""
    r, rows = random.Random(seed), []
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(5, 9))) for _ in range(n)]
    for i in range(5):
        base += [variants(r, w, alphabet) for w in r.sample(base, len(base) // 2)]
    for i, w in enumerate(base):
        rows.append((i % 50, f"{w.title()} " * r.choice([1, 4, 5, 6, 30, 200, 1500])))
    return rows


def answers(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize(("alphabet", "damage", "most"), [("abé", 3, 2048), ("abé", 0, 3), ("abcdefgh×ÿ", 7, 8)])
def test_equals_all_pairs(documents, alphabet, damage, most):
    rows = rows_of(11, alphabet, 40)
    want = brute(rows, damage)
    assert answers(spelling.spelling_groups(documents(rows), damage, most)) == want
    assert any(v[4] != v[2] for v in want.values() if v[2]) or len(alphabet) > 3


def test_windows_hold_every_pair_once():
    r = random.Random(3)
    for length in (6, 7, 13, 33, 60):
        for _ in range(80):
            a = "".join(r.choice("ab") for _ in range(length))
            b = variants(r, a, "ab")
            if not near(a, b):
                continue
            x, y = sorted((a, b), key=len)
            met = 0
            cuts = spelling.windows(len(x)) if length != 6 else [(i, i + 1) for i in range(len(x))]
            for low, high in cuts:
                (k1, i1), (k2, i2) = spelling.entry(x, len(x), low, high), spelling.entry(y, len(x), low, high)
                if k1 == k2 and i1 != i2:
                    met += sum({p, q} == {i1, i2} for p, q in spelling.accepted([i1, i2], high - low, high == len(x)))
            assert met == 1, (a, b)


def test_acceptor_is_minimal():
    made = spelling.Acceptor()
    start = made.add(["tapping", "topping", "tapped", "topped", "tap", "top"])
    # t, a or o, p, then nothing, ping or ped: equal ends are one state.
    assert len(made.moves) == 9 and made.add(["ing", "ed"]) < len(made.moves) + 2 and start < len(made.moves)
    assert sorted(spelling.accepted(["ab", "cb", "cd", "acb", "cbx"], 2, True)) == [("ab", "acb"), ("ab", "cb"), ("cb", "acb"), ("cb", "cbx"), ("cb", "cd")]
    assert ("cb", "cbx") not in list(spelling.accepted(["cb", "cbx"], 2, False))


def test_odd_texts(documents, nothing):
    word, long = "straße" * 1, "lang" * 2000
    rows = [(1, None), (2, ""), (None, f"{word} " * 5), (3, "Straßen " * 30), (3, "Straßen " * 30), (4, "abcdé " * 9), (5, f"{long} " * 6 + f"{long}x " * 40)]
    got = answers(spelling.spelling_groups(documents(rows), 0))
    assert got == brute([r for r in rows if r[0] != 5], 0) | {long: (6, 1, long + "x", 40, long + "x"), long + "x": (40, 1, None, None, long + "x")}
    assert got["straße"] == (5, 1, "straßen", 60, "straßen")
    assert spelling.spelling_groups(nothing).collect() == []
