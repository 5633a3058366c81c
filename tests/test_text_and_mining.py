import re

import pytest
from pyspark.sql import functions as F

from structaudit.functions import text as tx
from structaudit.operators import fuzzy as fz
from structaudit.operators import mining as mn
from structaudit.operators import resolve as rs

PAGE = """Aspirin (acetylsalicylic acid)
IUPAC name: 2-acetyloxybenzoic acid
MW 180.16 Molecular formula C9H8O4
made from salicylic acid and acetic anhydride, pH 7
(Aspirin) "caffeine" [DMSO] (R)-limonene
vitamin C, Vitamins B12, 비타민 D 와 비타민C는 아스피린은"""

ALIASES = [
    ("아스피린", "aspirin", False), ("살리실산", "salicylic acid", False), ("포도당", "glucose", False),
    ("비스페놀A", "bisphenol A", False), ("베타카로틴", "beta-carotene", False), ("물", "water", True),
]


def alias_table(spark):
    rows = [(a, t, w, i) for i, (a, t, w) in enumerate(ALIASES)]
    return spark.createDataFrame(rows, "alias string, target string, whole_only boolean, ord int").withColumn(
        "alias_key", tx.ko_key(F.col("alias"))
    )


def test_spelling_variants(evaluated):
    cases = {
        "β-carotene": ["β-carotene", "beta-carotene"], "DCM": ["DCM", "dichloromethane"], "IPA": ["IPA"], "DA": ["DA"],
        "(methylsulfinyl)methane": ["(methylsulfinyl)methane"], "  two   words ": ["two words"],
        "(R)-(+)-limonene": ["(R)-(+)-limonene", "limonene"], "acid–base": ["acid–base", "acid-base"],
    }
    got = evaluated([(n,) for n in cases], "n string", v=tx.spelling_variants(F.col("n")))
    assert [g["v"] for g in got] == list(cases.values())


def test_normal_forms(evaluated):
    got = evaluated(
        [("  ＤＭＳＯ－x ",), ("N–Methyl  Amine",)], "s string",
        exact=tx.normalize_exact(F.col("s")), full=tx.normalize_exact(F.col("s"), full=True), loose=tx.normalize_loose(F.col("s")),
    )
    assert got[0]["full"] == "dmso-x" and got[1]["exact"] == "n-methyl amine" and got[1]["loose"] == "nmethylamine"


def test_clean_token(evaluated):
    cases = {
        "Aspirin)": "Aspirin", "(Aspirin)": "Aspirin", "Fe(III)": "Fe(III)", "((a)b)": "(a)b", "[(ab)],": "ab", "(a)(b)": "a)(b",
        "x": None, "12": None, "β-x": "beta-x", "'ab'": "ab", "(ab": "ab", "))": None,
    }
    got = evaluated([(t,) for t in cases], "t string", c=tx.clean_token(F.col("t")))
    assert [g["c"] for g in got] == list(cases.values())


def test_plain_lines_give_the_same_tokens(evaluated):
    lines = ["a, bc' 12,3 d-e- 4'x, f+ 'gh,' 1-2 -zz x,y,", "it's 3-methyl'", "", "A 5b, 6, c7"]
    slow = F.array_compact(F.transform(F.regexp_extract_all("s", F.lit(tx.TOKEN), F.lit(0)), tx.clean_token))
    got = evaluated([(x,) for x in lines], "s string", fast=tx.clean_tokens(F.col("s")), slow=slow)
    assert all(g["fast"] == g["slow"] for g in got)
    assert got[0]["fast"] == ["bc", "d-e-", "4'x", "f+", "gh", "zz", "x,y"]


def test_scores(evaluated):
    cases = {
        "salicylic acid": 4.0, "acid": -1.0, "mw 180": -1.0, "C9H8O4": -1.0, "vitamin C": 4.0, "Caffeine": 4.5, "DMSO": 1.0,
        "(S)-ibuprofen": 2.5, "2-methylbutane": 7.5, "hello": -1.0, "benzoic acid ester": 6.5, "structure acid": -1.0, "Water": 1.5,
        "vitamin c": 4.0, "Vitamins k": 4.0, "one two three four butanol": 5.0, "one two three four": -1.0, "": -1.0,
    }
    got = evaluated([(p,) for p in cases], "p string", s=tx.candidate_score(F.col("p")))
    assert {p: g["s"] for p, g in zip(cases, got)} == cases


def test_candidates_of_a_page(spark):
    docs = spark.createDataFrame([(1, PAGE)], "doc int, text string")
    found = mn.candidates(docs, ["doc"], "text", alias_df=alias_table(spark)).orderBy(F.desc("score"), "pos").collect()
    phrases = [r.phrase.lower() for r in found]
    assert phrases[0] == "aspirin" and found[0].score == 100.0
    assert {"aspirin", "salicylic acid", "2-acetyloxybenzoic acid", "vitamin c", "vitamin d"} <= set(phrases[:25])
    assert not {"mw 180", "180 16", "molecular formula", "c9h8o4", "iupac name"} & set(phrases)
    assert phrases.count("aspirin") == 1
    # The particle glued to the letter makes it no vitamin of its own line position.
    assert [r for r in found if r.phrase == "vitamin C"][0].pos.source == 0


def test_page_in_parts_equals_whole_page(spark):
    whole = spark.createDataFrame([(1, PAGE)], "doc int, text string")
    rows = [(1, i, line) for i, line in enumerate(PAGE.split("\n"))]
    parts = spark.createDataFrame(rows, "doc int, part int, text string")
    order = lambda df: [(r.phrase, r.score) for r in df.orderBy(F.desc("score"), "pos").collect()]
    assert order(mn.candidates(whole, ["doc"], "text")) == order(mn.candidates(parts, ["doc"], "text", part="part"))


def test_alias_lookup(spark):
    queries = ["아스피린은", "살리실산의", "포도당으로", "해열진통제", "비스페놀 A", "β-카로틴", "비타민 C", "물"]
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    whole = {r.query: r.target for r in rs.alias_lookup(asked, alias_table(spark)).collect()}
    assert whole == {
        "아스피린은": "aspirin", "살리실산의": "salicylic acid", "포도당으로": "glucose", "비스페놀 A": "bisphenol A",
        "β-카로틴": "beta-carotene", "비타민 C": "vitamin C", "물": "water",
    }
    assert "물" not in {r.query for r in rs.alias_lookup(asked, alias_table(spark), in_text=True).collect()}


def test_korean_key_variants(evaluated):
    got = evaluated([("비스페놀A",), ("tert-부탄올",), ("벤젠",)], "a string", v=tx.korean_key_variants(F.col("a")))
    assert got[0]["v"] == ["비스페놀A", "비스페놀 A", "비스페놀Ａ", "비스페놀 Ａ"]
    assert got[1]["v"][:2] == ["tert-부탄올", "tert부탄올"] and got[2]["v"] == ["벤젠"]


def dictionary(spark):
    rows = [("aspirin", "BSYNRYMUTXBXSQ-UHFFFAOYSA-N", "CC", "Aspirin", 1), ("caffeine", "RYYVLZVUVIJVGH-UHFFFAOYSA-N", "CN", "Caffeine", 2),
            ("ethanol", "LFQSCWFLJHTTHZ-UHFFFAOYSA-N", "CCO", "Ethanol", 3), ("limonene", "XMGQYMWWDOXHJM-UHFFFAOYSA-N", "CCC", "Limonene", 4)]
    return spark.createDataFrame(rows, "name_key string, inchikey string, smiles string, title string, ord int")


def test_cached_negative_blocks_only_its_spelling(spark):
    cache = spark.createDataFrame(
        [("(r)-limonene", None, None), ("caffeine", None, None), ("ethanol", "OLDKEYOLDKEYOL-UHFFFAOYSA-N", "")],
        "name_key string, inchikey string, smiles string",
    )
    asked = spark.createDataFrame([("(R)-limonene",), ("Caffeine",), ("ethanol",)], "query string")
    got = {r.query: (r.matched_name, r.source) for r in rs.resolve(asked, dictionary(spark), cache).collect()}
    assert got == {"(R)-limonene": ("limonene", "offline"), "ethanol": ("ethanol", "offline")}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_names_lose_nothing(spark):
    import random

    rng = random.Random(7)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(150)}
    names = set(list(words)[:60])
    strings = spark.createDataFrame([(w,) for w in words], "norm string")
    stored = spark.createDataFrame([(w,) for w in names], "name_norm string")
    got = {(r.norm, r.name_norm, r.distance) for r in fz.near_names(strings, stored, 0.22).collect()}
    want = {(a, b, edit_distance(a, b)) for a in words for b in names if edit_distance(a, b) / max(len(a), len(b)) <= 0.22}
    assert got == want and len(got) > len(names)


def test_suggest(spark):
    titles = spark.createDataFrame([("Caffeine", 1), ("Cafeine", 2), ("Codeine", 3), ("Water", 4)], "title string, ord int")
    asked = spark.createDataFrame([("Coffeine",), ("caffeine",)], "query string")
    got = [(r.query, r.title, r.distance) for r in fz.suggest(asked, titles).orderBy("query", "rank").collect()]
    assert got[:3] == [("Coffeine", "Caffeine", 1), ("Coffeine", "Cafeine", 2), ("Coffeine", "Codeine", 2)]
    assert ("caffeine", "Caffeine", 0) not in got and ("caffeine", "Cafeine", 1) in got


def test_fuzzy_labels_keep_first_candidate_of_a_title(spark):
    docs = spark.createDataFrame([(1, "Coffeine 2D\nEthanoll (Ethanol)\nno match at all here")], "id int, text string")
    cands = mn.label_text_candidates(docs, ["id"], "text")
    got = [(r.title, r.distance) for r in fz.fuzzy_labels(cands, ["id"], dictionary(spark)).orderBy("rank").collect()]
    assert ("Caffeine", 1) in got and {t for t, _ in got} == {"Caffeine", "Ethanol"}


def test_fixed_vocabularies_are_regex_safe():
    for words in (tx.SUFFIXES, tx.FRAGMENTS):
        assert all(re.fullmatch("[a-z]+", w) for w in words)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefghij"])
def test_suggest_equals_all_pairs(spark, letters):
    import random

    r = random.Random(5)
    word = lambda low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    titles = [(word(1, 12), i) for i in range(120)]
    titles += [(t[:-1] + r.choice(letters), 500 + i) for i, (t, _) in enumerate(titles[:40])]
    asked = [word(1, 14) for _ in range(60)] + [t for t, _ in titles[:10]]
    got = {}
    found = fz.suggest(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame(titles, "title string, ord bigint"), 4)
    for row in found.collect():
        got.setdefault(row["query"], {})[row["rank"]] = (row["distance"], row["ord"], row["title"])
    first = {}
    for t, o in titles:
        first[t] = min(o, first.get(t, o))
    for q in set(asked):
        reach = max(3, -(-len(q) // 2))
        want = sorted((_distance(q, t), o, t) for t, o in first.items())
        want = [w for w in want if 0 < w[0] <= reach][:4]
        assert [got.get(q, {})[i + 1] for i in range(len(got.get(q, {})))] == want, q


def test_rings_propose_few_pairs(spark):
    """Against a join on the length the first ring proposes next to nothing, and the widest one only what shares a piece."""
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(8, 14)))
    norms = [(word(),) for _ in range(1500)]
    asked = [n[:4] + "q" + n[5:] for (n,) in norms[:300]] + [word() for _ in range(20)]
    table = spark.createDataFrame(norms, "title_norm string")
    pairs = {}
    for radius in (1, 3):
        ring = spark.createDataFrame([(q, radius) for q in set(asked)], "q string, reach int")
        pairs[radius] = fz.ring_candidates(ring, table).count()
    by_length = sum(abs(len(q) - len(n)) <= -(-len(q) // 2) for q in set(asked) for (n,) in norms)
    assert 300 <= pairs[1] < by_length / 500 and pairs[3] < by_length / 10
