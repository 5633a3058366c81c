"""Texts are mined once for a page's references, and in one pass."""

import random

from pyspark.sql import functions as F

from structaudit.functions import text as tx
from structaudit.operators import mining as mn
from structaudit.plans import decks


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_references_read_the_mined_texts_from_files(spark):
    docs = spark.createDataFrame([(1, "Toluamine and\nbenzamine of toluamine"), (2, "no name")], "doc_id long, text string")
    names = spark.createDataFrame([("toluamine", "A"), ("benzamine", "B")], "name_key string, inchikey string")
    refs = mn.page_references(mn.candidates(docs, ["doc_id"], "text"), ["doc_id"], names)
    mined = mn.candidates(docs, ["doc_id"], "text")
    assert tx.PLAIN_TOKEN in optimized(mined) and tx.PLAIN_TOKEN not in optimized(refs)
    assert sorted(map(tuple, refs.collect())) == [(1, "A", "Toluamine", 0), (1, "B", "benzamine", 1)]


def test_words_and_vitamins_come_from_one_pass_over_the_text(spark):
    text = "비타민 B12 and vitamin c, vitamins d\rVitamin a of 2-methyl propanol\x85α-vitamin e\r\n\nαmino ωdole b"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = mn.candidates(docs, ["doc_id"], "text")
    assert optimized(found).count("split(") == 1
    got = {r.phrase: (r.score, r.pos.line_no, r.pos.source, r.pos.words, r.pos.start) for r in found.collect()}
    vitamins = {p: v for p, v in got.items() if v[2] == 0}
    assert vitamins == {
        "vitamin B12": (4.0, 0, 0, 0, 0), "vitamin C": (4.0, 0, 0, 0, 1), "vitamin D": (4.0, 0, 0, 0, 2), "vitamin E": (4.0, 2, 0, 0, 0)
    }
    assert got["2-methyl propanol"][:2] == (8.0, 1) and got["alphamino omegadole"][:2] == (3.0, 4)


def test_ordinary_words_are_told_as_the_whole_test_tells_them(spark):
    rng = random.Random(3)
    parts = ["a", "k", "the", "er", "ndi", "x", "'", "-", "2", ",", "A", "α", *tx.SUFFIXES, *tx.BARE, *tx.FRAGMENTS, *tx.VITAMINS, *tx.NOISE]
    words = [*tx.STOPWORDS, *parts, *("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(3000)), "abs\n", "abs\x85", ""]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    fast, whole = tx.word_flags(F.col("w")), tx._graded_flags(F.col("w"))
    assert df.where(fast == 0).count() > 99 and not df.where(~fast.eqNullSafe(whole)).count()
    lines = spark.createDataFrame([(" ".join(rng.choices(words, k=6)),) for _ in range(2000)], "line string")
    told = F.transform(tx.clean_tokens(F.col("line")), lambda w: tx.word_flags_in_line(w, tx.may_hold_fragment(F.col("line"))))
    assert not lines.where(told != F.transform(tx.clean_tokens(F.col("line")), tx._graded_flags)).count()
    old = r"(?=[0-9\-,'+]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9\-,'+]*[A-Za-z0-9\-+]"
    tokens = [F.regexp_extract_all("line", F.lit(p), F.lit(0)) for p in (tx.PLAIN_TOKEN, old)]
    assert not lines.where(tokens[0] != tokens[1]).count()


def test_ends_and_spellings_are_those_of_the_whole_patterns(spark):
    rng = random.Random(5)
    parts = [" ", "\t", "\n", "　", " ", "\x85", "\x1c", "-", "–", "a", "B", "α", "(R)", "cis-", "D-", "acn", "DCM", "x1", ",", "'", "~", "가"]
    words = [*("".join(rng.choices(parts, k=rng.randrange(6))) for _ in range(4000)), "acn", "ACN", " acn", "a b", "a  b", "propan ol", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    whole = F.regexp_replace("w", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    assert not df.where(~tx.strip(F.col("w")).eqNullSafe(whole)).count()
    assert not df.where(~tx.spelling_variants(F.col("w")).eqNullSafe(tx._spellings(F.col("w")))).count()
    assert [r[0] for r in df.where("w = 'ACN' or w = 'propan ol'").select(tx.spelling_variants(F.col("w"))).collect()] == [["ACN", "acetonitrile"], ["propan ol"]]


def test_captions_are_made_once_for_references_and_page_facts(spark):
    sf = "/root/testdata/sf0.001"
    texts = decks.page_text(decks.elements(spark, sf))
    assert "l_orderkey" not in optimized(texts) and "o_orderkey" not in optimized(texts)
    orders, items, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem", "documents"))
    named = orders.join(items, orders.o_orderkey == items.l_orderkey, "left_semi").count()
    assert texts.where("part = 0").count() == docs.count() and texts.where("part > 0").count() == named
