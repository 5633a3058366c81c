import itertools
import math

import pytest
from pyspark.sql import functions as F

from structaudit.operators import adjudicate as ad
from structaudit.operators import agreement as ag
from structaudit.operators import evaluate as ev
from structaudit.operators import labels as lb

READS = "item_id int, read_no int, engine string, inchikey string, confidence double"
A, A2, B, C = (f"{s * 14}-{t * 8}SA-N" for s, t in (("A", "X"), ("A", "Y"), ("B", "X"), ("C", "X")))


def reads(spark, per_item):
    rows = [(i, n, *r) for i, rs in per_item.items() for n, r in enumerate(rs)]
    return spark.createDataFrame(rows, READS)


def refs(spark, per_item):
    rows = [(i, n, f"name{n}", key) for i, keys in per_item.items() for n, key in enumerate(keys)]
    return spark.createDataFrame(rows, "item_id int, ref_no int, name string, inchikey string")


def test_name_first_rules(spark):
    shown = reads(spark, {
        1: [("one", B, 0.9)], 2: [("one", B, 0.9), ("two", B, None)], 3: [("one", B, 0.9), ("two", C, None)],
        4: [("one", B, 0.9), ("two", A, None)], 5: [("one/x1", A, 0.9), ("one/x0.9", B, 0.95)], 6: [("one", None, 0.9)],
        7: [("one", A2, 0.9)], 8: [("one", A, 0.5), ("two", None, 0.79)], 9: [("one", A, math.nan)], 11: [("one", A, 0.9)],
        12: [("one", B, 0.9)], 13: [("one", A2, None), ("two", A, None)],
    })
    named = refs(spark, {**{i: [A] for i in range(1, 11)}, 12: [A, B], 13: [A]})
    got = {r.item_id: (r.verdict, r.grade, r.reason) for r in ad.judge_name_first(named, shown).collect()}
    assert got == {
        1: ("error", "weak", "single_family_other"), 2: ("error", "strong", "agreed_other"), 3: ("error", "weak", "families_disagree"),
        4: ("ok", None, "exact"), 5: ("abstain", None, "self_inconsistent"), 6: ("abstain", None, "unparseable"),
        7: ("warn", None, "skeleton"), 8: ("abstain", None, "low_confidence"), 9: ("ok", None, "exact"),
        10: ("abstain", None, "no_engine"), 11: ("abstain", None, "no_name"), 12: ("ok", None, "exact"), 13: ("ok", None, "exact"),
    }


def test_short_keys_share_the_missing_skeleton(spark):
    got = ad.judge_name_first(refs(spark, {1: ["ABC"]}), reads(spark, {1: [("one", "XYZ", 0.9)]})).first()
    assert got.verdict == "warn"


def test_naive_judge(spark):
    shown = reads(spark, {1: [("one", A2, 0.1)], 2: [("one", A, 0.1), ("two", B, 1.0)], 3: [("one", None, None)]})
    got = {r.item_id: r.verdict for r in ad.judge_naive(refs(spark, {i: [A] for i in (1, 2, 3, 4)}), shown).collect()}
    assert got == {1: "error", 2: "ok", 3: "abstain", 4: "abstain"}


def test_recognition_status(spark):
    shown = reads(spark, {
        1: [("one", A, 0.5), ("two", A2, None)], 2: [("one", A, 0.5)], 3: [("one", A, 0.5), ("two", B, 0.5)], 4: [("one", None, None)],
        5: [("one/a", A, 0.5), ("one/b", A, 0.6)],
    })
    items = spark.createDataFrame([(i, i != 7, i != 8) for i in range(1, 9)], "item_id int, has_engine boolean, image_ok boolean")
    got = {r.item_id: r for r in ag.recognition_status(shown, items).collect()}
    assert [got[i].status for i in range(1, 9)] == [
        "agreed", "single", "uncertain", "no_result", "single", "no_result", "no_engine", "unreadable"
    ]
    assert got[1].answer_key == A and got[1].stereo_differs and got[2].answer_key is None


def test_candidate_ranking(spark):
    shown = reads(spark, {1: [("one", C, 0.99), ("two", B, 0.2), ("three", B, None), ("one/x", A, None)]})
    ranked = ag.agreement(shown).orderBy("rank").collect()
    assert [(r.inchikey, r.n_families) for r in ranked] == [(B, 2), (C, 1), (A, 1)]
    contrasts = ag.candidate_contrasts(ag.agreement(shown)).orderBy("rank").collect()
    assert [(r.leader_key, r.inchikey) for r in contrasts] == [(B, C), (B, A)]


# Stored readings of 50 items by two readers: the scored reader's scores and who misread what.
SCORES = [
    .87, .68, .72, .88, .92, .80, .88, .84, .89, .90, .90, .89, .80, .70, .87, .81, .90, .91, .85, .90, .84, .83, .74, .81, .89,
    .90, .84, .88, .91, .87, .89, .90, .92, .90, .89, .85, .91, .83, .90, .80, .85, .89, .86, .89, .90, .90, .85, .75, .88, .88,
]
SCORED_MISREADS, UNSCORED_MISREADS = {2, 6, 13, 14}, {9, 46}


def letters(n):
    return "".join(chr(65 + (n // 26**i) % 26) for i in range(3)).ljust(14, "Q")


@pytest.fixture(scope="module")
def stored(spark):
    key = lambda n: f"{letters(n)}-UHFFFAOYSA-N"
    rows, items = [], []
    for i, score in enumerate(SCORES, start=1):
        items.append((i, f"item {i}", ev.VARIANTS[(i - 1) % 8], key(i)))
        rows.append((i, 0, "scored@local", key(i + (1000 if i in SCORED_MISREADS else 0)), score))
        rows.append((i, 1, "unscored", key(i + (2000 if i in UNSCORED_MISREADS else 0)), None))
    return (spark.createDataFrame(rows, READS).cache(),
            spark.createDataFrame(items, "item_id int, name string, variant string, inchikey string").cache())


def test_policies_on_stored_readings(stored):
    shown, items = stored
    named = items.select("item_id", F.lit(0).alias("ref_no"), "name", "inchikey")
    outcomes = ev.evaluate(shown, items, {**ad.POLICIES, "name_first": ad.name_first_policy(named)})
    cards = {r.arm: (r.correct, r.confident_wrong, r.declined) for r in ev.card(outcomes).collect()}
    assert cards == {"consensus": (44, 0, 6), "confidence": (43, 2, 5), "name_first": (45, 0, 5)}
    assert {r.arm: r.passed for r in ev.gate(ev.card(outcomes)).collect()}["consensus"]
    won = ev.contrast(ev.card(outcomes), "consensus", "confidence").first()
    assert (won.prevented_wrong, won.given_up_correct) == (2, -1)
    rescored = ev.rescore(shown, items, ad.judge_name_first(named, shown)).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in rescored} == {"correct": 45, "declined": 5}
    consensus = outcomes.where("arm = 'consensus'")
    assert ev.recoverable(consensus, shown, items).first().one_wrong == 6
    assert ev.card(consensus).first().declined_with_truth == 6


def test_reader_records(stored):
    shown, items = stored
    stats = {r.family: r for r in ev.annotator_stats(shown, items).collect()}
    assert (stats["scored"].correct, stats["scored"].wrong, stats["scored"].confident_wrong) == (46, 4, 2)
    assert (stats["unscored"].correct, stats["unscored"].gives_confidence) == (48, False)
    table = {(r.family, r.bin): (r.right, r.wrong) for r in ev.calibration(shown, items).collect()}
    assert table == {
        ("scored", "<0.8"): (3, 2), ("scored", "0.8~0.85"): (8, 2), ("scored", "0.85~0.9"): (20, 0), ("scored", "0.9+"): (15, 0),
        ("unscored", "none"): (48, 2),
    }
    sep = {r.family: r for r in ev.confidence_separation(shown, items).collect()}["scored"]
    assert (sep.right_low, sep.right_median, sep.right_high, sep.wrong_median, sep.separable) == (.72, .88, .92, .80, False)
    both = ev.collusion(shown, items).first()
    assert (both.answered_by_two, both.same_wrong, both.different_wrong) == (50, 0, 0)
    effect = ev.threshold_effect(shown, items).first()
    assert (effect.right, effect.wrong) == (3, 0)
    worst = {(r.variant, r.family): r.wrong for r in ev.variant_by_annotator(shown, items).collect()}
    assert worst["serif", "scored"] == 2 and worst["serif", "unscored"] == 1 and worst["noisy", "scored"] == 0


def test_colluding_readers_pass_the_consensus(spark):
    shown = reads(spark, {i: [("one", B if i % 3 == 0 else A, None), ("two", B if i % 3 == 0 else A, None)] for i in range(1, 51)})
    items = spark.createDataFrame([(i, "n", "plain", A) for i in range(1, 51)], "item_id int, name string, variant string, inchikey string")
    outcomes = ev.evaluate(shown, items, ad.POLICIES)
    card = {r.arm: r for r in ev.card(outcomes).collect()}["consensus"]
    assert (card.correct, card.confident_wrong) == (34, 16)
    totals = {r.arm: r for r in ev.diagnosis_totals(ev.diagnose(outcomes, shown)).collect()}["consensus"]
    assert (totals.same_misread, totals.coincident, totals.one_variant) == (16, 0, True)
    assert ev.collusion(shown, items).first().same_wrong == 16


def test_outcome_table_is_complete(spark):
    ideal = {"same": "ok", "skeleton_diff": "error", "stereo_diff": "warn"}
    expected = {
        ("same", "error"): "false_alarm", ("same", "warn"): "misgraded", ("skeleton_diff", "ok"): "missed", ("skeleton_diff", "warn"): "misgraded",
        ("stereo_diff", "ok"): "missed", ("stereo_diff", "error"): "false_alarm",
    }
    cells = list(itertools.product(ev.JUDGEABLE + ev.NOT_JUDGEABLE, ad.VERDICTS))
    df = spark.createDataFrame(cells, "truth string, verdict string")
    scored = df.withColumn("outcome", ev.outcome7(F.col("truth"), F.col("verdict"))).withColumn("arm", F.lit("x"))
    for r in scored.collect():
        if r.truth in ev.NOT_JUDGEABLE:
            want = {"abstain": "declined", "error": "false_alarm"}.get(r.verdict, "misgraded")
        elif r.verdict == "abstain":
            want = "silent"
        elif r.verdict == ideal[r.truth]:
            want = "cleared" if r.truth == "same" else "caught"
        else:
            want = expected[r.truth, r.verdict]
        assert r.outcome == want, r
    assert ev.missing_cells(scored).count() == 0 and ev.missing_cells(scored.where("truth <> 'same'")).count() == 4
    card = ev.scorecard(scored).first()
    assert (card.n, card.judgeable, card.no_error_expected, card.wrong_labelled) == (28, 12, 24, 8)
    assert card.coverage == 0.75 and card.detection_rate == 0.25 and card.decline_rate == 0.25


def test_document_summary(spark):
    findings = spark.createDataFrame(
        [("a", "ok", "exact"), ("a", "abstain", "no_name"), ("b", "abstain", "no_name"), ("b", "abstain", "low_confidence"), ("c", "abstain", "odd")],
        "deck string, verdict string, reason string",
    )
    pages = spark.createDataFrame([("a", 2, 50, 1), ("b", 2, 0, 0), ("c", 1, 10, 0), ("d", 0, 10, 0)], "deck string, n_figures int, text_chars int, n_refs int")
    got = {r.deck: r for r in ev.document_summary(findings, pages).collect()}
    assert (got["a"].judged, got["a"].judged_pct, got["a"].note) == (1, 50.0, None)
    assert got["b"].note == "no_text" and got["b"].nothing_judged and got["c"].note == "no_names" and got["d"].total == 0
    buckets = {(r.deck, r.bucket): r.n for r in ev.abstain_buckets(findings, pages).collect()}
    assert buckets == {("a", "no name beside the figure"): 1, ("b", "no text layer"): 2, ("c", "odd"): 1}
    assert {r.verdict: r.n for r in ev.verdict_summary(findings).collect()} == {"ok": 1, "error": 0, "warn": 0, "abstain": 4}


def test_service_rules(spark):
    read = lambda engine, raw, key: (engine, raw, key, None)
    ref = ("aspirin", A, "C9H8O4", "CC(=O)Oc1ccccc1C(=O)O")
    none = (None, None, None, None)
    big = "C" * 130
    rows = [
        (1, "n", *ref, [read("one", "CCO", A), read("two", "CCO", A2)]), (2, "n", *ref, [read("one", "CCO", B)]),
        (3, "n", *ref, [read("one", "CCO", B), read("two", "CCO", A)]), (4, "n", *ref, [read("one", "CCO", B), read("two", "CCO", C)]),
        (5, "n", *ref, [read("one", big, B)]), (6, "n", *ref, []), (7, "n", *ref, [read("one", "CN(C)(C)(C)C", None)]),
        (8, "n", *none, [read("one", "CCO", B), read("two", "CCO", B)]), (9, "n", *ref, [read("one", "C*", A), read("two", "CCO", A)]),
        (10, "n", *none, []),
    ]
    schema = (
        "request_id int, name string, ref_name string, ref_key string, ref_formula string, ref_smiles string, "
        "reads array<struct<engine:string,raw:string,inchikey:string,confidence:double>>"
    )
    judged = ad.judge_service(spark.createDataFrame(rows, schema))
    got = {r.request_id: (r.verdict, r.grade, r.rule) for r in judged.collect()}
    assert got == {
        1: ("match", "strong", "same_skeleton"), 2: ("mismatch", "weak", "other_skeleton"), 3: ("match", "weak", "split_name_decides"),
        4: ("unreadable", None, "split"), 5: ("unreadable", None, "nonsense_size"), 6: ("unreadable", None, "no_reading"),
        7: ("unreadable", None, "not_a_structure"), 8: ("unreadable", "strong", "no_reference"), 9: ("match", "weak", "same_skeleton"),
        10: ("unreadable", None, "no_reading"),
    }
    reasons = {r.request_id: r.reasons for r in judged.collect()}
    assert reasons[9] == ["one wildcards:1", "same_skeleton"] and reasons[7] == ["not_a_structure", "heavy_formula:C5N:C9O4"]
    assert reasons[10] == ["name_not_found", "no_reading"]
    response = {r.request_id: r.response for r in ad.check_response(judged).collect()}
    assert '"grade":null' in response[4] and '"confidence":null' in response[1] and '"reference":null' in response[8]


def test_label_validation(spark):
    dict_df = spark.createDataFrame([("a", A), ("b", B)], "name_key string, inchikey string")
    cases = spark.createDataFrame([
        ("a", "C", A, "same", "", "", None), ("a", "C", A2, "same", "", "", None), ("b", "C", A, "skeleton_diff", "", "", None),
        ("zz", "C", A, "same", "", "", None), ("a", "?", None, "same", "", "", None), ("a", "", None, "not_structure", "", "", None),
        ("a", "C", A, "not_structure", "x", "", None), ("a", "", None, "no_claim", "x", "", None), ("a", "?", None, "no_claim", "x", "", None),
        ("a", "", None, "generic_formula", "x", "CC", A), ("a", "", None, "reaction_scheme", "x", "R", None), ("a", "C", "", "same", "", "", None),
    ], "name string, smiles string, drawn_key string, truth string, note string, art string, art_key string")
    got = [(r.declared, r.problem) for r in lb.validate_labels(cases, dict_df).collect()]
    assert sorted(got, key=str) == sorted([
        ("same", None), ("same", "label_differs"), ("skeleton_diff", None), ("same", "name_unresolved"), ("same", "drawing_unreadable"),
        ("not_structure", "no_note"), ("not_structure", "structure_not_expected"), ("no_claim", "structure_missing"),
        ("no_claim", "structure_unreadable"), ("generic_formula", "ordinary_compound"), ("reaction_scheme", None), ("same", "uncomparable"),
    ], key=str)
