"""The composed deck check on a few hand-made pages."""

from structaudit.operators import decks as dk
from structaudit.operators import evaluate as ev

A, B = "AAAAAAAAAAAAAA-AAAAAAAASA-N", "BBBBBBBBBBBBBB-AAAAAAAASA-N"


def inputs(spark):
    texts = spark.createDataFrame(
        [(1, 1, 0, "We made toluamine"), (1, 2, 0, "of no name"), (2, 1, 0, "benzamine"), (2, 1, 7_000_000_000, "and toluamine")],
        "deck long, page long, part long, text string",
    )
    figures = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 2, 1), (5, 3, 1)], "item_id long, deck long, page long"
    )
    rows = [(i, n, e, "C", k, 0.95) for i, k in ((1, A), (2, A), (3, B), (5, A), (9, A)) for n, e in enumerate(("x/1", "y/1"))]
    reads = spark.createDataFrame(rows, "item_id long, read_no long, engine string, raw string, inchikey string, confidence double")
    names = spark.createDataFrame([("toluamine", A), ("benzamine", B)], "name_key string, inchikey string")
    return texts, figures, reads, names


def test_every_figure_gets_one_finding(spark):
    texts, figures, reads, names = inputs(spark)
    refs = dk.references_of(texts, names)
    found = {r.item_id: r for r in dk.check_figures(figures, reads, refs).collect()}
    assert {i: (r.verdict, r.reason, r.name) for i, r in found.items()} == {
        1: ("ok", "exact", "toluamine"),
        2: ("abstain", "no_name", None),
        3: ("ok", "exact", "benzamine"),
        4: ("abstain", "no_engine", "benzamine"),
        5: ("abstain", "no_name", None),
    }


def test_summary_of_decks(spark):
    texts, figures, reads, names = inputs(spark)
    refs = dk.references_of(texts, names)
    facts = dk.page_facts(texts, figures, refs)
    assert {(r.deck, r.page): (r.n_figures, r.n_refs) for r in facts.collect()} == {
        (1, 1): (1, 1), (1, 2): (1, 0), (2, 1): (2, 2), (3, 1): (1, 0)
    }
    summary = {r.deck: r for r in ev.document_summary(dk.check_figures(figures, reads, refs), facts).collect()}
    assert (summary[1].total, summary[1].judged, summary[1].note) == (2, 1, None)
    assert (summary[2].ok, summary[2].abstain) == (1, 1)
    assert summary[3].note == "no_text" and summary[3].nothing_judged


def test_no_decks(spark):
    texts, figures, reads, names = (df.limit(0) for df in inputs(spark))
    refs = dk.references_of(texts, names)
    assert dk.check_figures(figures, reads, refs).count() == 0
    assert dk.page_facts(texts, figures, refs).count() == 0
