"""Costly column expressions stay where they are worked out once."""

from structaudit.operators import mining as mn
from structaudit.plans import registry


def filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan, [line for line in plan.split("\n") if "Filter " in line]


def test_a_window_is_scored_once_and_a_text_is_split_once(spark):
    docs = spark.createDataFrame([(1, "2-methyl propanol and\n\nvitamin b12 here\n")], "doc_id long, text string")
    plan, found = filters(mn.ngrams(docs, ["doc_id"], "text"))
    assert not [line for line in found if ".f & " in line]
    assert plan.count("split(") == 1
    rows = {(r.phrase, r.score) for r in mn.ngrams(docs, ["doc_id"], "text").collect()}
    assert ("2-methyl propanol", 8.0) in rows and ("vitamin b12", 4.0) in rows and not any("and" in p for p, _ in rows)
    assert [r.line for r in mn.lines(docs, ["doc_id"], "text").orderBy("line_no").collect()] == ["2-methyl propanol and", "", "vitamin b12 here"]


def test_formula_notes_are_written_for_different_strings_only(spark):
    _, found = filters(registry.QUERIES["formula_differences"](spark, "/root/testdata/sf0.001"))
    assert not [line for line in found if "regexp_extract_all" in line]


def test_reference_formulas_are_worked_out_where_a_rule_asks(spark):
    plan, _ = filters(registry.QUERIES["service_verdicts"](spark, "/root/testdata/sf0.001"))
    assert "AS _ref_formula" not in plan
