"""Checking labels before anything is scored with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structaudit.functions.keys import DIFFERENT, EXACT, SKELETON, compare_keys
from structaudit.operators.evaluate import NOT_JUDGEABLE, OUT_OF_SCOPE
from structaudit.operators.resolve import resolve


def with_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Only labelled items, with their label."""
    return items.join(labels, "item_id")


def pair_items(items: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    """Each item with the references of its page; items on pages without any stay, with NULLs."""
    return items.join(refs, on, "left")


def validate_labels(cases: DataFrame, dict_df: DataFrame) -> DataFrame:
    """Declared truth against the truth computed from name and drawing: (name, declared, computed, problem).

    ``cases(name, smiles, drawn_key, truth, note, art, art_key)``; the keys are those of the drawn
    structures, NULL where the string is no structure.
    """
    found = resolve(cases.select(F.col("name").alias("query")), dict_df)
    refs = found.select(F.col("query").alias("name"), F.col("inchikey").alias("ref_key"))
    truth = F.col("truth")
    text = lambda c: F.coalesce(c, F.lit(""))
    match = compare_keys(F.col("ref_key"), F.col("drawn_key"))
    computed = (
        F.when(match == EXACT, "same").when(match == SKELETON, "stereo_diff").when(match == DIFFERENT, "skeleton_diff")
    )
    drawn = text("smiles") != ""
    by_eye = (
        F.when(text("note") == "", "no_note")
        .when((truth != "no_claim") & drawn, "structure_not_expected")
        .when((truth == "no_claim") & ~drawn, "structure_missing")
        .when((truth == "no_claim") & F.col("drawn_key").isNull(), "structure_unreadable")
        .when(truth.isin(*OUT_OF_SCOPE) & (text("art") != "") & F.col("art_key").isNotNull(), "ordinary_compound")
    )
    by_key = (
        F.when(F.col("ref_key").isNull(), "name_unresolved")
        .when(F.col("drawn_key").isNull(), "drawing_unreadable")
        .when(F.col("computed").isNull(), "uncomparable")
        .when(F.col("computed") != truth, "label_differs")
    )
    judged_by_eye = truth.isin(*NOT_JUDGEABLE)
    problem = F.when(judged_by_eye, by_eye).otherwise(by_key)
    kept = F.when(judged_by_eye, F.when(by_eye.isNull(), truth)).otherwise(
        F.when(F.col("ref_key").isNotNull() & F.col("drawn_key").isNotNull(), F.col("computed"))
    )
    return (
        cases.join(refs, "name", "left")
        .withColumn("computed", computed)
        .select("name", truth.alias("declared"), kept.alias("computed"), problem.alias("problem"))
    )
