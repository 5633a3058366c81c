"""Decisions and findings against the truth.

``items(item_id, name, variant, inchikey)`` are the evaluated items with their true key,
``reads`` the stored readings. Readings are reduced to one row per item and family (or to counts)
before they meet the items, so joins carry the reduced rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structaudit.functions.keys import confidence_bin, engine_family, known_confidence, skeleton
from structaudit.operators.adjudicate import MIN_CONFIDENCE, VERDICTS, consensus_policy
from structaudit.operators.agreement import best_per_family, family_reads, item_summary
from structaudit.operators.ranking import running_total

# The vocabularies, in report order.
OUTCOMES3 = ("correct", "confident_wrong", "declined")
OUTCOMES7 = ("cleared", "caught", "false_alarm", "missed", "misgraded", "silent", "declined")
JUDGEABLE = ("same", "skeleton_diff", "stereo_diff")
NO_TARGET = ("not_structure", "no_claim")
OUT_OF_SCOPE = ("generic_formula", "reaction_scheme")
NOT_JUDGEABLE = NO_TARGET + OUT_OF_SCOPE
VARIANTS = ("plain", "large", "small", "thick", "rotated", "serif", "noisy", "jpeg")
BINS = ("<0.8", "0.8~0.85", "0.85~0.9", "0.9+")


def variant_for(index: Column) -> Column:
    """Drawing variant of the item with this number (from 1)."""
    return F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), (F.pmod(index - 1, F.lit(len(VARIANTS))) + 1).cast("int"))


def rule_of_three(n: Column) -> Column:
    """Upper bound in percent of a rate of which no case was seen in ``n``."""
    return F.round(F.try_divide(F.lit(300.0), n)).cast("int")


def rate(part: Column, whole: Column) -> Column:
    """A share, NULL when there is nothing to share."""
    return F.try_divide(part.cast("double"), whole)


def _true_skeletons(items: DataFrame) -> DataFrame:
    return items.select("item_id", skeleton(F.col("inchikey")).alias("true_skeleton"), F.col("inchikey").alias("true_key"))


# Outcomes ----------------------------------------------------------------------------------


def outcomes3(items: DataFrame, decisions: DataFrame, reads: DataFrame) -> DataFrame:
    """correct, confident_wrong or declined per item; an item without any reading declines."""
    seen = reads.select("item_id", skeleton(F.col("inchikey")).alias("true_skeleton")).where("true_skeleton is not null")
    available = (
        _true_skeletons(items)
        .join(seen.distinct(), ["item_id", "true_skeleton"], "left_semi")
        .select("item_id", F.lit(True).alias("_available"))
    )
    truth, answer = F.col("inchikey"), F.col("decision_key")
    outcome = (
        F.when(answer.isNull(), "declined")
        .when(skeleton(answer).eqNullSafe(skeleton(truth)), "correct")
        .otherwise("confident_wrong")
    )
    return (
        items.join(decisions, "item_id", "left")
        .join(available, "item_id", "left")
        .select(
            "item_id",
            "variant",
            answer.alias("decision_key"),
            F.coalesce("reason", F.lit("no_reads")).alias("reason"),
            outcome.alias("outcome"),
            F.coalesce(answer == truth, F.lit(False)).alias("exact"),
            F.coalesce("_available", F.lit(False)).alias("truth_available"),
        )
    )


def evaluate(reads: DataFrame, items: DataFrame, policies: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Outcomes of every policy over the same readings, one arm each."""
    arms = [
        outcomes3(items, policy(reads), reads).withColumn("arm", F.lit(name)) for name, policy in policies.items()
    ]
    return reduce(DataFrame.unionByName, arms)


def rescore(reads: DataFrame, items: DataFrame, findings: DataFrame, arm: str = "name_first") -> DataFrame:
    """Findings of stored readings on the three-way scale: ok and warn are correct, error is wrong."""
    outcome = (
        F.when(F.col("verdict").isin("ok", "warn"), "correct")
        .when(F.col("verdict") == "error", "confident_wrong")
        .otherwise("declined")
    )
    decided = findings.select("item_id", F.col("predicted_key").alias("decision_key"), "reason", "verdict")
    return (
        outcomes3(items, decided, reads)
        .drop("outcome")
        .join(decided.select("item_id", "verdict"), "item_id", "left")
        .withColumn("outcome", F.coalesce(outcome, F.lit("declined")))
        .withColumn("arm", F.lit(arm))
    )


def card(outcomes: DataFrame) -> DataFrame:
    """Counts and rates per arm."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    counted = outcomes.groupBy("arm").agg(
        F.count("*").alias("n"),
        *[n(o).alias(o) for o in OUTCOMES3],
        F.count_if((F.col("outcome") == "correct") & F.col("exact")).alias("exact"),
        F.count_if((F.col("outcome") == "declined") & F.col("truth_available")).alias("declined_with_truth"),
    )
    return counted.select("*", *[rate(F.col(o), F.col("n")).alias(f"{o}_rate") for o in OUTCOMES3])


def decline_reasons(outcomes: DataFrame) -> DataFrame:
    """Declined items per arm and reason; ``place`` is the report order, most frequent first."""
    counted = outcomes.where("outcome = 'declined'").groupBy("arm", "reason").agg(F.count("*").alias("n"))
    return counted.withColumn("place", _place("arm", "reason"))


def _place(group: str, label: str) -> Column:
    """Place of a counted row in its group: the largest ``n`` first, equal counts by label."""
    return F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc_nulls_last(label)))


def by_variant(outcomes: DataFrame) -> DataFrame:
    """Outcome counts per arm and variant, with the report order of the variants."""
    order = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("variant"))
    return (
        outcomes.groupBy("arm", "variant")
        .agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES3])
        .withColumn("variant_order", order.cast("int"))
    )


def flips(outcomes: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """Items whose outcome differs between two arms; one grouping instead of a self-join."""
    at = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("outcome")))
    return (
        outcomes.where(F.col("arm").isin(arm_a, arm_b))
        .groupBy("item_id")
        .agg(at(arm_a).alias("outcome_a"), at(arm_b).alias("outcome_b"))
        .where("outcome_a <> outcome_b")
    )


def contrast(cards: DataFrame, product: str, baseline: str) -> DataFrame:
    """What the product arm's reticence bought and what it cost."""
    of = lambda arm, c: F.sum(F.when(F.col("arm") == arm, F.col(c)))
    return cards.agg(
        (of(baseline, "confident_wrong") - of(product, "confident_wrong")).alias("prevented_wrong"),
        (of(baseline, "correct") - of(product, "correct")).alias("given_up_correct"),
    )


def gate(cards: DataFrame, column: str = "confident_wrong") -> DataFrame:
    """An arm passes when nothing of the worst kind happened."""
    return cards.select("arm", (F.col(column) == 0).alias("passed"))


# Readers -----------------------------------------------------------------------------------


def annotator_stats(reads: DataFrame, items: DataFrame) -> DataFrame:
    """Record of every reader family as if it were trusted alone."""
    best = F.col("best")
    right = skeleton(best["inchikey"]) == F.col("true_skeleton")
    answered = F.col("n_readable") > 0
    wrong = answered & ~right
    return (
        family_reads(reads)
        .join(_true_skeletons(items), "item_id")
        .groupBy("family")
        .agg(
            F.count("*").alias("images"),
            F.count_if(answered).alias("answered"),
            F.count_if(right).alias("correct"),
            F.count_if(right & (best["inchikey"] == F.col("true_key"))).alias("exact"),
            F.count_if(wrong).alias("wrong"),
            F.count_if(F.col("n_readable") < F.col("n_reads")).alias("unreadable"),
            F.count_if(wrong & (best["confidence"] >= MIN_CONFIDENCE)).alias("confident_wrong"),
            F.bool_or(F.col("max_confidence").isNotNull()).alias("gives_confidence"),
        )
    )


def _scored_counts(reads: DataFrame, items: DataFrame, value: Column) -> DataFrame:
    """Readable readings counted by (family, right, value); counted before the join."""
    counted = (
        reads.select(
            "item_id",
            engine_family(F.col("engine")).alias("family"),
            skeleton(F.col("inchikey")).alias("skeleton"),
            value.alias("value"),
        )
        .where("skeleton is not null")
        .groupBy("item_id", "family", "skeleton", "value")
        .agg(F.count("*").alias("n"))
    )
    return (
        counted.join(_true_skeletons(items), "item_id")
        .groupBy("family", (F.col("skeleton") == F.col("true_skeleton")).alias("right"), "value")
        .agg(F.sum("n").alias("n"))
    )


def calibration(reads: DataFrame, items: DataFrame) -> DataFrame:
    """Right and wrong readings per family and score band.

    A family that never gives a score has one row with the band ``none``.
    """
    band = F.coalesce(confidence_bin(known_confidence(F.col("confidence"))), F.lit("none"))
    table = (
        _scored_counts(reads, items, band)
        .groupBy("family", F.col("value").alias("bin"))
        .agg(
            F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("right"),
            F.sum(F.when(~F.col("right"), F.col("n")).otherwise(0)).alias("wrong"),
        )
    )
    scored = table.where("bin <> 'none'")
    silent = table.where("bin = 'none'").join(scored.select("family").distinct(), "family", "left_anti")
    return scored.unionByName(silent)


def confidence_separation(reads: DataFrame, items: DataFrame) -> DataFrame:
    """Lowest, upper median and highest score per family, for right and wrong readings.

    ``separable``: every right reading scores above every wrong one. The median is exact: the
    value at which the running count passes half of the readings.
    """
    scored = _scored_counts(reads, items, known_confidence(F.col("confidence"))).where("value is not null")
    total = scored.groupBy("family", "right").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total")
    )
    upto = running_total(scored, ["family", "right"], [F.asc("value")], F.col("n"), "upto", [F.floor(F.col("value") * 1000)])
    median = (
        upto.join(total.select("family", "right", "total"), ["family", "right"])
        .where("upto > total div 2")
        .groupBy("family", "right")
        .agg(F.min("value").alias("median"))
    )
    of = lambda agg, c, side: agg(F.when(F.col("right") == side, F.col(c)))
    wide = (
        total.join(median, ["family", "right"])
        .groupBy("family")
        .agg(
            *[of(F.max, c, True).alias(f"right_{c}") for c in ("low", "median", "high", "total")],
            *[of(F.max, c, False).alias(f"wrong_{c}") for c in ("low", "median", "high", "total")],
        )
    )
    return wide.withColumn("separable", F.col("right_low") > F.col("wrong_high"))


def variant_by_annotator(reads: DataFrame, items: DataFrame) -> DataFrame:
    """Items a family got wrong, could not read or never saw, per variant.

    Counted as items minus right answers, so items and families need not be crossed.
    """
    sizes = items.groupBy("variant").agg(F.count("*").alias("n"))
    right = (
        best_per_family(reads)
        .join(_true_skeletons(items).join(items.select("item_id", "variant"), "item_id"), "item_id")
        .where(skeleton(F.col("inchikey")) == F.col("true_skeleton"))
        .groupBy("variant", "family")
        .agg(F.count("*").alias("n_right"))
    )
    families = reads.join(items, "item_id", "left_semi").select(engine_family(F.col("engine")).alias("family")).distinct()
    every = F.explode(F.array(*[F.lit(v) for v in VARIANTS]))
    grid = families.select("family", every.alias("variant"))
    return (
        grid.join(sizes, "variant")
        .join(right, ["variant", "family"], "left")
        .select("variant", "family", (F.col("n") - F.coalesce("n_right", F.lit(0))).alias("wrong"), "n")
    )


def _families_against_truth(reads: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: how many families answered, how many wrongly, and whether they share a skeleton."""
    return (
        best_per_family(reads)
        .withColumn("skeleton", skeleton(F.col("inchikey")))
        .join(_true_skeletons(items), "item_id")
        .groupBy("item_id")
        .agg(
            F.count("*").alias("n_answered"),
            F.count_if(F.col("skeleton") != F.col("true_skeleton")).alias("n_wrong"),
            (F.min("skeleton") == F.max("skeleton")).alias("one_skeleton"),
        )
    )


def collusion(reads: DataFrame, items: DataFrame) -> DataFrame:
    """How often all answering families are wrong together, on the same or on different skeletons."""
    all_wrong = F.col("n_wrong") == F.col("n_answered")
    return (
        _families_against_truth(reads, items)
        .where("n_answered >= 2")
        .agg(
            F.count("*").alias("answered_by_two"),
            F.count_if(all_wrong & F.col("one_skeleton")).alias("same_wrong"),
            F.count_if(all_wrong & ~F.col("one_skeleton")).alias("different_wrong"),
        )
        .withColumn("rate", rate(F.col("same_wrong") + F.col("different_wrong"), F.col("answered_by_two")))
    )


def recoverable(outcomes: DataFrame, reads: DataFrame, items: DataFrame) -> DataFrame:
    """Declined items where exactly one family was wrong: what another reader could win back."""
    answered = _families_against_truth(reads, items)
    return (
        outcomes.where("outcome = 'declined'")
        .join(answered, "item_id", "left")
        .groupBy("arm")
        .agg(
            F.count("*").alias("declined"),
            F.count_if((F.col("n_answered") >= 2) & (F.col("n_wrong") == 1)).alias("one_wrong"),
        )
        .withColumn("share", rate(F.col("one_wrong"), F.col("declined")))
    )


def threshold_effect(reads: DataFrame, items: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Agreed answers that a score threshold would have thrown away, right and wrong."""
    agreed = consensus_policy(reads).where("decision_key is not null")
    low = item_summary(family_reads(reads)).where(F.col("max_readable_confidence") < threshold)
    right = skeleton(F.col("decision_key")) == F.col("true_skeleton")
    return (
        agreed.join(low.select("item_id"), "item_id", "left_semi")
        .join(_true_skeletons(items), "item_id")
        .agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong"))
    )


def diagnose(outcomes: DataFrame, reads: DataFrame) -> DataFrame:
    """Cause of every confidently wrong answer: same_misread, coincident or one_annotator."""
    seen = item_summary(family_reads(reads)).select("item_id", "n_families", "keys_differ")
    cause = (
        F.when(F.coalesce("n_families", F.lit(0)) < 2, "one_annotator")
        .when(F.col("keys_differ"), "coincident")
        .otherwise("same_misread")
    )
    return (
        outcomes.where("outcome = 'confident_wrong'")
        .join(seen, "item_id", "left")
        .select("arm", "item_id", "variant", cause.alias("cause"))
    )


def diagnosis_totals(diagnosed: DataFrame) -> DataFrame:
    """Causes per arm, and whether the failures sit on a single variant."""
    causes = ("same_misread", "coincident", "one_annotator")
    return diagnosed.groupBy("arm").agg(
        *[F.count_if(F.col("cause") == c).alias(c) for c in causes],
        ((F.min("variant") == F.max("variant")) & (F.count("*") > 1)).alias("one_variant"),
    )


# Verdicts against labels -------------------------------------------------------------------


def outcome7(truth: Column, verdict: Column) -> Column:
    """Outcome of a verdict for an item of this kind. Declining is right where nothing can be judged."""
    unjudgeable = (
        F.when(verdict == "abstain", "declined").when(verdict == "error", "false_alarm").otherwise("misgraded")
    )
    judgeable = (
        F.when(verdict == "abstain", "silent")
        .when((truth == "same") & (verdict == "ok"), "cleared")
        .when((truth == "skeleton_diff") & (verdict == "error"), "caught")
        .when((truth == "stereo_diff") & (verdict == "warn"), "caught")
        .when((verdict == "error") & truth.isin("same", "stereo_diff"), "false_alarm")
        .when((truth != "same") & (verdict == "ok"), "missed")
        .otherwise("misgraded")
    )
    return F.when(truth.isin(*NOT_JUDGEABLE), unjudgeable).when(truth.isin(*JUDGEABLE), judgeable)


def outcomes7(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """Labelled items with their outcome; items without a label are not scored."""
    return labels.join(findings, "item_id").withColumn("outcome", outcome7(F.col("truth"), F.col("verdict")))


def missing_cells(outcomes: DataFrame) -> DataFrame:
    """(truth, verdict) cells of the full table that never occur."""
    cells = F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(v).alias("verdict"))
                      for t in JUDGEABLE + NOT_JUDGEABLE for v in VERDICTS])
    full = outcomes.sparkSession.range(1).select(F.inline(cells))
    return full.join(outcomes.select("truth", "verdict").distinct(), ["truth", "verdict"], "left_anti")


def scorecard(outcomes: DataFrame) -> DataFrame:
    """Coverage, false alarms, detection and declines per arm; the denominators differ on purpose."""
    truth, outcome = F.col("truth"), F.col("outcome")
    counted = outcomes.groupBy("arm").agg(
        F.count("*").alias("n"),
        F.count_if(truth.isin(*JUDGEABLE)).alias("judgeable"),
        F.count_if(truth.isin(*NOT_JUDGEABLE)).alias("not_judgeable"),
        F.count_if(truth.isin(*NO_TARGET)).alias("no_target"),
        F.count_if(truth.isin(*OUT_OF_SCOPE)).alias("out_of_scope"),
        F.count_if(truth.isin("same", "stereo_diff", *NOT_JUDGEABLE)).alias("no_error_expected"),
        F.count_if(truth.isin("skeleton_diff", "stereo_diff")).alias("wrong_labelled"),
        *[F.count_if(outcome == o).alias(o) for o in OUTCOMES7],
    )
    return counted.select(
        "*",
        (1.0 - rate(F.col("silent"), F.col("judgeable"))).alias("coverage"),
        rate(F.col("false_alarm"), F.col("no_error_expected")).alias("false_alarm_rate"),
        rate(F.col("caught"), F.col("wrong_labelled")).alias("detection_rate"),
        rate(F.col("declined"), F.col("not_judgeable")).alias("decline_rate"),
    )


def scorecard_contrast(cards: DataFrame, product: str, baseline: str) -> DataFrame:
    """False alarms prevented and judgements given up against the baseline arm."""
    of = lambda arm, c: F.sum(F.when(F.col("arm") == arm, c))
    judged = F.col("judgeable") - F.col("silent")
    return cards.agg(
        (of(baseline, F.col("false_alarm")) - of(product, F.col("false_alarm"))).alias("prevented_false_alarms"),
        (of(product, judged) - of(baseline, judged)).alias("judged_difference"),
    )


# Documents ---------------------------------------------------------------------------------


def verdict_summary(findings: DataFrame) -> DataFrame:
    """Count per verdict, zeros included."""
    counts = findings.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    cells = F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in VERDICTS])
    return counts.select(F.inline(cells))


def silence_bucket(reason: Column) -> Column:
    """Readable bucket of an abstain reason; an unknown reason stands for itself."""
    table = {
        "no_engine": "no reader available",
        "no_name": "no name beside the figure",
        "low_confidence": "low reading confidence",
        "self_inconsistent": "readers disagree",
        "unparseable": "reading is no structure",
        "no_result": "readers found nothing",
    }
    chain = F
    for needle, label in table.items():
        chain = chain.when(reason.contains(needle), label)
    return chain.otherwise(reason)


def _deck_facts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("deck").agg(
        F.sum("n_figures").alias("n_figures"),
        F.sum("text_chars").alias("text_chars"),
        F.count_if(F.col("n_refs") > 0).alias("named_pages"),
    )


def document_summary(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Per deck: how much was judged at all, then the verdicts, and what the whole document lacks."""
    counts = findings.groupBy("deck").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    )
    note = F.when(
        (F.col("abstain") > 0) & (F.col("n_figures") > 0),
        F.when(F.col("text_chars") == 0, "no_text").when(F.col("named_pages") == 0, "no_names"),
    )
    filled = _deck_facts(pages).join(counts, "deck", "left").na.fill(0, ["total", *VERDICTS])
    judged = F.col("total") - F.col("abstain")
    return filled.select(
        "deck",
        "total",
        judged.alias("judged"),
        F.round(rate(judged * 100, F.col("total")), 1).alias("judged_pct"),
        *VERDICTS,
        note.alias("note"),
        ((F.col("total") > 0) & (judged == 0)).alias("nothing_judged"),
    )


def abstain_buckets(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Abstentions per deck and bucket, ``place`` by frequency; without any text layer there is only one cause."""
    textless = (F.col("n_figures") > 0) & (F.col("text_chars") == 0)
    bucket = F.when(textless, "no text layer").otherwise(silence_bucket(F.col("reason")))
    counted = findings.where("verdict = 'abstain'").groupBy("deck", "reason").agg(F.count("*").alias("n"))
    return (
        counted.join(_deck_facts(pages), "deck")
        .groupBy("deck", bucket.alias("bucket"))
        .agg(F.sum("n").alias("n"))
        .withColumn("place", _place("deck", "bucket"))
    )


def page_funnel(pages: DataFrame) -> DataFrame:
    """Pages, those with figures, with names, with both, and the figures on the latter."""
    figures, named = F.col("n_figures") > 0, F.col("n_refs") > 0
    return pages.agg(
        F.count("*").alias("pages"),
        F.count_if(figures).alias("with_figures"),
        F.count_if(named).alias("with_names"),
        F.count_if(figures & named).alias("with_both"),
        F.sum(F.when(figures & named, F.col("n_figures")).otherwise(0)).alias("figures_with_names"),
        F.sum("n_figures").alias("figures"),
    )


def corpus_summary(scored: DataFrame) -> DataFrame:
    """Verdicts per crop flag and model, with a total row (model NULL) per crop flag."""
    n = lambda column, value: F.count_if(F.col(column) == value)
    return (
        scored.rollup("crop", "model")
        .agg(
            F.grouping_id().alias("level"),
            F.count("*").alias("n"),
            *[n("verdict", v).alias(v) for v in ("mismatch", "match", "unreadable")],
            F.sum("parse_fail").alias("parse_fail"),
            F.sum("engines").alias("reads"),
            n("grade", "strong").alias("strong"),
        )
        .where("level < 3")
        .drop("level")
    )
