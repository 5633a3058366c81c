"""Verdicts: a claimed name's reference key against what the readers saw.

Two rule sets exist and differ on purpose: :func:`judge_name_first` grades by reader families,
:func:`judge_service` by the number of valid readings and never judges stereo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.functions import formula as fm
from structaudit.functions.binding import let
from structaudit.functions.keys import (
    EXACT,
    SKELETON_LENGTH,
    compare_keys,
    json_confidence,
    skeleton,
    skeleton_or_key,
    without_protonation,
)
from structaudit.operators.agreement import family_reads, item_summary

MIN_CONFIDENCE = 0.80
VERDICTS = ("ok", "error", "warn", "abstain")


def _match_keys(key: Column) -> Column:
    """The two values on which keys can match: rank 1 exact, rank 2 skeleton only."""
    return F.inline(
        F.array(
            F.struct(F.lit(1).alias("match_rank"), without_protonation(key).alias("match_on")),
            F.struct(F.lit(2).alias("match_rank"), F.coalesce(skeleton(key), F.lit("")).alias("match_on")),
        )
    )


def match_refs(refs: DataFrame, stable: DataFrame) -> DataFrame:
    """First exact match per item in (reference, reading) order, else first skeleton match.

    A match is an equality of key parts, so both sides are grouped on (item, part) and joined on
    it; references and readings are never paired off against each other.
    """
    on = ["item_id", "match_rank", "match_on"]
    ref_side = (
        refs.where((F.col("inchikey") != ""))
        .select("item_id", "ref_no", F.col("inchikey").alias("ref_key"), _match_keys(F.col("inchikey")))
        .groupBy(*on)
        .agg(F.min(F.struct("ref_no", "ref_key")).alias("ref"))
    )
    read_side = (
        stable.select("item_id", "first_no", F.col("inchikey").alias("read_key"), _match_keys(F.col("inchikey")))
        .groupBy(*on)
        .agg(F.min(F.struct("first_no", "read_key")).alias("read"))
    )
    first = F.min(F.struct("match_rank", "ref.ref_no", "read.first_no", "ref.ref_key", "read.read_key"))
    return (
        ref_side.join(read_side, on)
        .groupBy("item_id")
        .agg(first.alias("m"))
        .select("item_id", "m.match_rank", "m.ref_no", "m.ref_key", F.col("m.read_key").alias("matched_key"))
    )


def _meeting_points(key: Column, alone: Column) -> Column:
    """Where a key meets others: (at, tail, rest), kind 2 at the skeleton or ``alone``, and there exactly by ``tail``.

    What makes two keys exactly equal holds their skeleton, unless it is shorter than one; then it is a point of its own,
    of kind 1. ``at`` begins with the kind. The key is cut into the three, so that a row carries none of it twice.
    """
    def at(kind: str, value: Column, tail: Column, rest: Column) -> Column:
        return F.struct(F.concat(F.lit(kind), value).alias("at"), tail.alias("tail"), rest.alias("rest"))

    exact, none = without_protonation(key), F.lit(None).cast("string")
    by_skeleton = F.coalesce(skeleton(key), alone)
    rest = F.substr(key, F.length(exact) + 1)
    short = F.array(at("1", exact, F.lit(""), rest), at("2", by_skeleton, none, key))
    long = F.array(at("2", by_skeleton, F.substr(exact, F.lit(SKELETON_LENGTH + 1)), rest))
    return F.when(skeleton(exact).isNotNull(), long).otherwise(short)


def _name_first_facts(refs: DataFrame, reads: DataFrame, tasks: int | None) -> DataFrame:
    """Everything the name-first rules ask about an item, in one row.

    References and family readings are rows of one table, grouped on the values they can meet on: exact matches first,
    within the skeletons, then matches of skeletons and agreement between families, then the item. One order serves all
    three, neither table is read twice and nothing is joined. A family counts in one row only. ``state`` is 0 for a family
    without a readable reading, 1 for one that wavers, 2 for a stable one, and NULL for a reference.
    """
    none = lambda kind: F.lit(None).cast(kind)
    ref_no, read_no = refs.schema["ref_no"].dataType, reads.schema["read_no"].dataType

    def nowhere(key: Column) -> Column:
        return F.array(F.struct(F.lit("0").alias("at"), none("string").alias("tail"), key.alias("rest")))

    key = F.col("inchikey")
    named = (
        refs.select("item_id", "ref_no", F.inline(F.when(key != "", _meeting_points(key, F.lit(""))).otherwise(nowhere(key))))
        .groupBy("item_id", "at", "tail")
        .agg(F.min(F.struct("ref_no", "rest")).alias("ref"))
        .select(
            "item_id", "at", "tail", "ref.rest", "ref.ref_no", none(read_no).alias("first_no"),
            none("double").alias("max_confidence"), none("int").alias("state"),
        )
    )
    # Grouped by the whole key, which no row then carries twice: skeletons of the first and the last key are the first and the last skeleton.
    families = family_reads(reads, F.when(key != "", key), best=F.col("_group"))
    best, group = F.col("best"), skeleton_or_key(F.col("low_group"))
    stable = F.coalesce(group == skeleton_or_key(F.col("high_group")), F.lit(False))
    # Readings too short for a skeleton agree where they are equal, but match any reference that is too short.
    any_short = F.array(F.struct(F.lit("2").alias("at"), none("string").alias("tail"), best.alias("rest")))
    points = F.concat(_meeting_points(best, group), F.when(skeleton(best).isNull(), any_short).otherwise(F.array()))
    counts = F.col("at").startswith("2") & (F.col("at") != "2")
    seen = families.select(
        "item_id", "first_no", "max_confidence", "n_readable", stable.alias("stable"),
        F.inline(F.when(stable, points).otherwise(nowhere(none("string")))),
    ).select(
        "item_id", "at", "tail", "rest", none(ref_no).alias("ref_no"), "first_no", "max_confidence",
        F.when(F.col("stable") & counts, 2).when(F.col("n_readable") > 0, 1).otherwise(0).alias("state"),
    )

    def match(rank: int) -> Column:
        return F.struct(
            F.lit(rank).alias("match_rank"), F.col("ref.ref_no"), F.col("read.first_no"), F.col("ref.ref_key"),
            F.col("read.key").alias("matched_key"),
        )

    def grouped(rows: DataFrame, on: list[str], ref: Column, read: Column, n_stable: Column, *more: Column) -> DataFrame:
        return rows.groupBy(*on).agg(
            F.min(ref).alias("ref"), F.min(read).alias("read"), F.max("max_confidence").alias("max_confidence"),
            F.max("state").alias("state"), n_stable.alias("n_stable"), *more,
        )

    # Distinct readers and references only. Dealt out here, or one task would sort them beside what they come from.
    dealt = ("item_id", "at") if tasks is None else (tasks, "item_id", "at")
    points = named.repartition(*dealt).unionByName(seen.repartition(*dealt))
    # Keys and structs are put together after the rows are sorted.
    whole = F.when(F.col("tail").isNull(), F.col("rest")).otherwise(F.concat(F.substr("at", F.lit(2)), F.col("tail"), F.col("rest")))
    ref = F.when(F.col("state").isNull(), F.struct("ref_no", whole.alias("ref_key")))
    read = F.when(F.col("state").isNotNull() & (F.col("at") != "0"), F.struct("first_no", whole.alias("key")))
    exactly = grouped(points, ["item_id", "at", "tail"], ref, read, F.count_if(F.col("state") == 2))
    met = F.col("ref").isNotNull() & F.col("read").isNotNull()
    exact_match = F.min(F.when(met & F.col("tail").isNotNull(), match(1))).alias("m")
    ref, read = F.col("ref"), F.col("read")
    alike = grouped(exactly, ["item_id", "at"], ref, read, F.sum("n_stable"), exact_match)
    alike = alike if tasks is None else alike.repartition(tasks, "item_id")
    agreed = F.min(F.when(F.col("n_stable") >= 2, read)).alias("agreed")
    any_match = F.min(F.coalesce("m", F.when(F.col("at").startswith("2") & met, match(2)))).alias("m")
    return grouped(alike, ["item_id"], ref, read, F.sum("n_stable"), agreed, any_match).select(
        "item_id", F.col("ref").alias("first_ref"), "state", "max_confidence", "n_stable",
        F.col("read").alias("first_stable"), "agreed", "m.*",
    )


def judge_name_first(
    refs: DataFrame, reads: DataFrame, threshold: float = MIN_CONFIDENCE, tasks: int | None = None
) -> DataFrame:
    """One finding per item that has references or readings.

    Readable readings are held against the name first; agreement between families only grades
    errors. Any doubt along the way abstains. Who knows the size of the tables gives the number of ``tasks``, and what
    one of them sorts does not grow with the tables; without it the session's number holds.
    """
    facts = _name_first_facts(refs, reads, tasks)
    reason = (
        F.when(F.col("first_ref").isNull(), "no_name")
        .when(F.col("state").isNull(), "no_engine")
        .when(F.col("max_confidence") < threshold, "low_confidence")
        .when(F.col("state") == 0, "unparseable")
        .when(F.col("n_stable") == 0, "self_inconsistent")
        .when(F.col("match_rank") == 1, "exact")
        .when(F.col("match_rank") == 2, "skeleton")
        .when(F.col("agreed").isNotNull(), "agreed_other")
        .when(F.col("n_stable") < 2, "single_family_other")
        .otherwise("families_disagree")
    )
    verdict = (
        F.when(F.col("reason") == "exact", "ok")
        .when(F.col("reason") == "skeleton", "warn")
        .when(F.col("reason").isin("agreed_other", "single_family_other", "families_disagree"), "error")
        .otherwise("abstain")
    )
    matched = F.col("verdict").isin("ok", "warn")
    erred = F.col("verdict") == "error"
    return (
        facts.withColumn("reason", reason)
        .withColumn("verdict", verdict)
        .select(
            "item_id",
            "verdict",
            F.when(erred, F.when(F.col("reason") == "agreed_other", "strong").otherwise("weak")).alias("grade"),
            "reason",
            F.when(matched, F.col("ref_no")).alias("ref_no"),
            F.when(matched, F.col("ref_key")).otherwise(F.col("first_ref.ref_key")).alias("ref_key"),
            F.when(matched, F.col("matched_key"))
            .when(erred, F.coalesce("agreed.key", "first_stable.key"))
            .alias("predicted_key"),
        )
    )


def judge_naive(refs: DataFrame, reads: DataFrame) -> DataFrame:
    """Baseline without any reticence: first reference against first reading."""
    ref = refs.groupBy("item_id").agg(F.min_by("inchikey", "ref_no").alias("ref_key"), F.lit(True).alias("_named"))
    read = reads.groupBy("item_id").agg(
        F.min_by(F.struct("inchikey"), "read_no").alias("first"), F.lit(True).alias("_read")
    )
    key = F.when(F.col("first.inchikey") != "", F.col("first.inchikey"))
    reason = (
        F.when(F.col("_named").isNull(), "no_name")
        .when(F.col("_read").isNull(), "no_result")
        .when(key.isNull(), "unparseable")
        .when(compare_keys(F.col("ref_key"), key) == EXACT, "exact")
        .otherwise("different")
    )
    verdict = (
        F.when(F.col("reason") == "exact", "ok").when(F.col("reason") == "different", "error").otherwise("abstain")
    )
    return (
        ref.join(read, "item_id", "full")
        .withColumn("reason", reason)
        .select(
            "item_id", verdict.alias("verdict"), "reason", "ref_key", key.alias("predicted_key")
        )
    )


def consensus_policy(reads: DataFrame) -> DataFrame:
    """Answer only when at least two families share one skeleton."""
    reason = (
        F.when(F.col("n_readable") == 0, "unreadable")
        .when(F.col("low_group") != F.col("high_group"), "skeletons_differ")
        .when(F.col("n_families") < 2, F.concat(F.lit("one_family:"), F.col("first_family")))
        .otherwise("agreed")
    )
    return (
        item_summary(family_reads(reads))
        .withColumn("reason", reason)
        .select("item_id", F.when(F.col("reason") == "agreed", F.col("best.inchikey")).alias("decision_key"), "reason")
    )


def confidence_policy(reads: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Trust the best-scored reading above the threshold; without any score trust the first."""
    score = F.col("best.confidence")
    reason = (
        F.when(F.col("n_readable") == 0, "unreadable")
        .when(score < threshold, F.format_string("low_confidence:%.2f", score))
        .when(score.isNull(), "unscored")
        .otherwise("scored")
    )
    return (
        item_summary(family_reads(reads))
        .withColumn("reason", reason)
        .select(
            "item_id",
            F.when(F.col("reason").isin("scored", "unscored"), F.col("best.inchikey")).alias("decision_key"),
            "reason",
        )
    )


def name_first_policy(refs: DataFrame, threshold: float = MIN_CONFIDENCE):
    """The name-first verdict as a policy: ok and warn answer, error answers something else."""

    def policy(reads: DataFrame) -> DataFrame:
        found = judge_name_first(refs, reads, threshold)
        return found.select(
            "item_id", F.when(F.col("verdict") != "abstain", F.col("predicted_key")).alias("decision_key"), "reason"
        )

    return policy


POLICIES = {"consensus": consensus_policy, "confidence": confidence_policy}


# Service rules -----------------------------------------------------------------------------


def _valid(read: Column) -> Column:
    """A reading counts when it has a key and its structure string shows no sign of guessing."""
    return (read["inchikey"] != "") & fm.unreadable_marks(read["raw"]).isNull()


def judge_service(requests: DataFrame) -> DataFrame:
    """Verdict per check request; a projection, since a request row carries its own readings.

    ``requests(request_id, name, ref_name, ref_key, ref_formula, ref_smiles, reads)`` where
    ``reads`` is an array of (engine, raw, inchikey, confidence) and the ``ref_*`` columns are
    NULL for an unresolved name. Adds ``verdict``, ``grade``, ``primary`` and ``reasons``
    (codes, in order); where valid readings differ in the skeleton also ``split_reads``, what each of
    them read, and ``winner``, the reader whose skeleton is the name's, if there is one.
    """
    reads, valid = F.col("reads"), F.col("_valid")
    ref_skeleton = skeleton(F.col("ref_key"))
    skeletons = F.array_distinct(F.transform(valid, lambda r: F.coalesce(skeleton(r["inchikey"]), F.lit(""))))
    agreeing = F.filter(valid, lambda r: skeleton(r["inchikey"]) == ref_skeleton)
    primary = F.when(F.col("_split") & (F.size("_agreeing") > 0), F.get("_agreeing", F.lit(0))).otherwise(
        F.coalesce(F.get(valid, F.lit(0)), F.get(reads, F.lit(0)))
    )
    # No column: few rules ask for it, and only for those rows it is worked out.
    ref_formula = fm.heavy_atom_formula(F.col("ref_smiles"))
    prepared = (
        requests.withColumn("_valid", F.filter(F.coalesce(reads, F.array()), _valid))
        .withColumn("_agreeing", agreeing)
        .withColumn("_split", (F.size(valid) >= 2) & (F.size(skeletons) > 1))
        .withColumn("primary", primary)
        .withColumn("_read_formula", fm.heavy_atom_formula(F.col("primary.raw")))
        .withColumn("_nonsense", F.coalesce(fm.nonsense_size(ref_formula, F.col("_read_formula")), F.lit(False)))
    )
    no_ref = F.col("ref_key").isNull()
    read_skeleton = skeleton(F.col("primary.inchikey"))
    rule = (
        F.when(F.col("_split") & (F.size("_agreeing") > 0), "split_name_decides")
        .when(F.col("_split"), "split")
        .when(F.col("_nonsense"), "nonsense_size")
        .when(F.col("primary").isNull(), "no_reading")
        .when(F.size(valid) == 0, "not_a_structure")
        .when(no_ref, "no_reference")
        .when(read_skeleton == ref_skeleton, "same_skeleton")
        .otherwise("other_skeleton")
    )
    strength = F.when(F.size(valid) >= 2, "strong").otherwise("weak")
    verdict = (
        F.when(F.col("_rule").isin("split_name_decides", "same_skeleton"), "match")
        .when(F.col("_rule") == "other_skeleton", "mismatch")
        .otherwise("unreadable")
    )
    grade = F.when(F.col("_rule") == "split_name_decides", "weak").when(
        F.col("_rule").isin("no_reference", "same_skeleton", "other_skeleton"), strength
    )
    def mark(read: Column) -> Column:
        found = fm.unreadable_marks(read["raw"])
        return F.when(found.isNotNull(), F.concat(read["engine"], F.lit(" "), found))

    marks = F.array_compact(F.transform(F.coalesce(reads, F.array()), mark))
    formula_differs = F.when(
        F.col("_rule").isin("not_a_structure", "other_skeleton"),
        let(
            ref_formula,
            lambda ref: F.when(
                F.col("_read_formula") != ref, F.concat_ws(":", F.lit("heavy_formula"), F.col("_read_formula"), ref)
            ),
        ),
    )
    not_found = F.when(no_ref & ~F.col("_split"), "name_not_found")
    reasons = F.concat(marks, F.array_compact(F.array(not_found, F.col("_rule"), formula_differs)))
    return (
        prepared.withColumn("_rule", rule)
        .withColumn("verdict", verdict)
        .withColumn("grade", grade)
        .withColumn("reasons", reasons)
        .withColumn("split_reads", F.when(F.col("_split"), F.transform("_valid", lambda r: F.struct(r["engine"].alias("engine"), skeleton(r["inchikey"]).alias("skeleton")))))
        .withColumn("winner", F.when(F.col("_split"), F.get("_agreeing", F.lit(0))["engine"]))
        .withColumn("rule", F.col("_rule"))
        .drop("_valid", "_agreeing", "_split", "_nonsense", "_rule")
        .withColumnRenamed("_read_formula", "read_formula")
    )


def check_response(judged: DataFrame) -> DataFrame:
    """The frozen response contract as one JSON string per request.

    On a split the reasons also say, before the rule, who read which skeleton and, after it, who is right.
    """
    told = F.transform("split_reads", lambda r: F.concat_ws(":", F.lit("read_as"), r["engine"], r["skeleton"]))
    winner = F.array_compact(F.array(F.concat(F.lit("winner:"), F.col("winner"))))
    marks = F.filter("reasons", lambda r: r != F.col("rule"))
    reasons = F.when(F.col("split_reads").isNotNull(), F.concat(marks, told, F.array("rule"), winner)).otherwise(F.col("reasons"))
    engine = F.transform(
        F.coalesce("reads", F.array()),
        lambda r: F.struct(
            r["engine"].alias("engine"),
            r["raw"].alias("smiles"),
            r["inchikey"].alias("inchikey"),
            fm.largest_fragment_formula(r["raw"]).alias("heavy_formula"),
            json_confidence(r["confidence"]).alias("confidence"),
        ),
    )
    reference = F.when(
        F.col("ref_key").isNotNull() & ~((F.col("rule") == "no_reference")),
        F.struct(
            F.col("ref_name").alias("name"),
            F.nullif("ref_smiles", F.lit("")).alias("smiles"),
            F.col("ref_key").alias("inchikey"),
            F.nullif("ref_formula", F.lit("")).alias("formula"),
        ),
    )
    # Without a valid reading the primary one is only what was seen; its key says nothing.
    valid_key = F.when(_valid(F.col("primary")), F.col("primary.inchikey"))
    body = F.struct(
        "verdict",
        "grade",
        reference.alias("reference"),
        F.struct(
            F.col("primary.raw").alias("smiles"),
            valid_key.alias("inchikey"),
            F.col("read_formula").alias("heavy_formula"),
            engine.alias("engines"),
        ).alias("read"),
        reasons.alias("reasons"),
    )
    return judged.select("request_id", "verdict", "grade", F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))
