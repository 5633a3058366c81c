"""What several readers say about one item.

``reads(item_id, read_no, engine, inchikey, confidence)`` holds one row per reading; a failed
reading is a row with a NULL key. Nothing below collects an item's readings: every step is a
grouped aggregate whose partial results combine on the map side, so an item that owns a large
share of the table costs no more than its distinct readers and skeletons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.functions.keys import (
    confidence_or_floor,
    engine_family,
    known_confidence,
    skeleton,
    skeleton_or_key,
)
from structaudit.operators.ranking import numbered
from structaudit.sources.shared import stored


def _first_best() -> Column:
    """Highest score wins, absent scores lose, the earlier reading wins a tie."""
    return F.struct(confidence_or_floor(F.col("confidence")), -F.col("read_no"))


def _reading() -> Column:
    return F.struct("inchikey", known_confidence(F.col("confidence")).alias("confidence"), "read_no", "engine")


def family_reads(reads: DataFrame, group: Column | None = None, best: Column | None = None) -> DataFrame:
    """One row per item and reader family.

    ``group`` is what two readings must share to agree (default: the skeleton); where it is NULL
    the reading is unreadable. ``best`` is the family's best readable reading, ``first_no`` its
    first one, ``one_group`` tells whether all its readable readings agree. Who needs only a part of the
    best reading names it as ``best``: what a task sorts is then that much smaller.
    """
    best = _reading() if best is None else best
    group = skeleton(F.col("inchikey")) if group is None else group
    usable = F.col("_group").isNotNull()
    return (
        reads.withColumn("family", engine_family(F.col("engine")))
        .withColumn("_group", group)
        .groupBy("item_id", "family")
        .agg(
            F.count("*").alias("n_reads"),
            F.count("_group").alias("n_readable"),
            F.max(known_confidence(F.col("confidence"))).alias("max_confidence"),
            F.max(F.when(usable, known_confidence(F.col("confidence")))).alias("max_readable_confidence"),
            F.min("_group").alias("low_group"),
            F.max("_group").alias("high_group"),
            F.min(F.when(usable, F.col("inchikey"))).alias("low_key"),
            F.max(F.when(usable, F.col("inchikey"))).alias("high_key"),
            F.max_by(best, F.when(usable, _first_best())).alias("best"),
            F.min(F.when(usable, F.col("read_no"))).alias("first_no"),
        )
        .withColumn("one_group", F.col("low_group") == F.col("high_group"))
    )


def best_per_family(reads: DataFrame) -> DataFrame:
    """Best readable reading of each family; families without one are left out."""
    return family_reads(reads).where("n_readable > 0").select("item_id", "family", "best.*")


def item_summary(families: DataFrame) -> DataFrame:
    """One row per item from :func:`family_reads`."""
    readable = F.col("n_readable") > 0
    return families.groupBy("item_id").agg(
        F.sum("n_reads").alias("n_reads"),
        F.sum("n_readable").alias("n_readable"),
        F.count_if(readable).alias("n_families"),
        F.max("max_confidence").alias("max_confidence"),
        F.max("max_readable_confidence").alias("max_readable_confidence"),
        F.min("low_group").alias("low_group"),
        F.max("high_group").alias("high_group"),
        (F.min("low_key") != F.max("high_key")).alias("keys_differ"),
        F.min(F.when(readable, F.col("family"))).alias("first_family"),
        F.max_by(
            "best", F.when(readable, F.struct(F.coalesce("best.confidence", F.lit(-1.0)), -F.col("best.read_no")))
        ).alias("best"),
    )


def agreement(reads: DataFrame) -> DataFrame:
    """Candidates: readable readings grouped by skeleton, with a representative and a rank.

    Ranked by number of families, then score (absent lowest), then first appearance. The ranks read the candidates
    once for every cut of an item, so the candidates are stored.
    """
    per_family = (
        reads.withColumn("family", engine_family(F.col("engine")))
        .withColumn("skeleton", skeleton(F.col("inchikey")))
        .where(F.col("skeleton").isNotNull())
        .groupBy("item_id", "skeleton", "family")
        .agg(
            F.count("*").alias("n_reads"),
            F.max(known_confidence(F.col("confidence"))).alias("confidence"),
            F.min("read_no").alias("first_no"),
            F.min("inchikey").alias("low_key"),
            F.max("inchikey").alias("high_key"),
            F.max_by(F.struct("inchikey", known_confidence(F.col("confidence")).alias("confidence"), "read_no"), _first_best()).alias("best"),
        )
    )
    candidates = per_family.groupBy("item_id", "skeleton").agg(
        F.max_by(
            "best.inchikey", F.struct(F.coalesce("best.confidence", F.lit(-1.0)), -F.col("best.read_no"))
        ).alias("inchikey"),
        F.sum("n_reads").alias("n_reads"),
        F.count("*").alias("n_families"),
        F.array_sort(F.collect_set("family")).alias("families"),
        F.max("confidence").alias("confidence"),
        F.min("first_no").alias("first_no"),
        (F.min("low_key") != F.max("high_key")).alias("stereo_differs"),
    )
    order = [F.desc("n_families"), F.desc(F.coalesce("confidence", F.lit(-1.0))), F.asc("first_no")]
    ahead = F.struct(-F.col("n_families"), -F.coalesce("confidence", F.lit(-1.0)))
    # Candidates of one reader without scores are all alike to ``ahead``; their numbers cut them further.
    finer = F.struct(-F.col("n_families"), -F.coalesce("confidence", F.lit(-1.0)), F.floor(F.col("first_no") / 4096))
    return numbered(stored(candidates), ["item_id"], order, "rank", [finer, ahead])


def candidate_contrasts(candidates: DataFrame) -> DataFrame:
    """Every lower-ranked candidate beside the leading one of its item.

    The audited tool draws all pairs of an item's candidates; the pairs grow with the square of
    the candidates, so the rest are set against the leader only.
    """
    leader = candidates.where("rank = 1").select("item_id", F.col("inchikey").alias("leader_key"))
    return (
        candidates.where("rank > 1")
        .join(leader, "item_id")
        .select("item_id", "leader_key", "rank", "inchikey", "n_families", "confidence")
    )


def recognition_status(reads: DataFrame, items: DataFrame) -> DataFrame:
    """Status per item: no_engine, unreadable, no_result, uncertain, single or agreed.

    ``items`` may carry ``has_engine`` and ``image_ok``; both default to true. ``answer_key`` is
    set for agreed items only; ``stereo_differs`` flags agreement on the skeleton alone.
    """
    has_engine = F.col("has_engine") if "has_engine" in items.columns else F.lit(True)
    image_ok = F.col("image_ok") if "image_ok" in items.columns else F.lit(True)
    known = items.select("item_id", has_engine.alias("_has_engine"), image_ok.alias("_image_ok"))
    status = (
        F.when(~F.col("_has_engine"), "no_engine")
        .when(~F.col("_image_ok"), "unreadable")
        .when(F.coalesce("n_readable", F.lit(0)) == 0, "no_result")
        .when(F.col("low_group") != F.col("high_group"), "uncertain")
        .when(F.col("n_families") < 2, "single")
        .otherwise("agreed")
    )
    return (
        known.join(item_summary(family_reads(reads)), "item_id", "left")
        .withColumn("status", status)
        .select(
            "item_id",
            "status",
            F.coalesce("n_families", F.lit(0)).alias("n_families"),
            (F.coalesce("n_reads", F.lit(0)) - F.coalesce("n_readable", F.lit(0))).alias("n_unreadable"),
            F.when(F.col("status") == "agreed", F.col("best.inchikey")).alias("answer_key"),
            F.when(F.col("status") == "agreed", F.col("keys_differ")).alias("stereo_differs"),
        )
    )


def recognition_outcomes(reads: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`recognition_status` with its reason, where ``reads`` carry an ``error`` for annotators that failed.

    An item without a result either failed in every annotator that said anything (``failed``), was read as
    something that is no structure (``unparsed``), or showed nothing to find (``nothing``). A failed annotator
    never counts as one that found nothing: ``n_failed`` and ``first_error`` stay beside any status.
    """
    failed = F.col("error").isNotNull()
    told = reads.groupBy("item_id").agg(
        F.count_if(failed).alias("n_failed"), F.count_if(~failed & skeleton(F.col("inchikey")).isNull()).alias("n_unparsed"),
        F.min("error").alias("first_error"),
    )
    # A failed reading names nothing, whatever else it may carry.
    status = recognition_status(reads.withColumn("inchikey", F.when(~failed, F.col("inchikey"))), items)
    reason = (
        F.when(F.col("status") != "no_result", F.col("status"))
        .when(F.coalesce("n_unparsed", F.lit(0)) > 0, "unparsed")
        .when(F.coalesce("n_failed", F.lit(0)) > 0, "failed")
        .otherwise("nothing")
    )
    return status.join(told, "item_id", "left").select(
        "item_id", "status", reason.alias("reason"), "n_families", F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        F.coalesce("n_unparsed", F.lit(0)).alias("n_unparsed"), "first_error", "answer_key",
    )


def stable_reads(reads: DataFrame) -> DataFrame:
    """One reading per family that agrees with itself; a family that wavers drops out."""
    families = family_reads(reads, skeleton_or_key(F.col("inchikey")))
    return _stable(families)


def _stable(families: DataFrame) -> DataFrame:
    return families.where("one_group").select(
        "item_id",
        "family",
        F.col("low_group").alias("skeleton"),
        F.col("best.inchikey").alias("inchikey"),
        F.col("best.confidence").alias("confidence"),
        "first_no",
    )


def agreed_skeleton(stable: DataFrame) -> DataFrame:
    """First skeleton per item that at least two families stand behind."""
    return (
        stable.groupBy("item_id", "skeleton")
        .agg(
            F.count("*").alias("n_families"),
            F.min("first_no").alias("first_no"),
            F.min_by("inchikey", "first_no").alias("agreed_key"),
        )
        .where("n_families >= 2")
        .groupBy("item_id")
        .agg(
            F.min_by("skeleton", "first_no").alias("agreed_skeleton"),
            F.min_by("agreed_key", "first_no").alias("agreed_key"),
        )
    )
