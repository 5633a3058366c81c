"""Identifier keys: 14-character skeleton, 10-character stereo block, 1-character protonation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_PATTERN = "^[A-Z]{14}-[A-Z]{10}-[A-Z]$"
SKELETON_LENGTH = 14

EXACT = "exact"
SKELETON = "skeleton"
DIFFERENT = "different"
UNCOMPARABLE = "uncomparable"


def is_valid_key(key: Column) -> Column:
    """True for a well-formed key, ignoring case and surrounding blanks."""
    return F.upper(F.trim(key)).rlike(KEY_PATTERN)


def skeleton(key: Column) -> Column:
    """First block of the key, NULL when the key is too short to have one."""
    return F.when(F.length(key) >= SKELETON_LENGTH, F.substring(key, 1, SKELETON_LENGTH))


def skeleton_or_key(key: Column) -> Column:
    """The skeleton, or the key itself when it is too short; NULL only for NULL or empty keys."""
    return F.coalesce(skeleton(key), F.when(key != "", key))


def key_blocks(key: Column) -> Column:
    return F.split(key, "-")


def without_protonation(key: Column) -> Column:
    """Blocks one and two; two keys that agree here are the same structure."""
    return F.substring_index(key, "-", 2)


def compare_keys(left: Column, right: Column) -> Column:
    """exact | skeleton | different | uncomparable.

    Two keys that are both too short for a skeleton count as sharing one, hence the
    null-safe comparison.
    """
    missing = left.isNull() | right.isNull() | (left == "") | (right == "")
    return (
        F.when(missing, UNCOMPARABLE)
        .when(without_protonation(left) == without_protonation(right), EXACT)
        .when(skeleton(left).eqNullSafe(skeleton(right)), SKELETON)
        .otherwise(DIFFERENT)
    )


def engine_family(engine: Column) -> Column:
    """Reader kind behind a reader name: cut at the first ``/``, ``@`` or ``-``.

    The scoring half of the audited workflow leaves ``-`` alone; one rule is used here.
    """
    for mark in ("/", "@", "-"):
        engine = F.substring_index(engine, mark, 1)
    return engine


def known_confidence(confidence: Column) -> Column:
    """Absent scores are NULL. NaN must not survive ingest: Spark orders it above every number."""
    return F.when(~F.isnan(confidence), confidence)


def confidence_or_floor(confidence: Column) -> Column:
    return F.coalesce(known_confidence(confidence), F.lit(-1.0))


def json_confidence(confidence: Column) -> Column:
    """Score as the response carries it: four decimals, no NaN, no infinities."""
    finite = ~F.isnan(confidence) & (F.abs(confidence) != float("inf"))
    return F.when(finite, F.round(confidence, 4))


def confidence_bin(confidence: Column) -> Column:
    """Label of the score band; scores outside [0, 1.01) have none."""
    return (
        F.when(confidence < 0.0, None)
        .when(confidence < 0.8, "<0.8")
        .when(confidence < 0.85, "0.8~0.85")
        .when(confidence < 0.9, "0.85~0.9")
        .when(confidence < 1.01, "0.9+")
    )


def mean_token_confidence(tokens: Column) -> Column:
    """Mean of the token probabilities, NULL for an empty or missing list."""
    total = F.aggregate(tokens, F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.size(tokens) > 0, total / F.size(tokens))


def key_diff_mask(reference: Column, read: Column) -> Column:
    """One character per position of ``read``: ``=`` where it equals the reference, ``x`` elsewhere.

    Positions past the end of the reference differ. Without a reference nothing is marked.
    """
    at = F.sequence(F.lit(1), F.length(read))
    marks = F.transform(
        at, lambda i: F.when(F.substr(reference, i, F.lit(1)) == F.substr(read, i, F.lit(1)), "=").otherwise("x")
    )
    return (
        F.when(read.isNull() | (read == ""), "")
        .when(reference.isNull() | (reference == ""), F.repeat(F.lit("="), F.length(read)))
        .otherwise(F.array_join(marks, ""))
    )
