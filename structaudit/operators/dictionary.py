"""Building and checking the name dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structaudit.functions import text as tx
from structaudit.functions.keys import skeleton
from structaudit.operators.resolve import lookup_route, resolve

KINDS = ("en", "iupac", "ko", "abbr")


def unpivot_aliases(terms: DataFrame) -> DataFrame:
    """One row per term, kind and alias."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("aliases")) for k in KINDS]
    return (
        terms.select("id", "answer", F.inline(F.array(*kinds)))
        .select("id", "answer", "kind", F.posexplode("aliases").alias("ord", "alias"))
    )


def name_union(*sources: DataFrame) -> DataFrame:
    """Distinct lower-cased names of all sources, each with a ``name`` column."""
    every = reduce(DataFrame.unionByName, [s.select(F.lower("name").alias("name")) for s in sources])
    return every.distinct()


def todo(names: DataFrame, dict_df: DataFrame) -> DataFrame:
    """Names still to be looked up: those without an entry that has a structure string."""
    answered = dict_df.where("smiles <> ''").select(F.col("name_key").alias("name"))
    return names.join(answered, "name", "left_anti")


def merge_dictionary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old entries with a structure string stay; new ones only fill in what is missing."""
    kept = old.where("smiles <> ''")
    added = new.join(kept.select("name_key"), "name_key", "left_anti")
    return kept.withColumn("added", F.lit(False)).unionByName(
        added.select(*old.columns).withColumn("added", F.lit(True))
    )


def korean_entries(aliases: DataFrame, dict_df: DataFrame) -> DataFrame:
    """Dictionary rows for every stored spelling of a Hangul alias whose target has an entry.

    ``aliases(alias, target, ord)``; on equal spellings the first alias wins.
    """
    entry = dict_df.withColumnRenamed("name_key", "target_key")
    spelled = aliases.select(
        "ord", F.lower(F.trim("target")).alias("target_key"),
        F.explode(tx.korean_key_variants(F.col("alias"))).alias("spelling"),
    )
    columns = [c for c in dict_df.columns if c != "name_key"]
    return (
        spelled.join(entry, "target_key")
        .groupBy(F.lower("spelling").alias("name_key"))
        .agg(F.min_by(F.struct(*columns), F.struct("ord", "spelling")).alias("row"))
        .select("name_key", "row.*")
    )


def dictionary_issues(new: DataFrame, old: DataFrame, aliases: DataFrame, expected: DataFrame) -> DataFrame:
    """What is wrong with a rebuilt table: (name_key, issue, have, want).

    ``conflict``: a name already stands for another key. ``missing_target``: an alias points at a
    name without an entry. ``wrong_compound``: a name resolves to another skeleton than expected.
    """
    was = old.select("name_key", F.col("inchikey").alias("want"))
    conflict = (
        new.select("name_key", F.col("inchikey").alias("have"))
        .join(was, "name_key")
        .where("have <> want")
        .select("name_key", F.lit("conflict").alias("issue"), "have", "want")
    )
    missing = (
        aliases.select("alias", F.lower(F.trim("target")).alias("name_key"))
        .join(new.select("name_key"), "name_key", "left_anti")
        .select("name_key", F.lit("missing_target").alias("issue"), F.lit(None).cast("string").alias("have"),
                F.col("alias").alias("want"))
    )
    wrong = (
        expected.select("name_key", F.col("inchikey").alias("want"))
        .join(new.select("name_key", F.col("inchikey").alias("have")), "name_key")
        .where(~skeleton(F.col("have")).eqNullSafe(skeleton(F.col("want"))))
        .select("name_key", F.lit("wrong_compound").alias("issue"), "have", "want")
    )
    return conflict.unionByName(missing).unionByName(wrong)


def loose_aliases(offers: DataFrame, dict_df: DataFrame) -> DataFrame:
    """Loose key -> key, first offer wins.

    ``offers(alias, inchikey, ord)``. A loose key that is itself a dictionary name is left out;
    an alias that is a dictionary name in its exact form takes that entry's key.
    """
    table = (
        dict_df.where("smiles <> ''")
        .groupBy(tx.normalize_exact(F.col("name_key")).alias("exact_key"))
        .agg(F.max_by("inchikey", "name_key").alias("exact_inchikey"))
    )
    keyed = (
        offers.where("inchikey <> ''")
        .withColumn("alias_key", tx.normalize_loose(F.col("alias")))
        .withColumn("exact_key", tx.normalize_exact(F.col("alias")))
        .where("alias_key <> ''")
    )
    known = table.select(F.col("exact_key").alias("alias_key"))
    return (
        keyed.join(known, "alias_key", "left_anti")
        .join(table, "exact_key", "left")
        .groupBy("alias_key")
        .agg(F.min_by(F.coalesce("exact_inchikey", "inchikey"), "ord").alias("inchikey"))
    )


def classify_names(aliases: DataFrame, dict_df: DataFrame, alias_df: DataFrame) -> DataFrame:
    """Class of every alias in ``aliases(id, kind, alias, expected_key)``: hit, or why not."""
    routed = lookup_route(aliases.select(F.col("alias").alias("query")), alias_df)
    found = resolve(routed.select(F.col("name").alias("query")), dict_df).select(
        F.col("query").alias("name"), "inchikey"
    )
    looked_up = aliases.join(routed.withColumnRenamed("query", "alias"), "alias").join(found, "name", "left")
    key, want = F.col("inchikey"), F.col("expected_key")
    hangul = tx.has_hangul(F.col("alias"))
    short_capitals = (F.length("alias") <= 6) & (F.upper("alias") == F.col("alias"))
    kind = (
        F.when(want.isNull(), "no_answer")
        .when(key == want, "hit")
        .when(skeleton(key) == skeleton(want), "stereo")
        .when(hangul & (F.col("name") == F.col("alias")), "ko_no_alias")
        .when(hangul & key.isNull(), "ko_alias_miss")
        .when(hangul, "ko_alias_wrong")
        .when(key.isNotNull(), "wrong_compound")
        .when(F.col("alias").rlike("[αβγδ]"), "en_greek")
        .when(short_capitals, "abbr_404")
        .when(F.col("alias").rlike("[0-9(]"), "iupac_404")
        .otherwise("en_404")
    )
    return looked_up.select("id", "kind", "alias", kind.alias("class"))


def name_coverage(aliases: DataFrame, dict_df: DataFrame, alias_df: DataFrame) -> DataFrame:
    """Number of aliases per kind and class."""
    return classify_names(aliases, dict_df, alias_df).groupBy("kind", "class").agg(F.count("*").alias("n"))
