"""Names to keys and keys to names.

A dictionary is ``(name_key, inchikey, formula, smiles, iupac, title, cid)`` with one row per
name. Lookups are equi-joins without hints: Spark broadcasts a side only after measuring it, and
splits a skewed side of a sort-merge join at run time. Queries are made distinct first, so a name
that fills a third of the pages is still looked up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structaudit.functions import text as tx
from structaudit.functions.formula import principal_fragment
from structaudit.functions.keys import is_valid_key, skeleton


def _names(dict_df: DataFrame) -> DataFrame:
    wanted = {
        "name_key": "string", "inchikey": "string", "formula": "string", "smiles": "string",
        "iupac": "string", "title": "string", "cid": "bigint", "principal_inchikey": "string",
    }
    have = set(dict_df.columns)
    return dict_df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()]
    )


def name_key(name):
    return F.lower(F.trim(name))


def resolve_exact(queries: DataFrame, dict_df: DataFrame) -> DataFrame:
    """Queries whose lower-cased text is a dictionary name."""
    asked = queries.select("query").distinct().withColumn("name_key", name_key(F.col("query")))
    return asked.join(dict_df, "name_key")


def lookup_each(rows: DataFrame, dict_df: DataFrame) -> DataFrame:
    """``rows`` (with a ``query``) beside the dictionary row of that name: one pass over ``rows``, which is not made distinct first.

    For rows that are few per name, or cost more to make than to look up. The names of a dictionary written by
    :func:`structaudit.sources.writers.write_dictionary_table` are not shuffled.
    """
    return rows.withColumn("name_key", name_key(F.col("query"))).join(dict_df, "name_key")


def effective_dictionary(shipped: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """What a lookup sees per name: the cache first, then the shipped table.

    A cached negative (a row without a key) hides the name; a cached row without a structure
    string does not count as cached.
    """
    base = _names(shipped).withColumn("source", F.lit("offline"))
    if cache is None:
        return base
    cached = _names(cache).where("inchikey is null or smiles <> ''").withColumn("source", F.lit("cache"))
    return base.join(cached, "name_key", "left_anti").unionByName(cached.where("inchikey is not null"))


def resolve(queries: DataFrame, shipped: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """First spelling of each query that some source knows; carries the spelling that hit.

    A dictionary may hold ``principal_inchikey``, the key of a record's main component. It stands in for
    the record's own key where that component stands out: a salt is judged by its parent's drawing.
    """
    tried = (
        queries.select("query")
        .distinct()
        .select("query", F.posexplode(tx.spelling_variants(F.col("query"))).alias("variant_no", "variant"))
        .withColumn("name_key", name_key(F.col("variant")))
        .where("name_key <> ''")
    )
    hits = tried.join(effective_dictionary(shipped, cache), "name_key")
    first = F.min_by(F.struct("variant", "inchikey", "formula", "smiles", "source", "principal_inchikey"), "variant_no")
    smiles, parent = F.col("hit.smiles"), F.col("hit.principal_inchikey")
    salt = (parent != "") & smiles.contains(".") & (principal_fragment(smiles) != smiles)
    return (
        hits.groupBy("query")
        .agg(first.alias("hit"))
        .select(
            "query",
            F.col("hit.variant").alias("matched_name"),
            F.when(salt, parent).otherwise(F.col("hit.inchikey")).alias("inchikey"),
            F.coalesce("hit.formula", F.lit("")).alias("formula"),
            F.coalesce("hit.smiles", F.lit("")).alias("smiles"),
            "hit.source",
        )
    )


def resolve_loose(queries: DataFrame, dict_df: DataFrame, loose_df: DataFrame) -> DataFrame:
    """Exact normal form first, else the loose form through ``loose_df(alias_key, inchikey)``."""
    table = _names(dict_df)
    by_key = table.groupBy("inchikey").agg(
        F.max_by(F.struct("title", "smiles", "cid"), "name_key").alias("row")
    )
    asked = (
        queries.select("query")
        .distinct()
        .withColumn("name_key", tx.normalize_exact(F.col("query")))
        .withColumn("alias_key", tx.normalize_loose(F.col("query")))
    )
    exact = table.select("name_key", F.col("inchikey").alias("exact_key"), F.col("title").alias("exact_title"))
    # Only queries with an alias reach the second join, so that misses do not meet on one empty key.
    loose = (
        asked.join(loose_df.select("alias_key", F.col("inchikey").alias("loose_key")), "alias_key")
        .join(by_key.select(F.col("inchikey").alias("loose_key"), "row"), "loose_key")
        .select("query", "loose_key", "row")
    )
    found = asked.join(exact, "name_key", "left").join(loose, "query", "left")
    exact_hit = F.col("exact_key").isNotNull()
    return found.select(
        "query",
        F.when(exact_hit, F.col("exact_key")).when(F.col("row").isNotNull(), F.col("loose_key")).alias("inchikey"),
        F.when(exact_hit, F.col("exact_title")).otherwise(F.col("row.title")).alias("title"),
        F.when(exact_hit, "exact").when(F.col("row").isNotNull(), "alias").alias("source"),
    ).where("inchikey is not null")


def alias_lookup(queries: DataFrame, alias_df: DataFrame, in_text: bool = False) -> DataFrame:
    """English target of a Hangul name through ``alias_df(alias_key, target, whole_only, ord)``.

    A vitamin needs no table. Otherwise the name as it is, then with each particle removed,
    longest particle first. Names that are everyday words count only when the whole query is
    the name, not in running text.
    """
    table = alias_df.where("not whole_only") if in_text else alias_df
    particles = sorted(tx.PARTICLES, key=len, reverse=True)
    run = F.trim("query")
    stems = [F.struct(F.lit(0).alias("rank"), tx.ko_key(run).alias("alias_key"))] + [
        F.struct(
            F.lit(i).alias("rank"),
            F.when(run.endswith(p), tx.ko_key(F.substr(run, F.lit(1), F.length(run) - len(p)))).alias("alias_key"),
        )
        for i, p in enumerate(particles, start=1)
    ]
    asked = queries.select("query").distinct().withColumn("vitamin", tx.vitamin_name(F.col("query")))
    tried = asked.where("vitamin is null").select("query", F.inline(F.array(*stems))).where("alias_key is not null")
    known = table.select("alias_key", "target", F.col("whole_only").cast("int").alias("second_table"))
    hits = (
        tried.join(known, "alias_key")
        .groupBy("query")
        .agg(F.min_by("target", F.struct("rank", "second_table")).alias("target"))
    )
    return asked.where("vitamin is not null").select("query", F.col("vitamin").alias("target")).unionByName(hits)


def alias_runs(alias_df: DataFrame) -> DataFrame:
    """(run, target): the runs of Hangul alone that :func:`alias_lookup` knows in running text.

    Such a run is its own key. It is a stem and one of the particles or none, and the table is not larger than that many
    times the aliases.
    """
    particles = ["", *sorted(tx.PARTICLES, key=len, reverse=True)]
    ends = F.posexplode(F.array(*[F.lit(p) for p in particles])).alias("rank", "particle")
    return (
        alias_df.where("not whole_only")
        .select("alias_key", "target", ends)
        .groupBy(F.concat("alias_key", "particle").alias("run"))
        .agg(F.min_by("target", "rank").alias("target"))
    )


def lookup_route(queries: DataFrame, alias_df: DataFrame) -> DataFrame:
    """The name to look up for each query: Hangul through the alias table, the rest as it is."""
    asked = queries.select("query").distinct()
    hangul = alias_lookup(asked.where(tx.has_hangul(F.col("query"))), alias_df)
    return asked.join(hangul, "query", "left").select(
        "query", F.coalesce("target", F.trim("query")).alias("name")
    )


def invert_dictionary(dict_df: DataFrame) -> DataFrame:
    """Names per key: the first row with a title gives title and systematic name, else the shortest name."""
    table = _names(dict_df)
    titled = F.when(F.col("title") != "", F.col("name_key"))
    return (
        table.groupBy("inchikey")
        .agg(
            F.min_by(F.struct("title", "iupac"), titled).alias("first"),
            F.min_by("name_key", F.struct(F.length("name_key"), F.col("name_key"))).alias("shortest"),
            F.count("*").alias("n_names"),
        )
        .select(
            "inchikey",
            F.coalesce("first.title", "shortest").alias("common"),
            F.coalesce("first.iupac", F.lit("")).alias("iupac"),
            "n_names",
        )
    )


def names_for(keys: DataFrame, dict_df: DataFrame, fallback: str | None = None) -> DataFrame:
    """Names of exactly this key. ``fallback='skeleton'`` also takes a stereo-isomer's name.

    Borrowing a name from another isomer is a guess, so the fallback is off by default.
    """
    asked = (
        keys.select(F.upper(F.trim("inchikey")).alias("inchikey")).distinct().where(is_valid_key(F.col("inchikey")))
    )
    names = invert_dictionary(dict_df)
    exact = asked.join(names, "inchikey", "left" if fallback else "inner")
    if not fallback:
        return exact
    by_skeleton = names.groupBy(skeleton(F.col("inchikey")).alias("_skeleton")).agg(
        F.max_by(F.struct("common", "iupac", "n_names"), "inchikey").alias("near")
    )
    borrowed = exact.withColumn("_skeleton", skeleton(F.col("inchikey"))).join(by_skeleton, "_skeleton", "left")
    return borrowed.where("common is not null or near is not null").select(
        "inchikey",
        *[F.coalesce(c, f"near.{c}").alias(c) for c in ("common", "iupac", "n_names")],
    )


def names_for_cached(keys: DataFrame, dict_df: DataFrame, cache: DataFrame) -> DataFrame:
    """Names of exactly this key, from ``cache(inchikey, title, iupac)`` first, then from the dictionary.

    A cached key without title and iupac is a known miss: it answers nothing, and the dictionary is not asked.
    """
    asked = keys.select(F.upper(F.trim("inchikey")).alias("inchikey")).distinct()
    held = cache.groupBy(F.upper(F.trim("inchikey")).alias("inchikey")).agg(
        F.max(F.struct(F.col("title").alias("common"), "iupac")).alias("held")
    )
    known = (
        asked.where(is_valid_key(F.col("inchikey"))).join(held, "inchikey")
        .where("held.common is not null or held.iupac is not null")
        .select("inchikey", *[F.coalesce(f"held.{c}", F.lit("")).alias(c) for c in ("common", "iupac")], F.lit("cache").alias("source"))
    )
    rest = names_for(asked.join(held, "inchikey", "left_anti"), dict_df)
    return known.unionByName(rest.select("inchikey", "common", "iupac", F.lit("offline").alias("source")))


def localised_name(keys: DataFrame, dict_df: DataFrame, alias_df: DataFrame) -> DataFrame:
    """Hangul name of a key: through its title, its systematic name, then its names, shortest first.

    Of several aliases for one target the first declared wins.
    """
    reverse = alias_df.groupBy(F.lower("target").alias("english")).agg(F.min_by("alias", "ord").alias("korean"))
    named = names_for(keys, dict_df)
    spellings = (
        named.select("inchikey", F.lower("common").alias("english"), F.lit(0).alias("tier"))
        .unionByName(named.select("inchikey", F.lower("iupac").alias("english"), F.lit(1).alias("tier")))
        .unionByName(
            _names(dict_df).join(named.select("inchikey"), "inchikey", "left_semi")
            .select("inchikey", F.col("name_key").alias("english"), F.lit(2).alias("tier"))
        )
    )
    order = F.struct("tier", F.length("english"), F.col("english"))
    korean = spellings.join(reverse, "english").groupBy("inchikey").agg(F.min_by("korean", order).alias("korean"))
    return named.join(korean, "inchikey", "left").select("inchikey", "iupac", "common", "korean")


def display_name(korean, common, iupac):
    """``korean (common; iupac)``, or whichever part exists, or NULL."""
    latin = F.nullif(F.concat_ws("; ", F.nullif(common, F.lit("")), F.nullif(iupac, F.lit(""))), F.lit(""))
    both = F.concat(korean, F.lit(" ("), latin, F.lit(")"))
    return F.coalesce(F.when(korean.isNotNull() & latin.isNotNull(), both), korean, latin)
