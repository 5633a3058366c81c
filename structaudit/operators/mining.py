"""Text pages to scored candidate names.

``docs`` carry the text whole. A page whose text is stored in several rows passes the column
that orders them as ``part``; lines are then numbered within (part, line).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.functions import text as tx
from structaudit.functions.binding import let
from structaudit.operators.ranking import top_k
from structaudit.operators.resolve import alias_runs, resolve
from structaudit.sources.shared import stored

MIN_PHRASE, MAX_PHRASE = 3, 120
DICTIONARY_HIT = 100.0
VITAMIN_HIT = 4.0


def dealt(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``docs`` over many small tasks, because mining a text costs far more than moving it.

    A file's row groups are few and large. The number of tasks is given, or adaptive execution would join
    them again by their bytes, which are few for the work in them.
    """
    return docs.repartition(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def lines(docs: DataFrame, ids: Sequence[str], text: str, part: str | None = None) -> DataFrame:
    """One row per line; a final line break does not open another line."""
    # Bound, or the whole text would be split again for every empty line.
    kept = let(
        tx.split_lines(F.col(text)),
        lambda pieces: F.filter(pieces, lambda line, i: (line != "") | (i < F.size(pieces) - 1)),
    )
    at = F.col(part) if part else F.lit(0)
    return docs.select(*ids, at.cast("bigint").alias("part"), F.posexplode(kept).alias("line_no", "line"))


def tokens(docs: DataFrame, ids: Sequence[str], text: str, part: str | None = None) -> DataFrame:
    """Cleaned tokens with their position in the line."""
    found = lines(docs, ids, text, part)
    return found.select(*ids, "part", "line_no", F.posexplode(tx.clean_tokens(F.col("line"))).alias("token_no", "token"))


def _position(source: int, words: int, start: Column | int) -> Column:
    """Order in which phrases are offered: by line, then source, then length, then place."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.struct(
        "part", "line_no", F.lit(source).alias("source"), F.lit(words).alias("words"), start.alias("start")
    )


def _offered(found: DataFrame, ids: Sequence[str], max_words: int, vitamins: bool) -> DataFrame:
    """What lines offer, in one pass: every word that may open a phrase that scores, with the next words, and vitamins if asked for.

    Columns w1 to w{max_words} and their flags f1 to f{max_words}, NULL past the end of the line; ``vitamin`` is
    NULL but for a vitamin, which has no words.
    """
    line, sizes = F.col("line"), range(1, max_words + 1)
    named = F.when(tx.may_name_vitamin(line), tx.vitamin_hits(line)) if vitamins else F.lit(None).cast("array<string>")
    words = found.select(
        *ids, "part", "line_no", tx.clean_tokens(line).alias("words"), tx.may_hold_fragment(line).alias("fragment"),
        named.alias("vitamins"),
    )
    flagged = words.withColumn("flags", F.transform("words", lambda w: tx.word_flags_in_line(w, F.col("fragment"))))

    def at(column: str, i: Column, n: int) -> Column:
        return F.get(F.col(column), i + (n - 1)).alias(f"{column[0]}{n}")

    def has(flags: Column, bits: int) -> Column:
        return flags.bitwiseAND(bits) > 0

    def may_score(i: Column) -> Column:
        scoring = has(at("flags", i, 1), tx.OPENS)
        for n in sizes[1:]:
            scoring = scoring | has(at("flags", i, n), tx.SCORES)
        return ~has(at("flags", i, 1), tx.BAD) & scoring

    def window(start: Column, vitamin: Column, *words: Column) -> Column:
        return F.struct(start.alias("start"), vitamin.alias("vitamin"), *words)

    # Few words have a bit that scores, so windows are looked for at these only.
    signals = F.array_compact(F.transform("flags", lambda f, i: F.when(f > tx.BAD, i)))
    near = F.transform(
        signals,
        lambda i: F.when(
            has(at("flags", i, 1), tx.SCORES), F.sequence(F.greatest(i - (max_words - 1), F.lit(0)), i)
        ).otherwise(F.array(i)),
    )
    none = F.lit(None).cast("string")
    # Not a filter of rows: it would be pushed below and have the words computed twice.
    offers = F.transform(
        F.filter(F.array_distinct(F.flatten(near)), may_score),
        lambda i: window(i, none, *[at("words", i, n) for n in sizes], *[at("flags", i, n) for n in sizes]),
    )
    if vitamins:
        empty = [none.alias(f"w{n}") for n in sizes] + [F.lit(None).cast("int").alias(f"f{n}") for n in sizes]
        hits = F.transform(F.coalesce("vitamins", F.array()), lambda v, i: window(i, v, *empty))
        offers = F.concat(hits, offers)
    return flagged.select(*ids, "part", "line_no", F.inline(offers))


def _scored(found: DataFrame, ids: Sequence[str], n_max: int, vitamins: bool = False) -> DataFrame:
    """Phrases of ``lines`` with score and place.

    A word is cleaned and tested once; a window's score only combines its words' bits. Windows
    are scored before any phrase is put together, and each size once.
    """
    windows = _offered(found, ids, n_max, vitamins)
    sizes = range(1, n_max + 1)
    names = [f"w{n}" for n in sizes]
    scores = [
        F.when(F.col(f"w{n}").isNotNull(), tx.flags_score([F.col(f"f{i}") for i in range(1, n + 1)])).alias(f"s{n}")
        for n in sizes
    ]
    # Not a filter on the scores: it would be pushed below and have them computed twice.
    sized = [F.struct(F.lit(n).alias("n"), F.col(f"s{n}").alias("score")) for n in sizes]
    if vitamins:
        hit = F.struct(F.lit(0).alias("n"), F.when(F.col("vitamin").isNotNull(), VITAMIN_HIT).alias("score"))
        sized = [hit, *sized]
    scored = (
        windows.select(*ids, "part", "line_no", "start", "vitamin", *names, *scores)
        .select(*ids, "part", "line_no", "start", "vitamin", *names, F.inline(F.array(*sized)))
        .where(F.col("score").isNotNull())
    )
    phrase = F.coalesce("vitamin", F.concat_ws(" ", *[F.when(F.col("n") >= n, F.col(f"w{n}")) for n in sizes]))
    source = F.when(F.col("n") > 0, 2).otherwise(0)
    pos = F.struct("part", "line_no", source.alias("source"), F.col("n").alias("words"), "start")
    return scored.select(*ids, phrase.alias("phrase"), "score", pos.alias("pos")).where(
        F.length("phrase").between(MIN_PHRASE, MAX_PHRASE)
    )


def ngrams(docs: DataFrame, ids: Sequence[str], text: str, n_max: int = 4, part: str | None = None) -> DataFrame:
    """Scored word windows of 1 to ``n_max`` words; windows that score nothing are dropped."""
    return _scored(lines(docs, ids, text, part), ids, n_max)


def hangul_hits(
    docs: DataFrame, ids: Sequence[str], text: str, alias_df: DataFrame, part: str | None = None
) -> DataFrame:
    """Hangul runs that the alias table knows, in one pass over the texts.

    A run is known if it is an alias, or one with a particle behind it; so the table is spread over
    the particles, and runs meet it by equality.
    """
    docs = dealt(docs.select(*ids, *[part] * bool(part), text), [*ids, *[part] * bool(part)])
    found = lines(docs, ids, text, part).where(tx.has_hangul(F.col("line")))
    run = F.regexp_extract_all("line", F.lit(f"({tx.HANGUL}+)"), F.lit(1))
    runs = found.select(*ids, "part", "line_no", F.posexplode(run).alias("start", "run"))
    return (
        runs.join(alias_runs(alias_df), "run")
        .select(*ids, F.col("target").alias("phrase"), F.lit(DICTIONARY_HIT).alias("score"),
                _position(1, 0, F.col("start")).alias("pos"))
    )


def dedupe_candidates(cands: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per document and phrase, case ignored: best-scoring spelling, first position."""
    best = F.max_by("phrase", F.struct("score", _later_loses(F.col("pos"))))
    return (
        cands.groupBy(*ids, F.lower("phrase").alias("phrase_key"))
        .agg(best.alias("phrase"), F.max("score").alias("score"), F.min("pos").alias("pos"))
        .drop("phrase_key")
    )


def _later_loses(pos: Column) -> Column:
    return F.struct(-pos["part"], -pos["line_no"], -pos["source"], -pos["words"], -pos["start"])


def candidates(
    docs: DataFrame,
    ids: Sequence[str],
    text: str,
    max_words: int = 4,
    alias_df: DataFrame | None = None,
    part: str | None = None,
) -> DataFrame:
    """Candidate names per document: ``ids``, phrase, score, pos. Order by score, then pos."""
    docs = dealt(docs.select(*ids, *[part] * bool(part), text), [*ids, *[part] * bool(part)])
    offered = _scored(lines(docs, ids, text, part), ids, max_words, vitamins=True)
    if alias_df is not None:
        offered = offered.unionByName(hangul_hits(docs, ids, text, alias_df, part))
    return dedupe_candidates(offered, ids)


def page_references(
    cands: DataFrame,
    ids: Sequence[str],
    dict_df: DataFrame,
    budget: int = 25,
    max_refs: int = 3,
    cache: DataFrame | None = None,
) -> DataFrame:
    """The first ``max_refs`` distinct keys among a document's ``budget`` best candidates.

    The budget applies before the lookup; names are looked up once however often they occur. The candidates within the
    budget are read for the lookup and again for what it found, so they are stored: texts are mined once.
    """
    within = stored(top_k(cands, ids, [F.desc("score"), F.asc("pos")], budget).select(*ids, "phrase", "rank"))
    known = resolve(within.select(F.col("phrase").alias("query")), dict_df, cache)
    first = (
        within.join(known.withColumnRenamed("query", "phrase"), "phrase")
        .groupBy(*ids, "inchikey")
        .agg(F.min("rank").alias("rank"), F.min_by("matched_name", "rank").alias("name"))
    )
    order = [F.asc("rank")]
    return top_k(first, ids, order, max_refs, "ref_no").withColumn("ref_no", F.col("ref_no") - 1).drop("rank")


def label_text_candidates(docs: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """Distinct candidate strings from label text with the place where each comes up first.

    A line gives itself, its parts at brackets, commas and semicolons, and its 1 to 4-word runs.
    """

    def fits(value: Column) -> Column:
        return F.length(value).between(3, 60)

    found = (
        docs.select(*ids, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))
        .withColumn("line", tx.strip(F.col("line")))
        .where(fits(F.col("line")))
        .withColumn("words", F.split("line", tx.BLANKS))
    )
    starts = F.sequence(F.lit(0), F.size("words") - 1)

    def runs(n: int) -> Column:
        whole = F.filter(starts, lambda i: i + n <= F.size("words"))
        return F.transform(whole, lambda i: F.array_join(F.slice("words", i + 1, n), " "))

    parts = F.transform(F.split("line", "[(),;]"), tx.strip)
    texts = F.array_distinct(
        F.filter(F.flatten(F.array(F.array("line"), parts, *[runs(n) for n in range(1, 5)])), fits)
    )
    offered = found.select(*ids, "line_no", F.posexplode(texts).alias("place", "candidate"))
    return offered.groupBy(*ids, "candidate").agg(F.min(F.struct("line_no", "place")).alias("pos"))
