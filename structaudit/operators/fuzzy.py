"""Names within an edit distance, by equi-joins that lose no match.

A name is cut into one more piece than the edits it may suffer; a match then keeps at least one
piece intact, and that piece is the join key together with the name's length, the edits and the
piece's number. :func:`fuzzy_labels` bounds the edits by the name's length. :func:`suggest` allows
edits for half of the query, where pieces are single letters, so it searches in rings: queries that
have enough neighbours within one or three edits never see the widest ring, which has no pieces to
join on and meets by length and a bound on the letters in common.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.functions.text import match_key, normalize_loose
from structaudit.operators.ranking import top_k

#: Edits of the first rings of a did-you-mean search; the last ring is the query's own reach.
RINGS = (1, 3)


def suggest(queries: DataFrame, titles: DataFrame, k: int = 5) -> DataFrame:
    """Did-you-mean: the ``k`` nearest titles per query, ties in table order.

    ``titles(title, ord)``. A title qualifies at distance d with 0 < d <= max(3, half the
    query's length, rounded up). A ring of radius r holds every title within r, so a query that finds
    ``k`` of them there is answered; only the others go on to the next ring.
    """
    table = titles.groupBy("title").agg(F.min("ord").alias("ord")).withColumn("title_norm", normalize_loose(F.col("title")))
    norms = table.select("title_norm").distinct()
    asked = queries.select("query").distinct().withColumn("q", normalize_loose(F.col("query"))).where("q <> ''")
    left = asked.select("q").distinct().withColumn("reach", F.greatest(F.lit(3), F.ceil(F.length("q") * 0.5).cast("int")))
    answers = None
    for radius in (*RINGS, None):
        if radius is None:
            left = left.where(F.col("reach") > RINGS[-1])
        ring = left.select("q", F.col("reach") if radius is None else F.lit(radius).alias("reach"))
        near = (
            (ring_candidates(ring, norms) if radius else widest_candidates(ring, norms))
            .withColumn("distance", F.expr("levenshtein(q, title_norm, reach)"))
            .where("distance > 0")
            .join(table, "title_norm")
            .select("q", "title", "distance", "ord")
        )
        best = top_k(near, ["q"], [F.asc("distance"), F.asc("ord")], k)
        if radius is None:
            answers = answers.union(best)
            continue
        # At most k rows a query, asked three times: kept, and made again should an executor be lost.
        best = best.persist(StorageLevel.DISK_ONLY)
        # Full here, or at the end of its reach.
        full = best.where(F.col("rank") == k).select("q")
        if radius == RINGS[-1]:
            full = full.union(left.where(F.col("reach") <= radius).select("q")).distinct()
        answered = best.join(full, "q", "left_semi")
        answers = answered if answers is None else answers.union(answered)
        left = left.join(full, "q", "left_anti")
    return answers.join(asked, "q").select("query", "title", "distance", "ord", "rank")


def ring_candidates(asked: DataFrame, norms: DataFrame) -> DataFrame:
    """Pairs (q, title_norm, reach) that hold every pair within ``reach`` edits, for reaches up to three.

    ``asked(q, reach)`` and ``norms(title_norm)``, both distinct. Titles longer than the edits are
    cut into pieces. A shorter one must share letters: of a query of m letters m - reach are left as they
    are, so one of the title's first n - (m - reach) + 1 occurs in it. Strings that are all within
    reach of each other, like any two of three letters within three edits, meet by length.
    """
    reaches = asked.select("reach").distinct()
    n, m, kept, title = "name_chars", "length(q)", "length(q) - reach", "title_norm"
    heads = (
        f"concat(array(named_struct('piece_no', -9, 'piece', '')), flatten(transform(filter(sequence(1, 3), t -> t <= {n}),"
        f" t -> transform(sequence(1, t), i -> named_struct('piece_no', -t, 'piece', substr({title}, i, 1))))))"
    )
    stored = (
        norms.withColumn(n, F.length(title))
        .withColumn("reach", F.explode(F.sequence(F.lit(1), F.lit(RINGS[-1]))))
        .join(reaches, "reach", "left_semi")
        .select(title, n, "reach", F.expr(f"inline(if({n} > reach, {_pieces(title, 'reach')}, {heads}))"))
    )
    lengths = norms.select(F.length(title).alias(n)).distinct()
    start = f"cast(floor(i * {n} / (reach + 1)) as int)"
    size = f"(cast(floor((i + 1) * {n} / (reach + 1)) as int) - {start})"
    # At most i edits lie left of piece i and reach - i right of it.
    low = f"greatest(0, {start} - i, {start} + {m} - {n} - (reach - i))"
    high = f"least({m} - {size}, {start} + i, {start} + {m} - {n} + (reach - i))"
    cuts = (
        f"flatten(transform(sequence(0, reach), i -> if({low} <= {high}, transform(array_distinct(transform(sequence({low}, {high}),"
        f" at -> substr(q, at + 1, {size}))), p -> named_struct('piece_no', i, 'piece', p)), array())))"
    )
    letters = f"transform(array_distinct(filter(split(q, ''), c -> c <> '')), c -> named_struct('piece_no', -({n} - ({kept}) + 1), 'piece', c))"
    short = f"if({kept} <= 0, array(named_struct('piece_no', -9, 'piece', '')), {letters})"
    probes = (
        asked.withColumn(n, F.expr(f"explode(sequence(greatest(0, {kept}), {m} + reach))"))
        .join(lengths, n)
        .select("q", "reach", n, F.expr(f"inline(if({n} > reach, {cuts}, {short}))"))
    )
    return probes.join(stored, ["reach", n, "piece_no", "piece"]).select("q", "title_norm", "reach").distinct()


#: Classes of letters counted for the bound of the widest ring, four bits each.
_BAGS = 15


def _bag(name: str) -> Column:
    """How often each class of letters occurs, as many ones in a field of four bits: more than four count as four."""
    field = "cast(shiftleft(1, least(4, size(filter(letters, c -> c = k)))) - 1 as bigint)"
    letters = f"transform(filter(split({name}, ''), c -> c <> ''), c -> ascii(c) % {_BAGS})"
    return F.expr(f"aggregate(sequence(0, {_BAGS - 1}), 0L, (bag, k) -> bag | shiftleft({field}, 4 * k))".replace("letters", letters))


def widest_candidates(asked: DataFrame, norms: DataFrame) -> DataFrame:
    """Pairs (q, title_norm, reach) by length whose letters in common leave room for no more than ``reach`` edits."""
    stored = norms.withColumn("name_chars", F.length("title_norm")).withColumn("name_bag", _bag("title_norm"))
    span = F.sequence(F.greatest(F.lit(0), F.length("q") - F.col("reach")), F.length("q") + F.col("reach"))
    probes = asked.withColumn("bag", _bag("q")).withColumn("name_chars", F.explode(span))
    # An edit takes away one letter of the query at most; letters beyond the fourth of a class are not told apart.
    lost = F.bit_count(F.col("bag").bitwiseAND(F.bitwise_not("name_bag")))
    new = F.bit_count(F.col("name_bag").bitwiseAND(F.bitwise_not("bag")))
    return probes.join(stored, "name_chars").where(F.greatest(lost, new) <= F.col("reach")).select("q", "title_norm", "reach")


def _pieces(norm: str, edits: str) -> str:
    """SQL: array of (piece_no, piece) cutting ``norm`` into ``edits + 1`` even pieces."""
    n = f"length({norm})"
    start = f"cast(floor(i * {n} / ({edits} + 1)) as int)"
    end = f"cast(floor((i + 1) * {n} / ({edits} + 1)) as int)"
    return f"transform(sequence(0, {edits}), i -> named_struct('piece_no', i, 'piece', substr({norm}, {start} + 1, {end} - {start})))"


def near_names(strings: DataFrame, names: DataFrame, max_ratio: float) -> DataFrame:
    """Pairs (norm, name_norm, distance) with distance / longer length <= ``max_ratio``.

    ``strings(norm)`` and ``names(name_norm)``, both distinct and not empty. A partner of a
    name of length n has at most n / (1 - max_ratio) characters, which bounds the edits by the
    name's own length; that fixes the cut of the name.
    """
    edits = f"cast(floor({max_ratio} / (1 - {max_ratio}) * %s + 1e-9) as int)"
    stored = (
        names.withColumn("name_chars", F.length("name_norm"))
        .withColumn("edits", F.expr(edits % "name_chars"))
        .select("name_norm", "name_chars", F.expr(f"inline({_pieces('name_norm', 'edits')})"))
    )
    # Only lengths that some name has are probed; there are few of them.
    lengths = names.select(F.length("name_norm").alias("name_chars")).distinct()
    reach = edits % "n"
    piece = "substr(norm, at + 1, size)"
    probes = (
        strings.withColumn("n", F.length("norm"))
        .withColumn("name_chars", F.expr(f"explode(sequence(greatest(1, n - {reach}), n + {reach}))"))
        .join(lengths, "name_chars")
        .withColumn("edits", F.expr(edits % "name_chars"))
        .where("abs(n - name_chars) <= edits")
        .withColumn("piece_no", F.expr("explode(sequence(0, edits))"))
        .withColumn("start", F.expr("cast(floor(piece_no * name_chars / (edits + 1)) as int)"))
        .withColumn("size", F.expr("cast(floor((piece_no + 1) * name_chars / (edits + 1)) as int) - start"))
        # At most piece_no edits lie left of the piece and edits - piece_no right of it.
        .withColumn("low", F.expr("greatest(0, start - piece_no, start + n - name_chars - (edits - piece_no))"))
        .withColumn(
            "high", F.expr("least(n - size, start + piece_no, start + n - name_chars + (edits - piece_no))")
        )
        .where("low <= high")
        .select(
            "norm", "name_chars", "piece_no",
            F.expr(f"explode(array_distinct(transform(sequence(low, high), at -> {piece})))").alias("piece"),
        )
    )
    longer = F.greatest(F.length("norm"), F.length("name_norm"))
    return (
        probes.join(stored, ["name_chars", "piece_no", "piece"])
        .select("norm", "name_norm")
        .distinct()
        .withColumn("distance", F.levenshtein("norm", "name_norm"))
        .withColumn("ratio", F.col("distance") / longer)
        .where(F.col("ratio") <= max_ratio)
    )


def fuzzy_labels(
    cands: DataFrame,
    ids: list[str],
    dict_df: DataFrame,
    min_len_ratio: float = 0.6,
    max_ratio: float = 0.22,
    k: int = 8,
) -> DataFrame:
    """Dictionary titles close to a document's label texts, the ``k`` closest.

    ``cands(ids, candidate, pos)``; ``dict_df`` needs name_key, title and ``ord``. Per candidate
    the nearest name counts (first in table order on a tie); a title keeps the first candidate
    that led to it.
    """
    names = (
        dict_df.where("title <> ''")
        .withColumn("name_norm", match_key(F.col("name_key")))
        .where("name_norm <> ''")
        .groupBy("name_norm")
        .agg(F.min(F.struct("ord", "title")).alias("entry"))
    )
    normed = cands.withColumn("norm", match_key(F.col("candidate"))).where("length(norm) >= 3")
    pairs = near_names(normed.select("norm").distinct(), names.select("name_norm"), max_ratio)
    shorter = F.least(F.length("norm"), F.length("name_norm"))
    longer = F.greatest(F.length("norm"), F.length("name_norm"))
    best = (
        pairs.where(shorter / longer >= min_len_ratio)
        .join(names, "name_norm")
        .groupBy("norm")
        .agg(F.min(F.struct("distance", "entry.ord", "entry.title", "ratio")).alias("best"))
        .select("norm", "best.title", "best.distance", "best.ratio")
    )
    titles = (
        normed.join(best, "norm")
        .groupBy(*ids, "title")
        .agg(F.min(F.struct("pos", "distance", "ratio")).alias("first"))
        .select(*ids, "title", "first.*")
    )
    return top_k(titles, ids, [F.asc("ratio"), F.asc("pos")], k)
