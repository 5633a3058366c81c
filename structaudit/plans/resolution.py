"""Names to keys and back, aliases, fuzzy names and dictionary upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from structaudit.functions import text as tx
from structaudit.operators import dictionary as dc
from structaudit.operators import fuzzy as fz
from structaudit.operators import labels as lb
from structaudit.operators import mining as mn
from structaudit.operators import resolve as rs
from structaudit.plans import derived as d
from structaudit.plans.derived import DICT_SQL, with_cte
from structaudit.plans.mining import LABEL_SQL, label_text

QUERIES, SQL = {}, {}


def query(name, sql=None, *ctes):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_cte(*ctes, select=sql) if ctes else sql
        return fn

    return register


LATIN = "abcdefghijklmnopqrstuvwxyz"
SYLLABLES = "가나다라마바사아자차카타파하거너더러머버서어저처커터"
HANGUL_WORD = f"translate(w, '{LATIN}', '{SYLLABLES}')"
FULL_LATIN = "".join(chr(ord(c) + 0xFEE0) for c in LATIN)
# A word dressed up the way names are: prefixes, Greek letters, odd dashes, abbreviations, capitals.
DRESSED = (
    "case length(w) * 7 % 11 when 0 then concat('(R)-(+)-', w) when 1 then concat('L-', w) when 2 then upper(w) "
    "when 3 then concat('β–', w) when 4 then concat('  ', w, '  ') when 5 then concat('(9Z,12Z)-', w) "
    "when 6 then concat('(methyl)', w) when 7 then 'DCM' when 8 then concat('cis-trans-', w) "
    "when 9 then concat(w, '−α') else w end"
)
DOC_WORDS_SQL = """
doc_words as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as w from documents)
"""
DRESSED_SQL = f"dressed as (select distinct {DRESSED} as query from doc_words)"


def doc_words(spark, sf):
    return d.words(spark, sf, "documents")


def dressed(spark, sf):
    return doc_words(spark, sf).select(F.expr(DRESSED).alias("query")).distinct()


def _greek(expr):
    for greek, latin in tx.GREEK.items():
        expr = f"replace({expr}, '{greek}', '{latin}')"
    return expr


def _collapse(expr):
    return rf"trim(regexp_replace({expr}, '[\s\p{{Z}}]+', ' ', 'g'))"


VARIANTS_SQL = f"""
plain as (select query, {_greek(f"translate(query, '{tx.DASHES}', '{'-' * len(tx.DASHES)}')")} as p from dressed),
tried as (select query, unnest([0, 1, 2, 3]) as ord, unnest([query, p, case lower(trim(p)) when 'acn' then 'acetonitrile' when 'dcm' then 'dichloromethane' end,
                 nullif(regexp_replace(trim(p), '{tx.STEREO_PREFIXES}', ''), trim(p))]) as v from plain),
spelled as (select query, ord, {_collapse('v')} as variant from tried where v is not null),
variants as (select query, row_number() over (partition by query order by ord) - 1 as variant_no, variant from (
               select *, row_number() over (partition by query, lower(variant) order by ord) as rn from spelled where variant <> '') where rn = 1)
"""


@query("dictionary_hits", """select distinct doc_id, inchikey from (
      select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as w from documents) join dict on w = name_key""", DICT_SQL)
def dictionary_hits(spark, sf):
    found = d.table(spark, sf, "documents").select(
        "doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1)))).alias("query")
    )
    return rs.lookup_each(found, d.dictionary(spark, sf)).select("doc_id", "inchikey").distinct()


@query("spelling_variants", "select * from variants", DOC_WORDS_SQL, DRESSED_SQL, VARIANTS_SQL)
def spelling_variants(spark, sf):
    return dressed(spark, sf).select(
        "query", F.posexplode(tx.spelling_variants(F.col("query"))).alias("variant_no", "variant")
    )


RESOLVED_SQL = """
resolved as (select query, variant as matched_name, inchikey, smiles from variants join dict on name_key = lower(trim(variant))
             qualify row_number() over (partition by query order by variant_no) = 1)
"""


@query("resolved_names", "select *, 'offline' as source from resolved", DOC_WORDS_SQL, DRESSED_SQL, VARIANTS_SQL, DICT_SQL, RESOLVED_SQL)
def resolved_names(spark, sf):
    found = rs.resolve(dressed(spark, sf), d.dictionary(spark, sf))
    return found.select("query", "matched_name", "inchikey", "smiles", "source")


# Salts: one fragment stands out, two are equal, two are too close to choose, or there is only one.
SALT = (
    "case cid % 4 when 0 then concat(repeat('C', cast(length(w) + 6 as int)), '.[Na+]') when 1 then 'CCCCCCCC.CCCCCCCC' "
    "when 2 then 'CCCCCCCC.CCCCCCC' else 'CCCCCCCC' end"
)
PARENT_OF = "concat(w, 'p')"


@query(
    "resolved_salts",
    f"""select name_key as query, {SALT} as smiles,
    case when cid % 4 in (0, 1) and cid % 5 <> 0 then {d.key(PARENT_OF, "w", "varchar")} else inchikey end as inchikey
    from (select *, name_key as w from dict) semi join (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) as w from documents) using (w)""",
    DICT_SQL,
)
def resolved_salts(spark, sf):
    stored = d.dictionary(spark, sf).withColumn("w", F.col("name_key"))
    salts = stored.withColumn("smiles", F.expr(SALT)).withColumn(
        "principal_inchikey", F.expr(f"case when cid % 5 <> 0 then {d.key(PARENT_OF, 'w', 'string')} end")
    )
    asked = d.words(spark, sf, "documents").select(F.col("w").alias("query"))
    return rs.resolve(asked, salts).select("query", "smiles", "inchikey")


CACHED_AS = "concat(w, 'c')"
CACHE_SQL = f"""
cache as (select name_key, case when cid % 4 = 2 then null else {d.key(CACHED_AS, "w", "varchar")} end as inchikey,
                 case when cid % 4 = 1 then '' else 'CC' end as smiles
          from (select *, name_key as w from dict) where cid % 4 in (0, 1, 2))
"""


def cache(spark, sf):
    kept = d.dictionary(spark, sf).where("cid % 4 in (0, 1, 2)").withColumn("w", F.col("name_key"))
    return kept.select(
        "name_key",
        F.expr(f"case when cid % 4 = 2 then null else {d.key(CACHED_AS, 'w', 'string')} end").alias("inchikey"),
        F.expr("case when cid % 4 = 1 then '' else 'CC' end").alias("smiles"),
    )


@query(
    "source_cascade",
    """select query, variant as matched_name, inchikey, source from (
      select query, variant_no, variant, case when c.name_key is not null then c.inchikey else s.inchikey end as inchikey,
             case when c.name_key is not null then 'cache' else 'offline' end as source
      from variants v left join (select * from cache where inchikey is null or smiles <> '') c on c.name_key = lower(trim(variant))
      left join dict s on s.name_key = lower(trim(variant)))
    where inchikey is not null qualify row_number() over (partition by query order by variant_no) = 1""",
    DOC_WORDS_SQL, DRESSED_SQL, VARIANTS_SQL, DICT_SQL, CACHE_SQL,
)
def source_cascade(spark, sf):
    found = rs.resolve(dressed(spark, sf), d.dictionary(spark, sf), cache(spark, sf))
    return found.select("query", "matched_name", "inchikey", "source")


@query(
    "normal_forms",
    f"""select query, e as exact, regexp_replace(e, '[\\s\\-]+', '', 'g') as loose,
    lower(regexp_replace(replace(replace(query, 'α', '알파'), 'β', '베타'), '[\\s\\-\\p{{Z}}]+', '', 'g')) as korean_key,
    regexp_replace(lower(query), '[^a-z0-9가-힣]', '', 'g') as match_key, regexp_replace(query, '{tx.STEREO_PREFIXES}', '') as stripped
    from (select query, lower({_collapse(f"translate(query, '{tx.DASHES}', '{'-' * len(tx.DASHES)}')")}) as e from (
      select query from dressed union all select translate(w, '{LATIN}', '{FULL_LATIN}') from doc_words))""".replace(
        "select query, e as exact", "select query, translate(e, '" + FULL_LATIN + "', '" + LATIN + "') as exact"
    ).replace("regexp_replace(e, ", "regexp_replace(translate(e, '" + FULL_LATIN + "', '" + LATIN + "'), "),
    DOC_WORDS_SQL, DRESSED_SQL,
)
def normal_forms(spark, sf):
    wide = doc_words(spark, sf).select(F.translate("w", LATIN, FULL_LATIN).alias("query"))
    q = F.col("query")
    return dressed(spark, sf).unionByName(wide).select(
        "query", tx.normalize_exact(q).alias("exact"), tx.normalize_loose(q).alias("loose"),
        tx.ko_key(q).alias("korean_key"), tx.match_key(q).alias("match_key"), tx.strip_stereo_prefix(q).alias("stripped"),
    )


# Aliases -----------------------------------------------------------------------------------

ALIAS_SQL = f"""
aliases as (select {HANGUL_WORD} as alias, {HANGUL_WORD} as alias_key, w as target, cid % 9 = 0 as whole_only, cid as ord
            from (select *, name_key as w from dict))
"""


def aliases(spark, sf):
    named = d.dictionary(spark, sf).withColumn("w", F.col("name_key"))
    return named.select(
        F.expr(HANGUL_WORD).alias("alias"), tx.ko_key(F.expr(HANGUL_WORD)).alias("alias_key"), F.col("w").alias("target"),
        (F.col("cid") % 9 == 0).alias("whole_only"), F.col("cid").alias("ord"),
    )


PARTICLE_LIST = sorted(tx.PARTICLES, key=len, reverse=True)
PARTICLE_ARRAY = "['', " + ", ".join(f"'{p}'" for p in PARTICLE_LIST) + "]"
PARTICLE = f"case length(w) % 4 when 0 then '' when 1 then '은' when 2 then '이라는' else '으로' end"
RUNS_SQL = f"runs as (select distinct concat({HANGUL_WORD}, {PARTICLE}) as query from doc_words union select distinct concat({HANGUL_WORD}, '는') from words)"


def alias_hits_sql(whole: str) -> str:
    return f"""
alias_hits as (select query, target from (
    select query, r, unnest(stems) as stem, generate_subscripts(stems, 1) as rank from (
      select query, 1 as r, list_transform({PARTICLE_ARRAY}, lambda p: case when ends_with(query, p) then left(query, length(query) - length(p)) end) as stems from runs))
  join aliases on stem = alias_key where {whole} qualify row_number() over (partition by query order by rank, whole_only) = 1)
"""


def runs(spark, sf):
    with_particle = doc_words(spark, sf).select(F.expr(f"concat({HANGUL_WORD}, {PARTICLE})").alias("query"))
    return with_particle.unionByName(
        d.words(spark, sf).select(F.expr(f"concat({HANGUL_WORD}, '는')").alias("query"))
    ).distinct()


@query("alias_lookup", "select * from alias_hits", DOC_WORDS_SQL, DICT_SQL, ALIAS_SQL, RUNS_SQL, alias_hits_sql("true"))
def alias_lookup(spark, sf):
    return rs.alias_lookup(runs(spark, sf), aliases(spark, sf))


@query("alias_lookup_in_text", "select * from alias_hits", DOC_WORDS_SQL, DICT_SQL, ALIAS_SQL, RUNS_SQL, alias_hits_sql("not whole_only"))
def alias_lookup_in_text(spark, sf):
    return rs.alias_lookup(runs(spark, sf), aliases(spark, sf), in_text=True)


@query(
    "hangul_mentions",
    """select doc_id, target as phrase, count(*) as n from (
      select doc_id, unnest(regexp_extract_all(text, '[가-힣]+')) as query from hdocs) join alias_hits using (query) group by 1, 2""",
    DICT_SQL, ALIAS_SQL,
    f"hdocs as (select doc_id, translate(lower(text), '{LATIN}', '{SYLLABLES}') as text from documents)",
    "runs as (select distinct unnest(regexp_extract_all(text, '[가-힣]+')) as query from hdocs)",
    alias_hits_sql("not whole_only"),
)
def hangul_mentions(spark, sf):
    hangul = d.table(spark, sf, "documents").select("doc_id", F.translate(F.lower("text"), LATIN, SYLLABLES).alias("text"))
    hits = mn.hangul_hits(hangul, ["doc_id"], "text", aliases(spark, sf))
    return hits.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


@query(
    "lookup_route",
    "select query, coalesce(target, query) as name from (select query from runs union select w from doc_words) left join alias_hits using (query)",
    DOC_WORDS_SQL, DICT_SQL, ALIAS_SQL, RUNS_SQL, alias_hits_sql("true"),
)
def lookup_route(spark, sf):
    asked = runs(spark, sf).unionByName(doc_words(spark, sf).select(F.col("w").alias("query")))
    return rs.lookup_route(asked, aliases(spark, sf))


@query(
    "korean_key_variants",
    f"""select * from (select distinct alias, unnest([alias, compact, case when n % 2 = 0 then concat({HANGUL_WORD}, ' ', tail) end,
         case when n % 2 = 0 then translate(alias, 'abcdefghijklmnopqrstuvwxyzABC0123456789', '{FULL_LATIN}ＡＢＣ０１２３４５６７８９') end,
         case when n % 2 = 0 then translate(compact, 'abcdefghijklmnopqrstuvwxyzABC0123456789', '{FULL_LATIN}ＡＢＣ０１２３４５６７８９') end,
         case when n % 2 = 0 then concat({HANGUL_WORD}, ' ', translate(tail, 'ABC0123456789', 'ＡＢＣ０１２３４５６７８９')) end]) as spelling
    from (select w, length(w) as n, tail, case when length(w) % 2 = 0 then concat({HANGUL_WORD}, '-', tail) else {HANGUL_WORD} end as alias,
            case when length(w) % 2 = 0 then concat({HANGUL_WORD}, tail) else {HANGUL_WORD} end as compact
          from (select w, concat('B', cast(length(w) as varchar)) as tail from doc_words))) where spelling is not null""",
    DOC_WORDS_SQL,
)
def korean_key_variants(spark, sf):
    alias = f"case when length(w) % 2 = 0 then concat({HANGUL_WORD}, '-B', cast(length(w) as string)) else {HANGUL_WORD} end"
    named = doc_words(spark, sf).select(F.expr(alias).alias("alias"))
    return named.select("alias", F.explode(tx.korean_key_variants(F.col("alias"))).alias("spelling")).distinct()


# Keys to names -----------------------------------------------------------------------------

SYNONYMS_SQL = """
synonyms as (select name_key, inchikey, smiles, case when cid % 3 = 0 then '' else title end as title, case when cid % 3 = 0 then '' else 'iupac-' || name_key end as iupac from dict
             union all select 'iso' || name_key, inchikey, smiles, case when cid % 5 = 0 then upper('iso' || name_key) else '' end, '' from dict)
"""
INVERTED_SQL = """
inverted as (select inchikey, coalesce(arg_min(title, name_key) filter (where title <> ''), arg_min(name_key, row(length(name_key), name_key))) as common,
               coalesce(arg_min(iupac, name_key) filter (where title <> ''), '') as iupac, count(*) as n_names from synonyms group by 1)
"""


def synonyms(spark, sf):
    base = d.dictionary(spark, sf)
    titled = base.withColumn("iupac", F.when(F.col("cid") % 3 == 0, "").otherwise(F.concat(F.lit("iupac-"), "name_key")))
    titled = titled.withColumn("title", F.when(F.col("cid") % 3 == 0, "").otherwise(F.col("title")))
    iso = F.concat(F.lit("iso"), "name_key")
    second = base.withColumn("title", F.when(F.col("cid") % 5 == 0, F.upper(iso)).otherwise("")).withColumn("name_key", iso)
    return titled.unionByName(second)


@query("dictionary_inversion", "select * from inverted", DICT_SQL, SYNONYMS_SQL, INVERTED_SQL)
def dictionary_inversion(spark, sf):
    return rs.invert_dictionary(synonyms(spark, sf))


# Keys as readers produce them: some lower case, some of another stereo form, some malformed.
ASKED = "case cid % 4 when 0 then inchikey when 1 then lower(inchikey) when 2 then concat(left(inchikey, 15), 'ABCDEFGHSA-N') else left(inchikey, 14) end"


@query(
    "names_for_keys", f"select i.* from inverted i join (select distinct upper({ASKED}) as inchikey from dict) using (inchikey)",
    DICT_SQL, SYNONYMS_SQL, INVERTED_SQL,
)
def names_for_keys(spark, sf):
    asked = d.dictionary(spark, sf).select(F.expr(ASKED).alias("inchikey"))
    return rs.names_for(asked, synonyms(spark, sf))


# A third of the keys cached, some of them as known misses.
NAME_CACHE = ["inchikey", "case when cid % 9 <> 0 then upper(name_key) end as title", "case when cid % 9 = 3 then 'cached' end as iupac"]


@query(
    "names_for_cached",
    f"""select inchikey, coalesce(title, '') as common, coalesce(k.iupac, '') as iupac, 'cache' as source from asked join kept k using (inchikey)
      where title is not null or k.iupac is not null
    union all select inchikey, common, iupac, 'offline' from asked join inverted using (inchikey) where inchikey not in (select inchikey from kept)""",
    DICT_SQL, SYNONYMS_SQL, INVERTED_SQL,
    f"asked as (select distinct upper({ASKED}) as inchikey from dict)", f"kept as (select {', '.join(NAME_CACHE)} from dict where cid % 3 = 0)",
)
def names_for_cached(spark, sf):
    dict_df = d.dictionary(spark, sf)
    kept = dict_df.where("cid % 3 = 0").selectExpr(*NAME_CACHE)
    return rs.names_for_cached(dict_df.select(F.expr(ASKED).alias("inchikey")), synonyms(spark, sf), kept)


@query(
    "names_by_skeleton",
    f"""select a.inchikey, coalesce(i.common, n.common) as common, coalesce(i.iupac, n.iupac) as iupac, coalesce(i.n_names, n.n_names) as n_names
    from (select distinct upper({ASKED}) as inchikey from dict where cid % 4 <> 3) a left join inverted i using (inchikey)
    left join (select left(inchikey, 14) as sk, arg_max(common, inchikey) as common, arg_max(iupac, inchikey) as iupac, arg_max(n_names, inchikey) as n_names from inverted group by 1) n
      on n.sk = left(a.inchikey, 14)""",
    DICT_SQL, SYNONYMS_SQL, INVERTED_SQL,
)
def names_by_skeleton(spark, sf):
    asked = d.dictionary(spark, sf).select(F.expr(ASKED).alias("inchikey"))
    return rs.names_for(asked, synonyms(spark, sf), fallback="skeleton")


@query(
    "localised_names",
    """select inchikey, common, iupac, korean, case when korean is not null then korean || ' (' || concat_ws('; ', nullif(common, ''), nullif(iupac, '')) || ')'
         else concat_ws('; ', nullif(common, ''), nullif(iupac, '')) end as display
    from inverted left join (
      select inchikey, arg_min(alias, row(tier, length(english), english)) as korean from (
        select inchikey, lower(common) as english, 0 as tier from inverted union all select inchikey, lower(iupac), 1 from inverted
        union all select inchikey, name_key, 2 from synonyms) s join aliases on target = english group by 1) using (inchikey)""",
    DICT_SQL, SYNONYMS_SQL, INVERTED_SQL, ALIAS_SQL,
)
def localised_names(spark, sf):
    keys = d.dictionary(spark, sf).select("inchikey")
    named = rs.localised_name(keys, synonyms(spark, sf), aliases(spark, sf))
    return named.withColumn("display", rs.display_name(F.col("korean"), F.col("common"), F.col("iupac")))


# Loose and fuzzy ---------------------------------------------------------------------------

OFFERS_SQL = """
offers as (select concat(left(w, 3), '-', substr(w, 4)) as alias, inchikey, cid as ord from (select *, name_key as w from dict)
           union all select concat(substr(w, 1, 4), ' ', substr(w, 1, 3)), inchikey, cid + 7 from (select *, name_key as w from dict)),
loose as (select alias_key, arg_min(inchikey, ord) as inchikey from (
            select regexp_replace(alias, '[\\s\\-]+', '', 'g') as alias_key, inchikey, ord from offers)
          where alias_key not in (select name_key from dict) group by 1)
"""


def offers(spark, sf):
    named = d.dictionary(spark, sf).withColumn("w", F.col("name_key"))
    first = named.select(F.expr("concat(left(w, 3), '-', substr(w, 4))").alias("alias"), "inchikey", F.col("cid").alias("ord"))
    second = named.select(F.expr("concat(substr(w, 1, 4), ' ', substr(w, 1, 3))").alias("alias"), "inchikey", (F.col("cid") + 7).alias("ord"))
    return first.unionByName(second)


@query("loose_aliases", "select * from loose", DICT_SQL, OFFERS_SQL)
def loose_aliases(spark, sf):
    return dc.loose_aliases(offers(spark, sf), d.dictionary(spark, sf))


LOOSE_QUERY = (
    "case length(w) % 3 when 0 then upper(w) when 1 then concat(substr(w, 1, 4), '  ', substr(w, 1, 3)) "
    "else concat(substr(w, 1, 2), '-', substr(w, 3, 2), '-', substr(w, 1, 3)) end"
)


@query(
    "loose_lookup",
    f"""select query, coalesce(e.inchikey, b.inchikey) as inchikey, coalesce(e.title, b.title) as title,
      case when e.inchikey is not null then 'exact' else 'alias' end as source
    from (select distinct {LOOSE_QUERY} as query from (select w from doc_words union select w from words)) q
    left join dict e on e.name_key = regexp_replace(lower(query), '\\s+', ' ', 'g')
    left join loose on alias_key = regexp_replace(lower(query), '[\\s\\-]+', '', 'g') left join dict b on b.inchikey = loose.inchikey
    where e.inchikey is not null or b.inchikey is not null""",
    DOC_WORDS_SQL, DICT_SQL, OFFERS_SQL,
)
def loose_lookup(spark, sf):
    every = doc_words(spark, sf).unionByName(d.words(spark, sf)).select(F.expr(LOOSE_QUERY).alias("query"))
    dict_df = d.dictionary(spark, sf)
    return rs.resolve_loose(every, dict_df, dc.loose_aliases(offers(spark, sf), dict_df))


@query(
    "did_you_mean",
    """select query, title, distance, rank from (
      select query, title, distance, row_number() over (partition by query order by distance, cid) as rank from (
        select w as query, title, cid, levenshtein(w, lower(title)) as distance from dict,
          (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as w from conversations)
        where abs(length(w) - length(title)) <= greatest(3, ceil(length(w) * 0.5)))
      where distance > 0 and distance <= greatest(3, ceil(length(query) * 0.5)))
    where rank <= 5""",
    DICT_SQL,
)
def did_you_mean(spark, sf):
    titles = d.dictionary(spark, sf).select("title", F.col("cid").alias("ord"))
    asked = d.words(spark, sf, "conversations").select(F.col("w").alias("query"))
    return fz.suggest(asked, titles).select("query", "title", "distance", "rank")


@query(
    "fuzzy_labels",
    """select page_id, title, distance, round(ratio, 9) as ratio from (
      select page_id, title, arg_min(distance, row(line_no, place)) as distance, arg_min(ratio, row(line_no, place)) as ratio, min(row(line_no, place)) as pos from (
        select c.page_id, c.line_no, c.place, b.title, b.distance, b.ratio from placed c
        join (select norm, arg_min(title, row(distance, cid)) as title, min(distance) as distance, arg_min(ratio, row(distance, cid)) as ratio from (
            select norm, cid, title, levenshtein(norm, name_key) as distance, levenshtein(norm, name_key) / greatest(length(norm), length(name_key)) as ratio
            from (select distinct norm from placed), dict
            where least(length(norm), length(name_key)) / greatest(length(norm), length(name_key)) >= 0.6) where ratio <= 0.22 group by 1) b using (norm))
      group by 1, 2) qualify row_number() over (partition by page_id order by ratio, pos) <= 8""",
    LABEL_SQL.replace("as line from pages)", "as line, generate_subscripts(regexp_split_to_array(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\\r?\\n'), 1) as line_no from pages)")
    .replace("select page_id, line, regexp_split", "select page_id, line_no, line, regexp_split")
    .replace("select distinct page_id, candidate from (", "select page_id, candidate, min(row(line_no, grp, i)) as p from (")
    .replace("select page_id, line as candidate from", "select page_id, line_no, 0 as grp, 0 as i, line as candidate from")
    .replace("union all select page_id, regexp_replace(unnest(regexp_split_to_array(line, '[(),;]'))", "union all select page_id, line_no, 1, generate_subscripts(regexp_split_to_array(line, '[(),;]'), 1), regexp_replace(unnest(regexp_split_to_array(line, '[(),;]'))")
    .replace("union all select page_id, array_to_string", "union all select page_id, line_no, 1 + n, i, array_to_string")
    .replace("between 3 and 60)\n", "between 3 and 60 group by 1, 2)\n"),
    """placed as (select page_id, p[1] as line_no, row(p[2], p[3]) as place, regexp_replace(lower(candidate), '[^a-z0-9가-힣]', '', 'g') as norm
       from label_cands where length(regexp_replace(lower(candidate), '[^a-z0-9가-힣]', '', 'g')) >= 3)""",
    DICT_SQL,
)
def fuzzy_labels(spark, sf):
    cands = mn.label_text_candidates(label_text(spark, sf), ["page_id"], "text")
    found = fz.fuzzy_labels(cands, ["page_id"], d.dictionary(spark, sf).withColumn("ord", F.col("cid")))
    return found.select("page_id", "title", "distance", F.round("ratio", 9).alias("ratio"))


# Dictionary upkeep -------------------------------------------------------------------------

CHANGED_FROM = "concat(name_key, 'x')"
REBUILT_SQL = f"""
old as (select name_key, case when cid % 13 = 0 then {d.key(CHANGED_FROM, "name_key", "varchar")} else inchikey end as inchikey,
               case when cid % 5 = 0 then '' else smiles end as smiles from dict where cid % 3 <> 0)
"""


def old_dictionary(spark, sf):
    changed = f"case when cid % 13 = 0 then {d.key(CHANGED_FROM, 'name_key', 'string')} else inchikey end"
    return d.dictionary(spark, sf).where("cid % 3 <> 0").withColumn("inchikey", F.expr(changed)).withColumn(
        "smiles", F.when(F.col("cid") % 5 == 0, "").otherwise(F.col("smiles"))
    )


@query(
    "dictionary_merge",
    """select name_key, inchikey, smiles, false as added from old where smiles <> ''
    union all select name_key, inchikey, smiles, true from dict where name_key not in (select name_key from old where smiles <> '')""",
    DICT_SQL, REBUILT_SQL,
)
def dictionary_merge(spark, sf):
    merged = dc.merge_dictionary(old_dictionary(spark, sf), d.dictionary(spark, sf))
    return merged.select("name_key", "inchikey", "smiles", "added")


EXPECTED = "case when cid % 17 = 0 then {other} else inchikey end"


@query(
    "dictionary_issues",
    f"""select n.name_key, 'conflict' as issue, n.inchikey as have, o.inchikey as want from dict n join old o using (name_key) where n.inchikey <> o.inchikey
    union all select target, 'missing_target', null, alias from (select concat(target, case when ord % 6 = 0 then 'zz' else '' end) as target, alias from aliases)
      where target not in (select name_key from dict)
    union all select name_key, 'wrong_compound', inchikey, want from (select *, {EXPECTED.format(other=d.key("concat(name_key, 'q')", "name_key", "varchar"))} as want from dict)
      where left(inchikey, 14) <> left(want, 14)""",
    DICT_SQL, REBUILT_SQL, ALIAS_SQL,
)
def dictionary_issues(spark, sf):
    dict_df = d.dictionary(spark, sf)
    pointed = aliases(spark, sf).withColumn(
        "target", F.concat("target", F.when(F.col("ord") % 6 == 0, "zz").otherwise(""))
    )
    other = d.key("concat(name_key, 'q')", "name_key", "string")
    expected = dict_df.select("name_key", F.expr(EXPECTED.format(other=other)).alias("inchikey"))
    return dc.dictionary_issues(dict_df, old_dictionary(spark, sf), pointed, expected)


@query(
    "korean_entries",
    f"""select {HANGUL_WORD} as name_key, inchikey from (select *, name_key as w from dict)""",
    DICT_SQL,
)
def korean_entries(spark, sf):
    return dc.korean_entries(aliases(spark, sf), d.dictionary(spark, sf)).select("name_key", "inchikey")


@query(
    "name_union", "select w as name from doc_words union select name_key from dict union select lower(p_name) from part", DOC_WORDS_SQL, DICT_SQL,
)
def name_union(spark, sf):
    return dc.name_union(
        doc_words(spark, sf).select(F.col("w").alias("name")),
        d.dictionary(spark, sf).select(F.upper("name_key").alias("name")),
        d.table(spark, sf, "part").select(F.col("p_name").alias("name")),
    )


@query(
    "names_to_do", "select w as name from doc_words where w not in (select name_key from old where smiles <> '')",
    DOC_WORDS_SQL, DICT_SQL, REBUILT_SQL,
)
def names_to_do(spark, sf):
    return dc.todo(dc.name_union(doc_words(spark, sf).select(F.col("w").alias("name"))), old_dictionary(spark, sf))


# Terms: a compound per dictionary word, with aliases of four kinds, some of them wrong.
TERM_ALIASES_SQL = f"""
term_aliases as (
  select w as id, kind, alias, case when cid % 10 = 0 then null when cid % 10 = 1 then concat(left(inchikey, 15), 'ABCDEFGHSA-N') when cid % 10 = 2 then {d.key("concat(w, 'q')", "w", "varchar")} else inchikey end as expected_key
  from (select *, name_key as w from dict), lateral (values ('en', w), ('en', concat(w, 'zz')), ('en', concat('β', w)), ('iupac', concat('(R)-', w)), ('iupac', concat('2-', w)),
       ('ko', {HANGUL_WORD}), ('ko', concat({HANGUL_WORD}, '뷁')), ('abbr', upper(left(w, 3)))) v(kind, alias))
"""


def terms(spark, sf):
    named = d.dictionary(spark, sf).withColumn("w", F.col("name_key"))
    other = d.key("concat(w, 'q')", "w", "string")
    answer = F.expr(
        f"case when cid % 10 = 0 then null when cid % 10 = 1 then concat(left(inchikey, 15), 'ABCDEFGHSA-N') when cid % 10 = 2 then {other} else inchikey end"
    )
    lit = F.lit
    return named.select(
        F.col("w").alias("id"),
        F.array("w", F.concat("w", lit("zz")), F.concat(lit("β"), "w")).alias("en"),
        F.array(F.concat(lit("(R)-"), "w"), F.concat(lit("2-"), "w")).alias("iupac"),
        F.array(F.expr(HANGUL_WORD), F.concat(F.expr(HANGUL_WORD), lit("뷁"))).alias("ko"),
        F.array(F.upper(F.left("w", lit(3)))).alias("abbr"),
        F.struct(answer.alias("inchikey")).alias("answer"),
    )


def term_aliases(spark, sf):
    return dc.unpivot_aliases(terms(spark, sf)).select("id", "kind", "alias", F.col("answer.inchikey").alias("expected_key"))


@query("term_aliases", "select * from term_aliases", DICT_SQL, TERM_ALIASES_SQL)
def unpivoted_terms(spark, sf):
    return term_aliases(spark, sf)


@query(
    "name_coverage",
    """select kind, class, count(*) as n from (
      select kind, case when expected_key is null then 'no_answer' when k = expected_key then 'hit' when left(k, 14) = left(expected_key, 14) then 'stereo'
        when regexp_matches(alias, '[가-힣]') then case when name = alias then 'ko_no_alias' when k is null then 'ko_alias_miss' else 'ko_alias_wrong' end
        when k is not null then 'wrong_compound' when regexp_matches(alias, '[αβγδ]') then 'en_greek'
        when length(alias) <= 6 and upper(alias) = alias then 'abbr_404' when regexp_matches(alias, '[0-9(]') then 'iupac_404' else 'en_404' end as class
      from (select t.*, coalesce(h.target, alias) as name, r.inchikey as k
            from term_aliases t left join alias_hits h on h.query = t.alias
            left join resolved r on r.query = coalesce(h.target, alias))) group by 1, 2""",
    DICT_SQL, ALIAS_SQL, TERM_ALIASES_SQL, "runs as (select distinct alias as query from term_aliases where kind = 'ko')", alias_hits_sql("true"),
    "dressed as (select distinct coalesce(h.target, alias) as query from term_aliases t left join alias_hits h on h.query = t.alias)",
    VARIANTS_SQL, RESOLVED_SQL,
)
def name_coverage(spark, sf):
    return dc.name_coverage(term_aliases(spark, sf), d.dictionary(spark, sf), aliases(spark, sf))


# Labelled cases: names against drawn keys, every kind of mistake among them.
CASE_TRUTH = "['same','skeleton_diff','stereo_diff','not_structure','no_claim','generic_formula','reaction_scheme']"
CASE_COLUMNS = [
    "case when cid % 29 = 0 then concat(w, 'zz') else w end as name",
    "case when cid % 5 = 0 then '' else smiles end as smiles",
    "case when cid % 23 = 0 then null when cid % 3 = 0 then {flip} when cid % 3 = 1 then {other} else inchikey end as drawn_key",
    "case when cid % 4 = 0 then '' else 'seen' end as note",
    "case when cid % 6 < 3 then 'art' else '' end as art",
    "case when cid % 6 < 2 then inchikey end as art_key",
]
FLIP = "concat(left(inchikey, 15), 'ABCDEFGHSA-N')"
CASES_SQL = f"""
cases as (select {", ".join(CASE_COLUMNS).format(flip=FLIP, other=d.key("concat(w, 'q')", "w", "varchar"))}, {CASE_TRUTH}[cast(cid % 7 + 1 as int)] as truth
          from (select *, name_key as w from dict))
"""


@query(
    "label_validation",
    """select name, truth as declared, case when eye then case when problem is null then truth end when ref is not null and drawn_key is not null then computed end as computed, problem
    from (select *, case when eye then
        case when note = '' then 'no_note' when truth <> 'no_claim' and smiles <> '' then 'structure_not_expected'
             when truth = 'no_claim' and smiles = '' then 'structure_missing' when truth = 'no_claim' and drawn_key is null then 'structure_unreadable'
             when truth in ('generic_formula', 'reaction_scheme') and art <> '' and art_key is not null then 'ordinary_compound' end
      else case when ref is null then 'name_unresolved' when drawn_key is null then 'drawing_unreadable' when computed <> truth then 'label_differs' end end as problem
    from (select c.*, d.inchikey as ref, truth not in ('same', 'skeleton_diff', 'stereo_diff') as eye,
        case when d.inchikey = drawn_key then 'same' when left(d.inchikey, 14) = left(drawn_key, 14) then 'stereo_diff' when drawn_key is not null and d.inchikey is not null then 'skeleton_diff' end as computed
      from cases c left join dict d on d.name_key = c.name))""",
    DICT_SQL, CASES_SQL,
)
def label_validation(spark, sf):
    other = d.key("concat(w, 'q')", "w", "string")
    columns = [c.format(flip=FLIP, other=other) for c in CASE_COLUMNS]
    truth = f"element_at(array({CASE_TRUTH[1:-1]}), cast(cid % 7 + 1 as int)) as truth"
    dict_df = d.dictionary(spark, sf)
    return lb.validate_labels(dict_df.withColumn("w", F.col("name_key")).selectExpr(*columns, truth), dict_df)
