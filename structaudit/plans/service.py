"""Composition of structure strings, and the service rules over requests derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from structaudit.functions import boxes as bx
from structaudit.functions import formula as fm
from structaudit.operators import adjudicate as ad
from structaudit.operators import evaluate as ev
from structaudit.plans import derived as d
from structaudit.plans.derived import READS_SQL, with_cte
from structaudit.streaming.checks import answer_requests

QUERIES, SQL = {}, {}


def query(name, sql=None, *ctes):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_cte(*ctes, select=sql) if ctes else sql
        return fn

    return register


# SQL twin of the composition: strings(s) -> hf(s, principal, formula, largest, n_atoms)
COMPOSITION_SQL = f"""
frags as (select s, frag, min(nth) as nth from (
            select s, unnest(string_split(s, '.')) as frag, generate_subscripts(string_split(s, '.'), 1) as nth from (select distinct trim(s) as s from strings)) group by 1, 2),
texts as (select frag as text from frags union select s from frags),
symbols as (
  select text, list_transform(toks, lambda k: upper(left(k, 1)) || substr(k, 2)) as syms,
         length(replace(text, '[', '')) = length(replace(text, ']', '')) and length(replace(text, '(', '')) = length(replace(text, ')', '')) and len(toks) > 0 as ok
  from (select text, list_transform(regexp_extract_all(text, '{fm.ATOM}'), lambda k: case when left(k, 1) = '[' then regexp_extract(k, '{fm.BRACKET_SYMBOL}', 1) else k end) as toks from texts)),
sized as (select s, frag, nth, ok, len(syms) as n_all, len(list_filter(syms, lambda k: k <> 'H')) as n from frags join symbols on text = frag),
ranked as (select *, row_number() over (partition by s order by n desc, nth) as rn, lead(n) over (partition by s order by n desc, nth) as next_n from sized),
chosen as (
  select s, case when count(*) filter (where not ok) > 0 or not contains(s, '.') then s when count(*) = 1 then any_value(frag)
              when max(n) filter (where rn = 1) >= 6 and max(n) filter (where rn = 1) >= 2 * max(next_n) filter (where rn = 1) then any_value(frag) filter (where rn = 1) else s end as principal,
         arg_max(frag, row(n_all, -nth)) filter (where ok) as largest
  from ranked group by s),
counted as (select text, sym, count(*) as n from (select text, unnest(syms) as sym from symbols where ok) group by 1, 2),
formulas as (select text, string_agg(sym || case when n > 1 then cast(n as varchar) else '' end, '' order by sym <> 'C', sym) as formula, nullif(sum(n) filter (where sym <> '*'), 0)::bigint as n_atoms from counted group by 1),
hf as (select s, principal, a.formula, a.n_atoms, b.formula as largest from chosen left join formulas a on a.text = principal left join formulas b on b.text = largest)
"""


@query(
    "composition_of_readings",
    """select s as raw, principal, formula, largest, n_atoms,
    case when contains(s, '*') then 'wildcards:' || (length(s) - length(replace(s, '*', ''))) when len(string_split(s, '.')) > 3 then 'fragments:' || len(string_split(s, '.')) end as marks,
    coalesce(n_atoms >= 40 and n_atoms >= 3.0 * 4, false) as nonsense from hf""",
    READS_SQL, "strings as (select raw as s from reads)", COMPOSITION_SQL,
)
def composition_of_readings(spark, sf):
    raw = F.col("raw")
    shown = d.reads(spark, sf).select("raw").distinct().withColumn("formula", fm.heavy_atom_formula(raw))
    return shown.select(
        "raw", fm.principal_fragment(raw).alias("principal"), "formula", fm.largest_fragment_formula(raw).alias("largest"),
        fm.atom_total(F.col("formula")).alias("n_atoms"), fm.unreadable_marks(raw).alias("marks"),
        F.coalesce(fm.nonsense_size(F.lit("C3O"), F.col("formula")), F.lit(False)).alias("nonsense"),
    )


@query(
    "formula_differences",
    """select raw, string_agg(element || ' ' || abs(delta) || case when delta > 0 then ' more' else ' fewer' end, ', ' order by element) as note
    from (select raw, element, sum(n)::bigint as delta from (
        select s as raw, sym as element, n from hf join counted on text = principal where sym <> '*'
        union all select s, unnest(['Br', 'C', 'N', 'O']), unnest([-1, -5, -1, -2]) from hf where formula is not null) group by 1, 2)
    where delta <> 0 group by 1""",
    READS_SQL, "strings as (select raw as s from reads)", COMPOSITION_SQL,
)
def formula_differences(spark, sf):
    shown = d.reads(spark, sf).select("raw").distinct()
    note = fm.formula_delta_note(F.lit("C5BrNO2"), fm.heavy_atom_formula(F.col("raw")))
    # Not a filter on the note: it would be pushed below and be worked out for every reading.
    return shown.select("raw", F.explode(F.array(note)).alias("note")).where("note <> ''")


@query(
    "hill_formulas",
    """select s as raw, string_agg(sym || case when n > 1 then cast(n as varchar) else '' end, ''
      order by case when has_c and sym = 'C' then 0 when has_c and sym = 'H' then 1 else 2 end, sym) as hill
    from (select s, sym, n, bool_or(sym = 'C') over (partition by s) as has_c from (
      select s, sym, n from hf join counted on text = principal where sym <> '*' union all select s, 'H', 3 from hf where s like '%S%' or s like '%N%')) group by 1""",
    READS_SQL, "strings as (select raw as s from reads)", COMPOSITION_SQL,
)
def hill_formulas(spark, sf):
    raw = F.col("raw")
    with_hydrogen = F.concat(fm.heavy_atom_formula(raw), F.when(raw.rlike("[SN]"), "H3").otherwise(""))
    return d.reads(spark, sf).select("raw").distinct().select("raw", fm.hill_formula(fm.parse_formula(with_hydrogen)).alias("hill"))


# Requests ----------------------------------------------------------------------------------

PART_SMILES = (
    "concat(repeat('C', cast({0} % 9 + 1 as int)), case {0} % 4 when 0 then '(=O)N' when 1 then 'c1ccncc1Cl' when 2 then '[C@@H](O)Br' else 'OCCCN.[Na+]' end)"
)
ENGINES = ("readera@v310", "readerb/x1", "readerb/x0.9")


def read_fields(i: int, text: str) -> dict[str, str]:
    """SQL for the fields of a request's reading number ``i``."""
    return {
        "engine": f"'{ENGINES[i]}'",
        "raw": f"case when (rid * 3 + {i}) % 17 = 0 then 'C*C*C' when (rid + {i}) % 19 = 0 then 'C.C.CC.O' "
        f"when (rid + {i}) % 23 = 0 then repeat('C', 130) else {PART_SMILES.format(f'(pk + (rid + {i}) % 5)')} end",
        "inchikey": f"case when (rid + {i * 5}) % 13 = 0 then null when (rid + {i}) % 9 = 0 then {d.key('pk + 1', repr('base'), text)} "
        f"when (rid + {i}) % 11 = 0 then {d.key('pk', repr('flip'), text)} else {d.key('pk', repr('base'), text)} end",
        "confidence": "cast(rid % 100 as double) / cast(100 as double)" if i == 0 else "cast(null as double)",
    }


REQUESTS_SQL = f"""
parts as (select concat('part ', cast(p_partkey as varchar)) as name_key, {d.key('p_partkey', repr('base'), 'varchar')} as inchikey, {PART_SMILES.format('p_partkey')} as smiles from part),
req as (select o_orderkey as rid, o_custkey as pk, concat('part ', cast(o_custkey + (o_orderkey % 8) * 150 as varchar)) as name from orders),
rr as (""" + " union all ".join(
    f"select rid, {i} as i, " + ", ".join(f"{sql} as {name}" for name, sql in read_fields(i, "varchar").items()) + f" from req where rid % 4 > {i}"
    for i in range(3)
) + """),
strings as (select raw as s from rr union select smiles from parts),
""" + COMPOSITION_SQL.strip() + """,
rv as (select *, case when contains(raw, '*') then 'wildcards:' || (length(raw) - length(replace(raw, '*', ''))) when len(string_split(raw, '.')) > 3 then 'fragments:' || len(string_split(raw, '.')) end as mark from rr),
facts as (
  select req.rid, req.name, any_value(p.name_key) as ref_name, any_value(p.inchikey) as ref_key, any_value(p.smiles) as ref_smiles, count(rv.i) as n_reads,
    count(*) filter (where mark is null and rv.inchikey is not null) as n_valid, count(distinct left(rv.inchikey, 14)) filter (where mark is null) as n_sk,
    min(i) filter (where mark is null and left(rv.inchikey, 14) = left(p.inchikey, 14)) as agree_i, min(i) filter (where mark is null and rv.inchikey is not null) as valid_i, min(i) as first_i,
    count(rv.i) filter (where rv.inchikey is null) as parse_fail, string_agg(engine || ' ' || mark, ';' order by i) filter (where mark is not null) as marks
  from req left join parts p on p.name_key = req.name left join rv using (rid) group by 1, 2),
ruled as (
  select f.*, r.raw as primary_raw, r.inchikey as primary_key, h.formula as read_formula, g.formula as formula_of_ref,
    case when n_valid >= 2 and n_sk > 1 and agree_i is not null then 'split_name_decides' when n_valid >= 2 and n_sk > 1 then 'split'
         when h.n_atoms >= 40 and h.n_atoms >= 3.0 * g.n_atoms then 'nonsense_size' when n_reads = 0 then 'no_reading' when n_valid = 0 then 'not_a_structure'
         when ref_key is null then 'no_reference' when left(r.inchikey, 14) = left(ref_key, 14) then 'same_skeleton' else 'other_skeleton' end as rule
  from facts f left join rr r on r.rid = f.rid and r.i = case when n_valid >= 2 and n_sk > 1 and agree_i is not null then agree_i else coalesce(valid_i, first_i) end
  left join hf h on h.s = r.raw left join hf g on g.s = f.ref_smiles),
judged as (
  select *, case when rule in ('split_name_decides', 'same_skeleton') then 'match' when rule = 'other_skeleton' then 'mismatch' else 'unreadable' end as verdict,
    case when rule = 'split_name_decides' then 'weak' when rule in ('no_reference', 'same_skeleton', 'other_skeleton') then case when n_valid >= 2 then 'strong' else 'weak' end end as grade
  from ruled)
"""


def parts(spark, sf):
    return d.table(spark, sf, "part").select(
        F.expr("concat('part ', cast(p_partkey as string))").alias("name_key"),
        F.expr(d.key("p_partkey", "'base'", "string")).alias("inchikey"), F.lit("").alias("formula"),
        F.expr(PART_SMILES.format("p_partkey")).alias("smiles"),
    )


def requests(spark, sf):
    """(request_id, name, reads): a request row carries its readings, none to three."""
    entries = [
        f"case when rid % 4 > {i} then named_struct("
        + ", ".join(f"'{name}', {sql}" for name, sql in read_fields(i, "string").items()) + ") end"
        for i in range(3)
    ]
    asked = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey as rid", "o_custkey as pk", "concat('part ', cast(o_custkey + (o_orderkey % 8) * 150 as string)) as name"
    )
    return asked.select(F.col("rid").alias("request_id"), "name", F.expr(f"array_compact(array({', '.join(entries)}))").alias("reads"))


def answered(spark, sf):
    return answer_requests(requests(spark, sf), parts(spark, sf))


@query(
    "service_verdicts",
    """select rid as request_id, verdict, grade, rule, primary_raw as read_smiles, read_formula,
    concat_ws(';', marks, case when ref_key is null and not (n_valid >= 2 and n_sk > 1) then 'name_not_found' end, rule,
      case when rule in ('not_a_structure', 'other_skeleton') and read_formula <> formula_of_ref then 'heavy_formula:' || read_formula || ':' || formula_of_ref end) as reasons from judged""",
    REQUESTS_SQL,
)
def service_verdicts(spark, sf):
    return answered(spark, sf).select(
        "request_id", "verdict", "grade", "rule", F.col("primary.raw").alias("read_smiles"), "read_formula",
        F.array_join("reasons", ";").alias("reasons"),
    )


@query(
    "check_responses",
    """select rid as request_id, verdict as v, ref_name as ref, primary_raw as smiles, case when n_valid > 0 then primary_key end as inchikey, n_reads as engines,
    (select string_agg(coalesce(cast(round(confidence, 4) as varchar), 'null'), ',' order by i) from rr where rr.rid = judged.rid) as confidences from judged""",
    REQUESTS_SQL,
)
def check_responses(spark, sf):
    out = ad.check_response(answered(spark, sf))
    body = F.from_json(
        "response",
        "verdict string, grade string, reference struct<name: string, smiles: string, inchikey: string, formula: string>, "
        "read struct<smiles: string, inchikey: string, heavy_formula: string, engines: array<struct<engine: string, confidence: double>>>, reasons array<string>",
    )
    scores = F.transform("b.read.engines", lambda e: F.coalesce(e["confidence"].cast("string"), F.lit("null")))
    return out.select("request_id", body.alias("b")).select(
        "request_id", F.col("b.verdict").alias("v"), F.col("b.reference.name").alias("ref"), F.col("b.read.smiles").alias("smiles"),
        F.col("b.read.inchikey").alias("inchikey"), F.size("b.read.engines").cast("bigint").alias("engines"),
        F.when(F.size("b.read.engines") > 0, F.array_join(scores, ",")).alias("confidences"),
    )


@query(
    "split_readings",
    """select rid as request_id, string_agg('read_as:' || engine || ':' || left(inchikey, 14), ';' order by i) as pairs,
      arg_min('winner:' || engine, i) filter (where left(inchikey, 14) = left(ref_key, 14)) as winner
    from judged join (select rid, i, engine, inchikey from rv where mark is null and inchikey is not null) v using (rid)
    where n_valid >= 2 and n_sk > 1 group by rid, ref_key""",
    REQUESTS_SQL,
)
def split_readings(spark, sf):
    """Who read what where readings part, as the responses tell it."""
    reasons = F.from_json("response", "reasons array<string>")["reasons"]
    # Exploded, so that a response is put together once however often its reasons are asked for.
    told = ad.check_response(answered(spark, sf)).select("request_id", F.posexplode(reasons).alias("at", "reason"))
    pair = F.when(F.col("reason").startswith("read_as:"), F.struct("at", "reason"))
    found = told.groupBy("request_id").agg(
        F.array_sort(F.collect_list(pair)).alias("pairs"), F.max(F.when(F.col("reason").startswith("winner:"), F.col("reason"))).alias("winner")
    )
    return found.where(F.size("pairs") > 0).select("request_id", F.array_join("pairs.reason", ";").alias("pairs"), "winner")


@query(
    "corpus_summary",
    """select crop, model, count(*) as n, count(*) filter (where verdict = 'mismatch') as mismatch, count(*) filter (where verdict = 'match') as match,
    count(*) filter (where verdict = 'unreadable') as unreadable, sum(parse_fail)::bigint as parse_fail, sum(n_reads)::bigint as reads, count(*) filter (where grade = 'strong') as strong
    from (select *, rid % 3 = 0 as crop, 'model' || (rid % 5) as model from judged) group by grouping sets ((crop, model), (crop))""",
    REQUESTS_SQL,
)
def corpus_summary(spark, sf):
    scored = answered(spark, sf).select(
        (F.col("request_id") % 3 == 0).alias("crop"), F.concat(F.lit("model"), (F.col("request_id") % 5).cast("string")).alias("model"),
        "verdict", "grade", F.size("reads").alias("engines"), F.size(F.filter("reads", lambda r: r["inchikey"].isNull())).alias("parse_fail"),
    )
    return ev.corpus_summary(scored)


@query(
    "rule_of_three", "select o_custkey as c, cast(round(300.0::double / count(*)) as int) as bound from orders group by 1",
)
def rule_of_three(spark, sf):
    counted = d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"))
    return counted.select("c", ev.rule_of_three(F.col("n")).alias("bound"))


@query(
    "image_labels",
    """select file, regexp_extract(file, '^(m[0-9])__', 1) as model, replace(p_name, '_', ' ') || ' ' || p_partkey as compound, p_partkey % 3 = 0 as crop from (
      select p_partkey, p_name, concat('m', p_partkey % 4, '__', replace(p_name, ' ', '_'), '_', p_partkey, case when p_partkey % 3 = 0 then '__crop' else '' end,
        case p_partkey % 5 when 0 then '.txt' when 1 then '.JPG' else '.png' end) as file from part) where p_partkey % 5 <> 0""",
)
def image_labels(spark, sf):
    from structaudit.sources.readers import read_image_labels

    path = (
        "concat('/deck/', 'm', p_partkey % 4, '__', replace(p_name, ' ', '_'), '_', p_partkey, "
        "case when p_partkey % 3 = 0 then '__crop' else '' end, case p_partkey % 5 when 0 then '.txt' when 1 then '.JPG' else '.png' end)"
    )
    return read_image_labels(d.table(spark, sf, "part").selectExpr(f"{path} as path"))


@query(
    "content_names",
    """select page_id, concat(coalesce(nullif(left(regexp_replace(url, '[^A-Za-z0-9_-]+', '', 'g'), 32), ''), 'image'), '-', left(sha1(html), 10), '.png') as name from pages""",
)
def content_names(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", bx.content_name(F.col("url"), F.col("html").cast("binary")).alias("name"))
