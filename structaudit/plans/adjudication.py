"""Keys, agreement and verdicts over the readings derived from ``lineitem``."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from structaudit.functions import keys as k
from structaudit.operators import adjudicate as ad
from structaudit.operators import agreement as ag
from structaudit.operators import evaluate as ev
from structaudit.operators import labels as lb
from structaudit.plans import derived as d
from structaudit.plans.derived import READS_SQL, with_cte
from structaudit.sources.annotators import annotate

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_cte(*ctes, select=sql) if ctes else sql
        return fn

    return register


# Keys --------------------------------------------------------------------------------------

COMPARE_SQL = """case when coalesce({0}, '') = '' or coalesce({1}, '') = '' then 'uncomparable'
 when {0} = {1} or (split_part({0}, '-', 1) = split_part({1}, '-', 1) and split_part({0}, '-', 2) = split_part({1}, '-', 2)) then 'exact'
 when left({0}, 14) = left({1}, 14) then 'skeleton' else 'different' end"""


@query(
    "key_columns",
    f"""select item_id, read_no, family, skeleton, split_part(r.inchikey, '-', 2) as stereo_block,
    coalesce(regexp_matches(r.inchikey, '^[A-Z]{{14}}-[A-Z]{{10}}-[A-Z]$'), false) as valid, conf as confidence,
    {COMPARE_SQL.format('i.ref_key', 'r.inchikey')} as relation,
    case when confidence < 0.8 then '<0.8' when confidence < 0.85 then '0.8~0.85' when confidence < 0.9 then '0.85~0.9'
         when confidence < 1.01 then '0.9+' end as bin
    from r join items i using (item_id)""",
    READS_SQL,
)
def key_columns(spark, sf):
    reads, items = d.reads(spark, sf), d.items(spark, sf).select("item_id", "ref_key")
    key = F.col("inchikey")
    return reads.join(items, "item_id").select(
        "item_id", "read_no", k.engine_family(F.col("engine")).alias("family"), k.skeleton(key).alias("skeleton"),
        F.get(k.key_blocks(key), F.lit(1)).alias("stereo_block"),
        F.coalesce(k.is_valid_key(key), F.lit(False)).alias("valid"),
        k.confidence_or_floor(F.col("confidence")).alias("confidence"),
        k.compare_keys(F.col("ref_key"), key).alias("relation"),
        k.confidence_bin(F.col("confidence")).alias("bin"),
    )


@query(
    "token_confidence",
    """select l_orderkey as item_id, l_linenumber as read_no, n, round(case when n = 3 then (l_discount + l_tax + 0.5::double) / 3 when n = 1 then l_tax end, 9) as confidence
    from (select l_orderkey, l_linenumber, l_discount::double as l_discount, l_tax::double as l_tax, case l_linenumber % 3 when 0 then 3 when 1 then 1 else 0 end as n from lineitem)""",
)
def token_confidence(spark, sf):
    """A reading's confidence from its tokens' probabilities; a line has three tokens, one or none."""
    tokens = F.expr(
        "case l_linenumber % 3 when 0 then array(cast(l_discount as double), cast(l_tax as double), 0.5D) when 1 then array(cast(l_tax as double)) else cast(array() as array<double>) end"
    )
    lines = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("read_no"), tokens.alias("tokens"))
    return lines.select("item_id", "read_no", F.size("tokens").alias("n"), F.round(k.mean_token_confidence(F.col("tokens")), 9).alias("confidence"))


@query(
    "key_diff_mask",
    """select item_id, read_no, list_aggregate(list_transform(range(1, 28),
      lambda i: case when substr(i.ref_key, i, 1) = substr(r.inchikey, i, 1) then '=' else 'x' end), 'string_agg', '') as mask
    from r join items i using (item_id) where r.inchikey is not null""".replace("lambda i:", "lambda p:")
    .replace("substr(i.ref_key, i, 1)", "substr(i.ref_key, p, 1)").replace("substr(r.inchikey, i, 1)", "substr(r.inchikey, p, 1)"),
    READS_SQL,
)
def key_diff_mask(spark, sf):
    reads, items = d.reads(spark, sf), d.items(spark, sf).select("item_id", "ref_key")
    return reads.where("inchikey is not null").join(items, "item_id").select(
        "item_id", "read_no", k.key_diff_mask(F.col("ref_key"), F.col("inchikey")).alias("mask")
    )


# Agreement ---------------------------------------------------------------------------------


@query(
    "agreement_candidates",
    """select item_id, skeleton, n_families, n_reads, families, confidence, inchikey, stereo_differs,
    row_number() over (partition by item_id order by n_families desc, coalesce(confidence, -1) desc, first_no) as rank
    from (select item_id, skeleton, count(distinct family) as n_families, count(*) as n_reads,
                 string_agg(distinct family, ',' order by family) as families, max(confidence) as confidence,
                 arg_max(inchikey, row(conf, -read_no)) as inchikey, min(read_no) as first_no,
                 count(distinct inchikey) > 1 as stereo_differs
          from r where skeleton is not null group by 1, 2)""",
    READS_SQL,
)
def agreement_candidates(spark, sf):
    found = ag.agreement(d.reads(spark, sf))
    return found.select(
        "item_id", "skeleton", "n_families", "n_reads", F.array_join("families", ",").alias("families"),
        "confidence", "inchikey", "stereo_differs", "rank",
    )


@query(
    "candidate_contrasts",
    """select a.item_id, b.inchikey as leader_key, a.rank, a.inchikey, a.n_families, a.confidence
    from c a join c b on a.item_id = b.item_id and b.rank = 1 where a.rank > 1""",
    READS_SQL,
    """c as (select *, row_number() over (partition by item_id order by n_families desc, coalesce(confidence, -1) desc, first_no) as rank
    from (select item_id, skeleton, count(distinct family) as n_families, max(confidence) as confidence,
                 arg_max(inchikey, row(conf, -read_no)) as inchikey, min(read_no) as first_no
          from r where skeleton is not null group by 1, 2))""",
)
def candidate_contrasts(spark, sf):
    return ag.candidate_contrasts(ag.agreement(d.reads(spark, sf)))


@query(
    "recognition_status",
    """select i.item_id, case when n_sk is null or n_sk = 0 then 'no_result' when n_sk > 1 then 'uncertain'
                              when n_fam < 2 then 'single' else 'agreed' end as status,
    coalesce(n_fam, 0) as n_families, coalesce(n_bad, 0) as n_unreadable,
    case when n_sk = 1 and n_fam >= 2 then best end as answer_key,
    case when n_sk = 1 and n_fam >= 2 then n_keys > 1 end as stereo_differs
    from items i left join (
      select item_id, count(distinct skeleton) as n_sk, count(distinct family) filter (where skeleton is not null) as n_fam,
             count(*) filter (where skeleton is null) as n_bad, count(distinct inchikey) as n_keys,
             arg_max(inchikey, row(conf, -read_no)) filter (where skeleton is not null) as best
      from r group by 1) s using (item_id)""",
    READS_SQL,
)
def recognition_status(spark, sf):
    return ag.recognition_status(d.reads(spark, sf), d.items(spark, sf))


def _letters(value, n: int) -> str:
    return hashlib.md5(str(value).encode()).hexdigest()[:n].translate(str.maketrans("0123456789abcdef", "ABCDEFGHIJKLMNOP"))


def _key(value) -> str:
    return f"{_letters(value, 14)}-{_letters('base', 8)}SA-N"


class _ByCustomer:
    """An annotator over orders that times out on some, finds nothing on some, and names no structure on some."""

    name = "readera/v1"

    def read(self, item):
        k = item["o_custkey"]
        if k % 11 == 0:
            raise TimeoutError("no answer")
        if k % 7 == 0:
            return []
        return [("C*C", None, 0.5)] if k % 5 == 0 else [("CC", _key(k % 50), (70 + k % 30) / 100)]


class _ByOrder:
    """An annotator that says why it returned nothing where it ran out of memory."""

    name = "readerb"
    last_error = None

    def read(self, item):
        k = item["o_orderkey"]
        self.last_error = "out of memory" if k % 13 == 0 else None
        if self.last_error or k % 3 == 0:
            return []
        return [("CCO", _key(item["o_custkey"] % 50 if k % 4 else k % 50), float("nan"))]


@query(
    "annotator_outcomes",
    f"""select o.item_id, status, case when status <> 'no_result' then status when coalesce(n_unparsed, 0) > 0 then 'unparsed' when coalesce(n_failed, 0) > 0 then 'failed' else 'nothing' end as reason,
      coalesce(n_fam, 0) as n_families, coalesce(n_failed, 0) as n_failed, coalesce(n_unparsed, 0) as n_unparsed, first_error, case when status = 'agreed' then best end as answer_key
    from (
      select p.o_orderkey as item_id, case when coalesce(n_sk, 0) = 0 then 'no_result' when n_sk > 1 then 'uncertain' when n_fam < 2 then 'single' else 'agreed' end as status,
             n_fam, n_failed, n_unparsed, first_error, best
      from orders p left join (
        select item_id, count(distinct left(inchikey, 14)) as n_sk, count(distinct family) filter (where inchikey is not null) as n_fam, count(error) as n_failed,
               count(*) filter (where error is null and inchikey is null) as n_unparsed, min(error) as first_error,
               arg_max(inchikey, row(confidence, family <> 'readerb')) filter (where inchikey is not null) as best
        from said group by 1) s on s.item_id = p.o_orderkey) o""",
    f"""said as (
      select o_orderkey as item_id, 'readera' as family, case when o_custkey % 11 = 0 then 'TimeoutError: no answer' end as error,
             case when o_custkey % 11 <> 0 and o_custkey % 5 <> 0 then {d.key('o_custkey % 50', "'base'", 'varchar')} end as inchikey,
             cast(70 + o_custkey % 30 as double) / 100 as confidence
      from orders where o_custkey % 11 = 0 or o_custkey % 7 <> 0
      union all
      select o_orderkey, 'readerb', case when o_orderkey % 13 = 0 then 'out of memory' end,
             case when o_orderkey % 13 <> 0 then {d.key('case when o_orderkey % 4 <> 0 then o_custkey % 50 else o_orderkey % 50 end', "'base'", 'varchar')} end, -1
      from orders where o_orderkey % 13 = 0 or o_orderkey % 3 <> 0)""",
)
def annotator_outcomes(spark, sf):
    orders = d.table(spark, sf, "orders").withColumn("item_id", F.col("o_orderkey"))
    said = annotate(orders, {"a": _ByCustomer, "b": _ByOrder}, ["o_orderkey", "o_custkey"])
    return ag.recognition_outcomes(said, orders.select("item_id"))


@query(
    "best_per_family",
    """select item_id, family, arg_max(inchikey, row(conf, -read_no)) as inchikey,
    arg_max(case when confidence is null then -1 else confidence end, row(conf, -read_no)) as confidence,
    arg_max(read_no, row(conf, -read_no)) as read_no from r where skeleton is not null group by 1, 2""",
    READS_SQL,
)
def best_per_family(spark, sf):
    best = ag.best_per_family(d.reads(spark, sf))
    return best.select(
        "item_id", "family", "inchikey", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), "read_no"
    )


STABLE_SQL = """
stable as (select item_id, family, min(skeleton) as skeleton, arg_max(inchikey, row(conf, -read_no)) as key,
                  min(read_no) as first_no
           from r where inchikey is not null group by 1, 2 having count(distinct skeleton) = 1),
agreed as (select item_id, arg_min(skeleton, first_no) as skeleton, arg_min(key, first_no) as key from (
             select item_id, skeleton, min(first_no) as first_no, arg_min(key, first_no) as key
             from stable group by 1, 2 having count(*) >= 2) group by 1)
"""


@query("stable_reads", "select item_id, family, skeleton, key as inchikey, first_no from stable", READS_SQL, STABLE_SQL)
def stable_reads(spark, sf):
    return ag.stable_reads(d.reads(spark, sf)).select("item_id", "family", "skeleton", "inchikey", "first_no")


@query(
    "agreed_skeleton", "select item_id, skeleton as agreed_skeleton, key as agreed_key from agreed", READS_SQL, STABLE_SQL
)
def agreed_skeleton(spark, sf):
    return ag.agreed_skeleton(ag.stable_reads(d.reads(spark, sf)))


# Verdicts ----------------------------------------------------------------------------------

# Every item is claimed under two names here: its own and, second, a neighbour's key.
REFS_SQL = f"""
refs as (select item_id, 0 as ref_no, ref_key as inchikey from items
         union all select item_id, 1, {d.key("truth_part", "'flip'", "varchar")} from t where item_id % 3 = 0)
"""
MATCH_SQL = f"""
pairs as (select s.item_id, ref_no, first_no, refs.inchikey as ref_key, s.key as matched_key,
                 case {COMPARE_SQL.format('refs.inchikey', 's.key')} when 'exact' then 1 when 'skeleton' then 2 end as match_rank
          from stable s join refs using (item_id)),
matched as (select * from pairs where match_rank is not null
            qualify row_number() over (partition by item_id order by match_rank, ref_no, first_no) = 1)
"""
FINDINGS_SQL = f"""
findings as (
  select item_id, case reason when 'exact' then 'ok' when 'skeleton' then 'warn' when 'agreed_other' then 'error'
                   when 'single_family_other' then 'error' when 'families_disagree' then 'error' else 'abstain' end as verdict,
         case reason when 'agreed_other' then 'strong' when 'single_family_other' then 'weak' when 'families_disagree' then 'weak' end as grade,
         reason, case when reason in ('exact', 'skeleton') then ref_no end as ref_no,
         case when reason in ('exact', 'skeleton') then ref_key else first_ref end as ref_key,
         case when reason in ('exact', 'skeleton') then matched_key
              when reason in ('agreed_other', 'single_family_other', 'families_disagree') then coalesce(agreed_key, first_key) end as predicted_key
  from (select i.item_id, i.ref_key as first_ref, m.ref_no, m.ref_key, m.matched_key, a.key as agreed_key, first_key,
          case when n_reads is null then 'no_engine' when max_conf < 0.8 then 'low_confidence' when n_key = 0 then 'unparseable'
               when n_stable is null then 'self_inconsistent' when m.match_rank = 1 then 'exact' when m.match_rank = 2 then 'skeleton'
               when a.key is not null then 'agreed_other' when n_stable < 2 then 'single_family_other' else 'families_disagree' end as reason
        from items i
        left join (select item_id, count(*) as n_reads, max(confidence) as max_conf, count(inchikey) as n_key from r group by 1) s using (item_id)
        left join (select item_id, count(*) as n_stable, arg_min(key, first_no) as first_key from stable group by 1) f using (item_id)
        left join matched m using (item_id)
        left join agreed a using (item_id)))
"""


def claims(spark, sf):
    """Item references with a second one for every third item."""
    second = d.truth_parts(spark, sf).where("item_id % 3 = 0").select(
        "item_id", F.lit(1).alias("ref_no"), F.lit("second").alias("name"),
        F.expr(d.key("truth_part", "'flip'", "string")).alias("inchikey"),
    )
    return d.refs(d.items(spark, sf)).unionByName(second)


@query(
    "reference_matches", "select item_id, match_rank, ref_no, ref_key, matched_key from matched",
    READS_SQL, STABLE_SQL, REFS_SQL, MATCH_SQL,
)
def reference_matches(spark, sf):
    return ad.match_refs(claims(spark, sf), ag.stable_reads(d.reads(spark, sf)))


ONE_REF_SQL = "refs as (select item_id, 0 as ref_no, ref_key as inchikey from items)"


def findings(spark, sf):
    return ad.judge_name_first(d.refs(d.items(spark, sf)), d.reads(spark, sf), tasks=d.tasks(spark, sf))


@query(
    "name_first_findings", "select * from findings", READS_SQL, STABLE_SQL, REFS_SQL, MATCH_SQL, FINDINGS_SQL,
)
def name_first_findings(spark, sf):
    return ad.judge_name_first(claims(spark, sf), d.reads(spark, sf))


@query(
    "name_first_by_truth",
    """select truth, verdict, coalesce(grade, '') as grade, count(*) as n from findings join items using (item_id) group by 1, 2, 3""",
    READS_SQL, STABLE_SQL, ONE_REF_SQL, MATCH_SQL, FINDINGS_SQL,
)
def name_first_by_truth(spark, sf):
    truths = d.items(spark, sf).select("item_id", "truth")
    return (
        findings(spark, sf).join(truths, "item_id")
        .groupBy("truth", "verdict", F.coalesce("grade", F.lit("")).alias("grade"))
        .agg(F.count("*").alias("n"))
    )


NAIVE_SQL = f"""
naive as (select item_id, ref_key, predicted_key,
            case when predicted_key is null then 'unparseable'
                 when {COMPARE_SQL.format('ref_key', 'predicted_key')} = 'exact' then 'exact' else 'different' end as reason
          from (select i.item_id, i.ref_key, f.inchikey as predicted_key
                from items i join (select * from r qualify row_number() over (partition by item_id order by read_no) = 1) f using (item_id)))
"""
NAIVE_VERDICT = "case reason when 'exact' then 'ok' when 'different' then 'error' else 'abstain' end"


@query("naive_findings", f"select *, {NAIVE_VERDICT} as verdict from naive", READS_SQL, NAIVE_SQL)
def naive_findings(spark, sf):
    return ad.judge_naive(d.refs(d.items(spark, sf)), d.reads(spark, sf))


POLICY_SQL = """
per_item as (
  select item_id, count(skeleton) as n_ok, count(distinct skeleton) as n_sk,
         count(distinct family) filter (where skeleton is not null) as n_fam, min(family) filter (where skeleton is not null) as fam,
         arg_max(inchikey, row(conf, -read_no)) filter (where skeleton is not null) as best,
         max(conf) filter (where skeleton is not null) as best_conf
  from r group by 1),
consensus as (
  select item_id, case when n_ok = 0 then 'unreadable' when n_sk > 1 then 'skeletons_differ' when n_fam < 2 then 'one_family:' || fam else 'agreed' end as reason,
         case when n_sk = 1 and n_fam >= 2 then best end as decision_key from per_item),
confidence as (
  select item_id, case when n_ok = 0 then 'unreadable' when best_conf >= 0.8 then 'scored' when best_conf < 0 then 'unscored'
                       else printf('low_confidence:%.2f', best_conf) end as reason,
         case when n_ok > 0 and (best_conf >= 0.8 or best_conf < 0) then best end as decision_key from per_item)
"""


@query("consensus_policy", "select item_id, decision_key, reason from consensus", READS_SQL, POLICY_SQL)
def consensus_policy(spark, sf):
    return ad.consensus_policy(d.reads(spark, sf))


@query("confidence_policy", "select item_id, decision_key, reason from confidence", READS_SQL, POLICY_SQL)
def confidence_policy(spark, sf):
    return ad.confidence_policy(d.reads(spark, sf))


# Pages: an order's customer is its deck, its month the page.
PAGE_SQL = "o as (select o_orderkey as item_id, o_custkey % 97 as deck, month(o_orderdate) as page from orders)"


def page_items(spark, sf):
    return d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 97).alias("deck"), F.month("o_orderdate").alias("page")
    )


@query(
    "items_with_page_references",
    """select o.item_id, o.deck, o.page, s.ref_no, s.inchikey from o left join
    (select deck, page, row_number() over (partition by deck, page order by inchikey) - 1 as ref_no, inchikey
     from (select distinct deck, page, ref_key as inchikey from o join items using (item_id))
     qualify ref_no < 3) s using (deck, page)""",
    READS_SQL, PAGE_SQL,
)
def items_with_page_references(spark, sf):
    from structaudit.operators.ranking import top_k

    pages = page_items(spark, sf)
    keys = d.items(spark, sf).select("item_id", F.col("ref_key").alias("inchikey"))
    distinct = pages.join(keys, "item_id").select("deck", "page", "inchikey").distinct()
    refs = top_k(distinct, ["deck", "page"], [F.asc("inchikey")], 3, "ref_no").withColumn("ref_no", F.col("ref_no") - 1)
    return lb.pair_items(pages, refs, ["deck", "page"])


@query(
    "labelled_items",
    """select i.item_id, i.variant, case when l.quality = 1 then 'same' when l.toxic = 1 then 'not_structure' else 'no_claim' end as label
    from items i join labels l on i.item_id = l.doc_id""",
    READS_SQL,
)
def labelled_items(spark, sf):
    label = F.when(F.col("quality") == 1, "same").when(F.col("toxic") == 1, "not_structure").otherwise("no_claim")
    labels = d.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), label.alias("label"))
    return lb.with_labels(d.items(spark, sf).select("item_id", "variant"), labels)


@query(
    "variant_numbers",
    "select o_orderkey as item_id, ['plain','large','small','thick','rotated','serif','noisy','jpeg'][cast((o_orderkey + 7) % 8 as int) + 1] as variant from orders",
)
def variant_numbers(spark, sf):
    return d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), ev.variant_for(F.col("o_orderkey")).alias("variant")
    )
