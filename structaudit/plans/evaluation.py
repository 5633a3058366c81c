"""Outcomes, reader records, calibration and document summaries over the derived readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from structaudit.operators import adjudicate as ad
from structaudit.operators import evaluate as ev
from structaudit.operators.ranking import systematic_sample
from structaudit.plans import derived as d
from structaudit.plans.adjudication import (
    FINDINGS_SQL,
    MATCH_SQL,
    NAIVE_SQL,
    NAIVE_VERDICT,
    ONE_REF_SQL,
    POLICY_SQL,
    STABLE_SQL,
    findings,
    page_items,
)
from structaudit.plans.derived import READS_SQL, with_cte

QUERIES, SQL = {}, {}


def query(name, sql=None, *ctes):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_cte(*ctes, select=sql) if ctes else sql
        return fn

    return register


OUTCOMES_SQL = """
decided as (select 'consensus' as arm, * from consensus union all select 'confidence' as arm, * from confidence),
outcomes as (
  select arm, i.item_id, i.variant, p.decision_key, p.reason,
         case when p.decision_key is null then 'declined' when left(p.decision_key, 14) = left(i.inchikey, 14) then 'correct'
              else 'confident_wrong' end as outcome,
         coalesce(p.decision_key = i.inchikey, false) as exact,
         exists (select 1 from r where r.item_id = i.item_id and r.skeleton = left(i.inchikey, 14)) as truth_available
  from items i join decided p using (item_id))
"""
BASE = (READS_SQL, POLICY_SQL, OUTCOMES_SQL)
PER_FAMILY_SQL = """
pf as (select r.item_id, family, count(*) as n_reads, count(skeleton) as n_ok, bool_or(confidence is not null) as scored,
              arg_max(r.inchikey, row(conf, -read_no)) filter (where skeleton is not null) as best,
              max(confidence) filter (where skeleton is not null) as best_conf, any_value(i.inchikey) as truth, any_value(i.variant) as variant
       from r join items i using (item_id) group by 1, 2),
ans as (select item_id, count(*) as n_answered, count(*) filter (where left(best, 14) <> left(truth, 14)) as n_wrong,
               count(distinct left(best, 14)) = 1 as one_skeleton
        from pf where best is not null group by 1)
"""


def outcomes(spark, sf):
    return ev.evaluate(d.reads(spark, sf), d.items(spark, sf), ad.POLICIES)


@query("policy_outcomes", "select * from outcomes", *BASE)
def policy_outcomes(spark, sf):
    return outcomes(spark, sf)


@query(
    "policy_cards",
    """select *, round(correct / n, 9) as correct_rate, round(confident_wrong / n, 9) as confident_wrong_rate, round(declined / n, 9) as declined_rate
    from (select arm, count(*) as n, count(*) filter (where outcome = 'correct') as correct,
      count(*) filter (where outcome = 'confident_wrong') as confident_wrong, count(*) filter (where outcome = 'declined') as declined,
      count(*) filter (where outcome = 'correct' and exact) as exact,
      count(*) filter (where outcome = 'declined' and truth_available) as declined_with_truth from outcomes group by 1)""",
    *BASE,
)
def policy_cards(spark, sf):
    cards = ev.card(outcomes(spark, sf))
    return cards.select(
        *[F.round(c, 9).alias(c) if c.endswith("_rate") else c for c in cards.columns]
    )


@query("decline_reasons", "select arm, reason, count(*) as n, row_number() over (partition by arm order by count(*) desc, reason nulls last) as place from outcomes where outcome = 'declined' group by 1, 2", *BASE)
def decline_reasons(spark, sf):
    return ev.decline_reasons(outcomes(spark, sf))


@query(
    "outcomes_by_variant",
    """select arm, variant, count(*) as n, count(*) filter (where outcome = 'correct') as correct,
    count(*) filter (where outcome = 'confident_wrong') as confident_wrong, count(*) filter (where outcome = 'declined') as declined,
    list_position(['plain','large','small','thick','rotated','serif','noisy','jpeg'], variant) as variant_order from outcomes group by 1, 2""",
    *BASE,
)
def outcomes_by_variant(spark, sf):
    return ev.by_variant(outcomes(spark, sf))


@query(
    "policy_flips",
    """select a.item_id, a.outcome as outcome_a, b.outcome as outcome_b from outcomes a join outcomes b using (item_id)
    where a.arm = 'consensus' and b.arm = 'confidence' and a.outcome <> b.outcome""",
    *BASE,
)
def policy_flips(spark, sf):
    return ev.flips(outcomes(spark, sf), "consensus", "confidence")


@query(
    "policy_contrast",
    """select count(*) filter (where arm = 'confidence' and outcome = 'confident_wrong') - count(*) filter (where arm = 'consensus' and outcome = 'confident_wrong') as prevented_wrong,
    count(*) filter (where arm = 'confidence' and outcome = 'correct') - count(*) filter (where arm = 'consensus' and outcome = 'correct') as given_up_correct from outcomes""",
    *BASE,
)
def policy_contrast(spark, sf):
    return ev.contrast(ev.card(outcomes(spark, sf)), "consensus", "confidence")


@query("quality_gate", "select arm, count(*) filter (where outcome = 'confident_wrong') = 0 as passed from outcomes group by 1", *BASE)
def quality_gate(spark, sf):
    return ev.gate(ev.card(outcomes(spark, sf)))


@query(
    "annotator_stats",
    """select family, count(*) as images, count(best) as answered, count(*) filter (where left(best, 14) = left(truth, 14)) as correct,
    count(*) filter (where best = truth) as exact, count(*) filter (where left(best, 14) <> left(truth, 14)) as wrong,
    count(*) filter (where n_ok < n_reads) as unreadable,
    count(*) filter (where left(best, 14) <> left(truth, 14) and best_conf >= 0.8) as confident_wrong, bool_or(scored) as gives_confidence
    from pf group by 1""",
    READS_SQL, PER_FAMILY_SQL,
)
def annotator_stats(spark, sf):
    return ev.annotator_stats(d.reads(spark, sf), d.items(spark, sf))


@query(
    "calibration",
    """select family, bin, count(*) filter (where ok) as "right", count(*) filter (where not ok) as wrong from s
    where bin <> 'none' or family not in (select family from s where bin <> 'none') group by 1, 2""",
    READS_SQL,
    """s as (select family, case when confidence is null then 'none' when confidence < 0.8 then '<0.8' when confidence < 0.85 then '0.8~0.85'
             when confidence < 0.9 then '0.85~0.9' else '0.9+' end as bin, skeleton = left(i.inchikey, 14) as ok
      from r join items i using (item_id) where skeleton is not null)""",
)
def calibration(spark, sf):
    return ev.calibration(d.reads(spark, sf), d.items(spark, sf))


@query(
    "confidence_separation",
    """select family, right_low, rl[right_total // 2 + 1] as right_median, right_high, right_total, wrong_low,
      wl[wrong_total // 2 + 1] as wrong_median, wrong_high, wrong_total, right_low > wrong_high as separable from g""",
    READS_SQL,
    """s as (select family, confidence as c, skeleton = left(i.inchikey, 14) as ok from r join items i using (item_id)
           where skeleton is not null and confidence is not null),
    g as (select family, min(c) filter (where ok) as right_low, list_sort(list(c) filter (where ok)) as rl, max(c) filter (where ok) as right_high,
      count(*) filter (where ok) as right_total, min(c) filter (where not ok) as wrong_low, list_sort(list(c) filter (where not ok)) as wl,
      max(c) filter (where not ok) as wrong_high, count(*) filter (where not ok) as wrong_total from s group by 1)""",
)
def confidence_separation(spark, sf):
    return ev.confidence_separation(d.reads(spark, sf), d.items(spark, sf))


@query(
    "variant_by_annotator",
    """select f.family, i.variant, count(*) as n, count(*) filter (where pf.best is null or left(pf.best, 14) <> left(i.inchikey, 14)) as wrong
    from items i cross join (select distinct family from r) f left join pf on pf.item_id = i.item_id and pf.family = f.family group by 1, 2""",
    READS_SQL, PER_FAMILY_SQL,
)
def variant_by_annotator(spark, sf):
    return ev.variant_by_annotator(d.reads(spark, sf), d.items(spark, sf))


@query(
    "collusion",
    """select count(*) as answered_by_two, count(*) filter (where n_wrong = n_answered and one_skeleton) as same_wrong,
    count(*) filter (where n_wrong = n_answered and not one_skeleton) as different_wrong,
    round(count(*) filter (where n_wrong = n_answered) / count(*), 9) as rate from ans where n_answered >= 2""",
    READS_SQL, PER_FAMILY_SQL,
)
def collusion(spark, sf):
    return ev.collusion(d.reads(spark, sf), d.items(spark, sf)).withColumn("rate", F.round("rate", 9))


@query(
    "recoverable",
    """select arm, count(*) as declined, count(*) filter (where n_answered >= 2 and n_wrong = 1) as one_wrong,
    round(count(*) filter (where n_answered >= 2 and n_wrong = 1) / count(*), 9) as share
    from outcomes left join ans using (item_id) where outcome = 'declined' group by 1""",
    *BASE, PER_FAMILY_SQL,
)
def recoverable(spark, sf):
    reads, items = d.reads(spark, sf), d.items(spark, sf)
    won = ev.recoverable(ev.evaluate(reads, items, ad.POLICIES), reads, items)
    return won.withColumn("share", F.round("share", 9))


@query(
    "threshold_effect",
    """select count(*) filter (where left(decision_key, 14) = left(inchikey, 14)) as "right",
    count(*) filter (where left(decision_key, 14) <> left(inchikey, 14)) as wrong
    from consensus join per_item using (item_id) join items using (item_id) where decision_key is not null and best_conf between 0 and 0.799999""",
    READS_SQL, POLICY_SQL,
)
def threshold_effect(spark, sf):
    return ev.threshold_effect(d.reads(spark, sf), d.items(spark, sf))


DIAGNOSED_SQL = """
diagnosed as (
  select arm, o.item_id, o.variant, case when n_fam < 2 then 'one_annotator' when n_keys > 1 then 'coincident' else 'same_misread' end as cause
  from outcomes o join (select item_id, count(distinct family) filter (where skeleton is not null) as n_fam, count(distinct inchikey) as n_keys from r group by 1) s using (item_id)
  where outcome = 'confident_wrong')
"""


@query("diagnosed_failures", "select * from diagnosed", *BASE, DIAGNOSED_SQL)
def diagnosed_failures(spark, sf):
    reads, items = d.reads(spark, sf), d.items(spark, sf)
    return ev.diagnose(ev.evaluate(reads, items, ad.POLICIES), reads)


@query(
    "diagnosis_totals",
    """select arm, count(*) filter (where cause = 'same_misread') as same_misread, count(*) filter (where cause = 'coincident') as coincident,
    count(*) filter (where cause = 'one_annotator') as one_annotator, count(distinct variant) = 1 and count(*) > 1 as one_variant from diagnosed group by 1""",
    *BASE, DIAGNOSED_SQL,
)
def diagnosis_totals(spark, sf):
    return ev.diagnosis_totals(diagnosed_failures(spark, sf))


# Name-first findings on the same scales ----------------------------------------------------

FOUND = (READS_SQL, STABLE_SQL, ONE_REF_SQL, MATCH_SQL, FINDINGS_SQL)


@query(
    "rescored_outcomes",
    """select case verdict when 'ok' then 'correct' when 'warn' then 'correct' when 'error' then 'confident_wrong' else 'declined' end as outcome,
    verdict, reason, count(*) as n, count(*) filter (where predicted_key = i.inchikey) as exact,
    count(*) filter (where exists (select 1 from r where r.item_id = i.item_id and r.skeleton = left(i.inchikey, 14))) as truth_available
    from findings f join items i using (item_id) group by 1, 2, 3""",
    *FOUND,
)
def rescored_outcomes(spark, sf):
    reads, items = d.reads(spark, sf), d.items(spark, sf)
    scored = ev.rescore(reads, items, ad.judge_name_first(d.refs(items), reads))
    return scored.groupBy("outcome", "verdict", "reason").agg(
        F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if("truth_available").alias("truth_available")
    )


# Seven kinds of truth: the derived truth, with some items relabelled as not judgeable.
TRUTH7 = (
    "case when item_id % 31 = 0 then 'not_structure' when item_id % 31 = 1 then 'no_claim' when item_id % 31 = 2 then 'generic_formula' "
    "when item_id % 31 = 3 then 'reaction_scheme' when item_id % 31 = 4 then 'stereo_diff' else truth end"
)
OUTCOME7_SQL = f"""
cells(truth, verdict, outcome) as (values
  ('same', 'ok', 'cleared'), ('same', 'error', 'false_alarm'), ('same', 'warn', 'misgraded'), ('same', 'abstain', 'silent'),
  ('skeleton_diff', 'ok', 'missed'), ('skeleton_diff', 'error', 'caught'), ('skeleton_diff', 'warn', 'misgraded'), ('skeleton_diff', 'abstain', 'silent'),
  ('stereo_diff', 'ok', 'missed'), ('stereo_diff', 'error', 'false_alarm'), ('stereo_diff', 'warn', 'caught'), ('stereo_diff', 'abstain', 'silent'),
  ('not_structure', 'ok', 'misgraded'), ('not_structure', 'error', 'false_alarm'), ('not_structure', 'warn', 'misgraded'), ('not_structure', 'abstain', 'declined'),
  ('no_claim', 'ok', 'misgraded'), ('no_claim', 'error', 'false_alarm'), ('no_claim', 'warn', 'misgraded'), ('no_claim', 'abstain', 'declined'),
  ('generic_formula', 'ok', 'misgraded'), ('generic_formula', 'error', 'false_alarm'), ('generic_formula', 'warn', 'misgraded'), ('generic_formula', 'abstain', 'declined'),
  ('reaction_scheme', 'ok', 'misgraded'), ('reaction_scheme', 'error', 'false_alarm'), ('reaction_scheme', 'warn', 'misgraded'), ('reaction_scheme', 'abstain', 'declined')),
{NAIVE_SQL.strip()},
labelled as (select item_id, {TRUTH7} as truth from items),
arms as (select 'name_first' as arm, item_id, verdict from findings union all select 'naive', item_id, {NAIVE_VERDICT} from naive),
outcomes7 as (select arm, item_id, truth, verdict, outcome from arms join labelled using (item_id) join cells using (truth, verdict))
"""
SEVEN = (*FOUND, OUTCOME7_SQL)


def outcomes7(spark, sf):
    reads, items = d.reads(spark, sf), d.items(spark, sf)
    labels = items.select("item_id", F.expr(TRUTH7).alias("truth"))
    arms = [
        found.select("item_id", "verdict").withColumn("arm", F.lit(arm))
        for arm, found in (("name_first", findings(spark, sf)), ("naive", ad.judge_naive(d.refs(items), reads)))
    ]
    return ev.outcomes7(labels, arms[0].unionByName(arms[1]))


@query("verdict_outcomes", "select arm, truth, verdict, outcome, count(*) as n from outcomes7 group by 1, 2, 3, 4", *SEVEN)
def verdict_outcomes(spark, sf):
    return outcomes7(spark, sf).groupBy("arm", "truth", "verdict", "outcome").agg(F.count("*").alias("n"))


@query(
    "missing_cells",
    "select truth, verdict from cells where (truth, verdict) not in (select (truth, verdict) from outcomes7)", *SEVEN,
)
def missing_cells(spark, sf):
    return ev.missing_cells(outcomes7(spark, sf))


SCORECARD_SQL = """
cards as (
  select arm, count(*) as n, count(*) filter (where truth in ('same', 'skeleton_diff', 'stereo_diff')) as judgeable,
    count(*) filter (where truth not in ('same', 'skeleton_diff', 'stereo_diff')) as not_judgeable,
    count(*) filter (where truth in ('not_structure', 'no_claim')) as no_target,
    count(*) filter (where truth in ('generic_formula', 'reaction_scheme')) as out_of_scope,
    count(*) filter (where truth <> 'skeleton_diff') as no_error_expected,
    count(*) filter (where truth in ('skeleton_diff', 'stereo_diff')) as wrong_labelled,
    count(*) filter (where outcome = 'cleared') as cleared, count(*) filter (where outcome = 'caught') as caught,
    count(*) filter (where outcome = 'false_alarm') as false_alarm, count(*) filter (where outcome = 'missed') as missed,
    count(*) filter (where outcome = 'misgraded') as misgraded, count(*) filter (where outcome = 'silent') as silent,
    count(*) filter (where outcome = 'declined') as declined
  from outcomes7 group by 1)
"""


@query(
    "scorecard",
    """select *, round(1 - silent / judgeable, 9) as coverage, round(false_alarm / no_error_expected, 9) as false_alarm_rate,
    round(caught / wrong_labelled, 9) as detection_rate, round(declined / not_judgeable, 9) as decline_rate from cards""",
    *SEVEN, SCORECARD_SQL,
)
def scorecard(spark, sf):
    cards = ev.scorecard(outcomes7(spark, sf))
    return cards.select(
        *[F.round(c, 9).alias(c) if c.endswith("_rate") or c == "coverage" else c for c in cards.columns]
    )


@query(
    "scorecard_contrast",
    """select sum(case arm when 'naive' then false_alarm else -false_alarm end)::bigint as prevented_false_alarms,
    sum(case arm when 'naive' then -(judgeable - silent) else judgeable - silent end)::bigint as judged_difference from cards""",
    *SEVEN, SCORECARD_SQL,
)
def scorecard_contrast(spark, sf):
    return ev.scorecard_contrast(ev.scorecard(outcomes7(spark, sf)), "name_first", "naive")


# Documents ---------------------------------------------------------------------------------

PAGES_SQL = """
o as (select o_orderkey as item_id, o_custkey % 97 as deck, month(o_orderdate) as page from orders),
pf2 as (select deck, page, verdict, reason from findings join o using (item_id)),
pages2 as (select deck, page, case when deck % 11 = 0 then 0 else count(*) * 40 end as text_chars, count(*) as n_figures,
                  case when deck % 7 = 0 then 0 else count(*) filter (where item_id % 5 < 2) end as n_refs
           from o group by 1, 2)
"""


def deck_findings(spark, sf):
    return findings(spark, sf).select("item_id", "verdict", "reason").join(page_items(spark, sf), "item_id")


def deck_pages(spark, sf):
    pages = page_items(spark, sf).groupBy("deck", "page").agg(
        F.count("*").alias("n_figures"), F.count_if(F.col("item_id") % 5 < 2).alias("named")
    )
    return pages.select(
        "deck", "page", "n_figures",
        F.when(F.col("deck") % 11 == 0, 0).otherwise(F.col("n_figures") * 40).alias("text_chars"),
        F.when(F.col("deck") % 7 == 0, 0).otherwise(F.col("named")).alias("n_refs"),
    )


@query(
    "verdict_summary",
    """select v.verdict, count(f.item_id) as n from (values ('ok'), ('error'), ('warn'), ('abstain')) v(verdict)
    left join findings f using (verdict) group by 1""",
    *FOUND,
)
def verdict_summary(spark, sf):
    return ev.verdict_summary(findings(spark, sf))


@query(
    "document_summary",
    """select p.deck, coalesce(total, 0) as total, coalesce(total - abstain, 0) as judged, round((total - abstain) * 100.0::double / total, 1) as judged_pct,
    coalesce(ok, 0) as ok, coalesce(error, 0) as error, coalesce(warn, 0) as warn, coalesce(abstain, 0) as abstain,
    case when abstain > 0 and n_figures > 0 then case when text_chars = 0 then 'no_text' when named = 0 then 'no_names' end end as note,
    coalesce(total > 0 and total = abstain, false) as nothing_judged
    from (select deck, sum(n_figures) as n_figures, sum(text_chars) as text_chars, count(*) filter (where n_refs > 0) as named from pages2 group by 1) p
    left join (select deck, count(*) as total, count(*) filter (where verdict = 'ok') as ok, count(*) filter (where verdict = 'error') as error,
      count(*) filter (where verdict = 'warn') as warn, count(*) filter (where verdict = 'abstain') as abstain from pf2 group by 1) f using (deck)""",
    *FOUND, PAGES_SQL,
)
def document_summary(spark, sf):
    return ev.document_summary(deck_findings(spark, sf), deck_pages(spark, sf))


@query(
    "abstain_buckets",
    """select *, row_number() over (partition by deck order by n desc, bucket nulls last) as place from (
      select deck, case when text_chars = 0 then 'no text layer' when reason = 'no_engine' then 'no reader available'
      when reason = 'low_confidence' then 'low reading confidence' when reason = 'self_inconsistent' then 'readers disagree'
      when reason = 'unparseable' then 'reading is no structure' else reason end as bucket, count(*) as n
    from pf2 join (select deck, sum(text_chars) as text_chars from pages2 group by 1) using (deck) where verdict = 'abstain' group by 1, 2)""",
    *FOUND, PAGES_SQL,
)
def abstain_buckets(spark, sf):
    return ev.abstain_buckets(deck_findings(spark, sf), deck_pages(spark, sf))


@query(
    "page_funnel",
    """select count(*) as pages, count(*) filter (where n_figures > 0) as with_figures, count(*) filter (where n_refs > 0) as with_names,
    count(*) filter (where n_figures > 0 and n_refs > 0) as with_both, sum(n_figures) filter (where n_refs > 0)::bigint as figures_with_names,
    sum(n_figures)::bigint as figures from pages2""",
    *FOUND, PAGES_SQL,
)
def page_funnel(spark, sf):
    return ev.page_funnel(deck_pages(spark, sf))


@query(
    "systematic_sample",
    """select item_id, truth from (select *, row_number() over (order by item_id) as rn, count(*) over () as n from items)
    where rn in (select cast(floor(j * (n / 1000.0::double)) as bigint) + 1 from range(1000) g(j))""",
    READS_SQL,
)
def sample_of_items(spark, sf):
    return systematic_sample(d.items(spark, sf).select("item_id", "truth"), [F.asc("item_id")], 1000, [F.floor(F.col("item_id") / 1000), F.floor(F.col("item_id") / 1_000_000)])
