"""The deck check from text and readings to findings, over ``documents``, ``orders``, ``lineitem`` and ``part``.

A customer is a page, whose text is the document of that number and a caption for every third
order; its orders are the figures. A caption claims a part by a name that the dictionary holds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from structaudit.operators import decks as dk
from structaudit.operators import evaluate as ev
from structaudit.operators.figures import page_text
from structaudit.plans import derived as d
from structaudit.plans.adjudication import FINDINGS_SQL, MATCH_SQL, STABLE_SQL
from structaudit.plans.derived import DICT_SQL, READS_SQL, with_cte
from structaudit.plans.mining import DOCS_SQL, FLAGS_SQL, docs, tokens_sql
from structaudit.sources.shared import stored

QUERIES, SQL = {}, {}

CLAIMED = "case when item_id % 5 = 0 then truth_part + 1 else truth_part end"


def part_name(part: str, text: str) -> str:
    return f"concat(lower({d.enc(part, 10, text)}), 'amine')"


def elements(spark, sf):
    """(deck, page, pos, text): captions come with white space around them, as text boxes do.

    The texts are read for the references and again for the summary; captions cost a pass over the lines, so they are stored.
    """
    items = d.truth_parts(spark, sf)
    orders = d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").cast("bigint").alias("page")
    )
    caption = F.expr(f"concat('\\n ', {part_name(CLAIMED, 'string')}, '\\t\\n')")
    captions = stored(orders.join(items, "item_id").select("page", (F.col("item_id") + 1).cast("bigint").alias("pos"), caption.alias("text")))
    prose = docs(spark, sf).select(F.col("doc_id").cast("bigint").alias("page"), F.lit(0).cast("bigint").alias("pos"), "text")
    return prose.unionByName(captions).withColumn("deck", F.col("page") % 97)


def figures(spark, sf):
    page = F.col("o_custkey").cast("bigint")
    return d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), (page % 97).alias("deck"), page.alias("page"))


def dictionary(spark, sf):
    """The dictionary with a name for each part."""
    parts = d.table(spark, sf, "part").select(
        F.expr(part_name("p_partkey", "string")).alias("name_key"), F.expr(d.key("p_partkey", "'base'", "string")).alias("inchikey")
    )
    return d.dictionary(spark, sf).unionByName(parts, allowMissingColumns=True)


def checked(spark, sf):
    """Page texts, figures, references and findings of all decks.

    References cost most to find, are at most three a page, and are read again by every step after; so they are stored.
    """
    texts, figs = page_text(elements(spark, sf)), figures(spark, sf)
    refs = stored(dk.references_of(texts, dictionary(spark, sf)))
    return texts, figs, refs, dk.check_figures(figs, d.reads(spark, sf), refs)


PAGES_SQL = rf"""
pieces as (
  select doc_id as page, 0 as pos, text from docs
  union all select o_custkey, o_orderkey + 1, concat(chr(10), ' ', {part_name(CLAIMED, 'varchar')}, chr(9), chr(10))
  from orders join t on item_id = o_orderkey),
stripped as (select page, pos, regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as text from pieces),
pagetext as (select page as doc_id, string_agg(text, chr(10) order by pos) as text, sum(length(text)) as text_chars
             from stripped where text <> '' group by 1)
"""
DECK_SQL = f"""
deckdict as (select name_key, inchikey from dict
             union all select {part_name('p_partkey', 'varchar')}, {d.key('p_partkey', "'base'", 'varchar')} from part),
pagerefs as (
  select doc_id as page, row_number() over (partition by doc_id order by rank) - 1 as ref_no, name, inchikey from (
    select doc_id, inchikey, min(rank) as rank, arg_min(phrase, rank) as name
    from (select doc_id, phrase, row_number() over (partition by doc_id order by score desc, pos) as rank from cands qualify rank <= 25)
    join deckdict on name_key = lower(phrase) group by 1, 2)
  qualify ref_no < 3),
refs as (select o_orderkey as item_id, ref_no, inchikey from orders join pagerefs on page = o_custkey)
"""
FOUND_SQL = """
deckfound as (
  select o_custkey % 97 as deck, o_custkey as page, o_orderkey as item_id,
         case when n.inchikey is null then 'abstain' else coalesce(f.verdict, 'abstain') end as verdict,
         case when n.inchikey is not null then f.grade end as grade,
         case when n.inchikey is null then 'no_name' else coalesce(f.reason, 'no_engine') end as reason,
         f.ref_no, case when f.reason in ('exact', 'skeleton') then f.ref_key else n.inchikey end as ref_key,
         case when n.inchikey is not null then f.predicted_key end as predicted_key
  from orders left join (select item_id, inchikey from refs where ref_no = 0) n on n.item_id = o_orderkey
  left join findings f on f.item_id = o_orderkey)
"""
DECKS = (
    READS_SQL, DOCS_SQL, PAGES_SQL, tokens_sql("pagetext"), FLAGS_SQL, DICT_SQL, DECK_SQL, STABLE_SQL, MATCH_SQL, FINDINGS_SQL, FOUND_SQL,
)


def query(name, sql):
    def register(fn):
        QUERIES[name], SQL[name] = fn, with_cte(*DECKS, select=sql)
        return fn

    return register


@query(
    "deck_check_findings",
    """select deck, page, item_id, verdict, grade, reason, deckfound.ref_no, name, ref_key, predicted_key
    from deckfound left join (select page, name, inchikey as ref_key from pagerefs) using (page, ref_key)""",
)
def deck_check_findings(spark, sf):
    return checked(spark, sf)[3]


@query(
    "deck_check_summary",
    """select deck, coalesce(total, 0) as total, coalesce(total - abstain, 0) as judged, round((total - abstain) * 100.0::double / total, 1) as judged_pct,
    coalesce(ok, 0) as ok, coalesce(error, 0) as error, coalesce(warn, 0) as warn, coalesce(abstain, 0) as abstain,
    case when abstain > 0 then case when text_chars = 0 then 'no_text' when named = 0 then 'no_names' end end as note,
    coalesce(total > 0 and total = abstain, false) as nothing_judged
    from (select page % 97 as deck, sum(chars) as text_chars, count(distinct named) as named from (
            select doc_id as page, text_chars as chars, null as named from pagetext
            union all select distinct o_custkey, 0, null from orders
            union all select distinct page, 0, page from pagerefs) group by 1) p
    left join (select deck, count(*) as total, count(*) filter (where verdict = 'ok') as ok, count(*) filter (where verdict = 'error') as error,
      count(*) filter (where verdict = 'warn') as warn, count(*) filter (where verdict = 'abstain') as abstain from deckfound group by 1) f using (deck)""",
)
def deck_check_summary(spark, sf):
    texts, figs, refs, found = checked(spark, sf)
    return ev.document_summary(found, dk.page_facts(texts, figs, refs))
