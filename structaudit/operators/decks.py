"""The deck check as one job: page texts to references, references and readings to findings.

Everything is keyed by (deck, page) until a page's references meet its figures; there are at most
three references, so a page with very many figures grows with its figures alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structaudit.operators.adjudicate import judge_name_first
from structaudit.operators.labels import pair_items
from structaudit.operators.mining import candidates, page_references

PAGE = ["deck", "page"]


def references_of(
    texts: DataFrame, dict_df: DataFrame, cache: DataFrame | None = None, alias_df: DataFrame | None = None
) -> DataFrame:
    """(deck, page, ref_no, name, inchikey): the first known names of ``texts(deck, page, part, text)``."""
    offered = candidates(texts, PAGE, "text", alias_df=alias_df, part="part")
    return page_references(offered, PAGE, dict_df, cache=cache).select(*PAGE, "ref_no", "name", "inchikey")


def check_figures(figures: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """One finding for each of ``figures(item_id, deck, page)`` under the references of its own page.

    ``name`` is the reference that matched, or the page's first one. A figure on a page without a known
    name abstains, whatever was read; readings of other items are ignored.
    """
    claimed = pair_items(figures, refs, PAGE).where("inchikey is not null").select("item_id", "ref_no", "name", "inchikey")
    found = judge_name_first(claimed, reads)
    named = refs.select(*PAGE, F.col("inchikey").alias("ref_key"), "name")
    return (
        figures.select("item_id", *PAGE)
        .join(found, "item_id", "left")
        .na.fill({"verdict": "abstain", "reason": "no_name"})
        .join(named, [*PAGE, "ref_key"], "left")
        .select(*PAGE, "item_id", "verdict", "grade", "reason", "ref_no", "name", "ref_key", "predicted_key")
    )


def page_facts(texts: DataFrame, figures: DataFrame, refs: DataFrame) -> DataFrame:
    """(deck, page, n_figures, text_chars, n_refs) of every page that has text or figures."""
    counted = [
        texts.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("text_chars")),
        figures.groupBy(*PAGE).agg(F.count("*").alias("n_figures")),
        refs.groupBy(*PAGE).agg(F.count("*").alias("n_refs")),
    ]
    joined = counted[0].join(counted[1], PAGE, "full").join(counted[2], PAGE, "left")
    return joined.na.fill(0, ["text_chars", "n_figures", "n_refs"])
