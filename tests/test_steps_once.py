"""What costs most is worked out once, over tasks that are many enough, and with the same rows."""

import itertools
import random

from pyspark.sql import functions as F

from structaudit.operators import adjudicate as ad
from structaudit.operators import agreement as ag
from structaudit.operators import mining as mn
from structaudit.operators import resolve as rs
from structaudit.plans import decks, registry

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_references_are_mined_once_for_findings_and_summary(spark):
    _, _, refs, found = decks.checked(spark, SF)
    assert "regexp_extract_all" not in optimized(found) + optimized(refs)
    assert found.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_texts_of_one_row_group_are_mined_by_many_tasks(spark):
    docs = spark.createDataFrame([(i, "2-methyl propanol") for i in range(99)], "doc_id long, text string").coalesce(1)
    dealt = mn.dealt(docs, ["doc_id"])
    assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert "RepartitionByExpression [doc_id" in optimized(mn.candidates(docs, ["doc_id"], "text"))
    assert mn.candidates(docs, ["doc_id"], "text").count() == 99 * mn.candidates(docs.limit(1), ["doc_id"], "text").count()


def test_hangul_runs_meet_the_aliases_in_one_pass(spark):
    table = spark.createDataFrame(
        [("가나", "one", False, 1), ("가나은", "two", False, 2), ("다라", "all", True, 3), ("마-바", "four", False, 4), ("이", "five", False, 5)],
        "alias string, target string, whole_only boolean, ord int",
    ).withColumn("alias_key", F.regexp_replace("alias", "-", ""))
    docs = spark.createDataFrame([(1, "가나은 가나는, 가나이라는 x다라 마바으로 은 이은 이\n가나가나 가나 비타민C")], "doc_id long, text string")
    hits = mn.hangul_hits(docs, ["doc_id"], "text", table)
    assert optimized(hits).count("regexp_extract_all") == 1
    got = sorted((r.pos.line_no, r.pos.start, r.phrase) for r in hits.collect())
    assert got == [(0, 0, "two"), (0, 1, "one"), (0, 2, "one"), (0, 4, "four"), (0, 6, "five"), (0, 7, "five"), (1, 1, "one")]
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit("([가-힣]+)"), F.lit(1))).alias("query"))
    known = {r.query: r.target for r in rs.alias_lookup(runs, table, in_text=True).collect()}
    assert known == {"가나은": "two", "가나는": "one", "가나이라는": "one", "마바으로": "four", "이은": "five", "이": "five", "가나": "one"}


def test_references_and_readings_are_one_table_and_no_task_sorts_them_beside_the_readings(spark):
    plan = registry.QUERIES["name_first_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and plan.count("REPARTITION_BY_COL") == 2


def test_odd_keys_match_as_they_do_when_references_and_readings_are_joined(spark):
    long = [f"{a * 14}-{b * 8}SA-{c}" for a, b, c in itertools.product("AB", "XY", "NO")]
    keys = [*long, "A-B-CCCCCCCCCCCCCCC", "A-B-DDDDDDDDDDDDDDD", "A-B", "ABC", "XYZ", "", None]
    rng = random.Random(7)
    refs = [(i, n, "x", rng.choice(keys)) for i in range(600) for n in range(rng.randrange(4))]
    reads = [(i, n, rng.choice(["one/a", "one/b", "two", "three"]), rng.choice(keys), rng.choice([0.9, None]))
             for i in range(600) for n in range(rng.randrange(5))]
    refs = spark.createDataFrame(refs, "item_id int, ref_no int, name string, inchikey string")
    reads = spark.createDataFrame(reads, "item_id int, read_no int, engine string, inchikey string, confidence double")
    stable = ag.stable_reads(reads)
    joined = {r.item_id: (r.match_rank, r.ref_no, r.ref_key, r.matched_key) for r in ad.match_refs(refs, stable).collect()}
    families = {r.item_id: r.n for r in stable.groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    agreed = {r.item_id: r.agreed_key for r in ag.agreed_skeleton(stable).collect()}
    rank = {"exact": 1, "skeleton": 2}
    kinds = set()
    for r in ad.judge_name_first(refs, reads).collect():
        kinds.add(r.reason)
        if r.reason in rank:
            assert joined[r.item_id] == (rank[r.reason], r.ref_no, r.ref_key, r.predicted_key)
        elif r.verdict == "error":
            assert r.item_id not in joined
            assert r.reason == ("agreed_other" if r.item_id in agreed else "single_family_other" if families[r.item_id] < 2 else "families_disagree")
            assert r.item_id not in agreed or r.predicted_key == agreed[r.item_id]
        else:
            assert r.reason in ("no_name", "no_engine") or r.item_id not in families
    assert {"exact", "skeleton", "agreed_other", "single_family_other", "families_disagree", "self_inconsistent", "unparseable"} <= kinds


def test_candidates_are_grouped_once_for_their_ranks(spark):
    ranked = registry.QUERIES["agreement_candidates"](spark, SF)
    assert "l_orderkey" not in optimized(ranked)
    per_item = ranked.groupBy("item_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks"))
    assert per_item.count() and not per_item.where("n <> last or n <> ranks").count()
