"""Dictionary at rest, and a gate that is read off while its rows are written."""

from structaudit.operators.resolve import lookup_each
from structaudit.sources import writers


def test_lookup_does_not_shuffle_a_bucketed_dictionary(spark, tmp_path):
    names = spark.range(2000).selectExpr("concat('name', id) as name_key", "concat('K', id) as inchikey")
    writers.write_dictionary_table(names, "names_at_rest", str(tmp_path / "names"), 4)
    asked = spark.range(50).selectExpr("id as doc", "concat('Name', id * 50) as query").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup_each(asked, spark.table("names_at_rest"))
        assert {r["inchikey"] for r in found.collect()} == {f"K{i * 50}" for i in range(40)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        plan = plan[plan.index("Final Plan"):plan.index("Initial Plan")] if "Final Plan" in plan else plan
        scan = plan[: plan.index("Scan parquet")].splitlines()
        # Between the join and the scan of the table there is no exchange: the one there is belongs to the names asked for.
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in scan[-1] and "Exchange" not in scan[-2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table names_at_rest")


def test_gate_and_rows_come_from_one_job(spark, tmp_path):
    rows = [("a", "correct"), ("a", "declined"), ("b", "correct"), ("b", "confident_wrong")]
    outcomes = spark.createDataFrame(rows, "arm string, outcome string")
    context = spark.sparkContext
    context.setJobGroup("gated", "gated")
    try:
        passed = writers.write_gated(outcomes, str(tmp_path / "out"), ["a", "b", "c"])
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert passed == {"a": True, "b": False, "c": False}
    assert len(context.statusTracker().getJobIdsForGroup("gated")) == 1
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(rows)
