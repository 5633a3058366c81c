"""What a task of the verdicts groups and sorts does not grow with the tables."""

import pytest

from structaudit.plans import adjudication, registry
from structaudit.plans import derived as d

SF = "/root/testdata/sf0.001"
FOUND = ("missing_cells", "name_first_by_truth", "name_first_findings", "scorecard", "scorecard_contrast", "verdict_outcomes")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_to_more_tasks_the_more_there_are(spark, monkeypatch):
    monkeypatch.setattr(d, "LINES", 100)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert d.lines(spark, SF).rdd.getNumPartitions() == d.tasks(spark, SF) == -(-n // 100)


@pytest.mark.parametrize("name", FOUND)
def test_no_split_of_the_file_is_grouped_before_it_is_dealt_out(spark, monkeypatch, name):
    few = sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(d, "LINES", 100)
    df = registry.QUERIES[name](spark, SF)
    # Above every scan of the lines: an exchange to the given number of tasks, with no aggregate between.
    plan, n_scans = executed(df).split("\n"), 0
    for at in (i for i, line in enumerate(plan) if "FileScan parquet [l_" in line):
        up = next(i for i in range(at, -1, -1) if "Exchange" in plan[i])
        assert f", {d.tasks(spark, SF)}), REPARTITION_BY_NUM" in plan[up]
        assert "Aggregate" not in "".join(plan[up:at])
        n_scans += 1
    assert n_scans
    assert sorted(map(str, df.collect())) == few


def test_points_and_items_of_findings_are_dealt_by_the_given_number(spark, monkeypatch):
    monkeypatch.setattr(d, "LINES", 100)
    plan = executed(adjudication.findings(spark, SF))
    assert "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_COL" not in plan


def test_lines_without_an_order_are_no_readings(spark, tmp_path):
    spark.createDataFrame(
        [(1, 1, 7, 3, 0.1), (1, 1, 5, 4, 0.2), (1, 2, 9, 2, 0.0), (None, 1, 4, 1, 0.0)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [(r.item_id, r.read_no) for r in d.reads(spark, str(tmp_path)).orderBy("read_no").collect()] == [(1, 1), (1, 2)]
    names = {r.item_id: r.name for r in d.items(spark, str(tmp_path)).collect()}
    assert names == {1: "part 5", None: "part 4"}
