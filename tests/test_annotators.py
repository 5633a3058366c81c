"""Pluggable annotators: failures as rows, and the data source that reads slices."""

import pytest

from structaudit.operators import agreement as ag
from structaudit.sources import annotators as an

KEY, OTHER = "AAAAAAAAAAAAAA-BBBBBBBBSA-N", "CCCCCCCCCCCCCC-BBBBBBBBSA-N"


class Steady:
    """Holds items 0 to 5 in three slices; finds nothing in 3 and no structure in 4."""

    name = "steady/x1"

    def slices(self):
        return [[0, 1], [2, 3], [4, 5]]

    def items(self, part):
        return part

    def read(self, item):
        item = item if isinstance(item, int) else item["n"]
        return {3: [], 4: [("C*", None, 0.2)]}.get(item, [("CC", KEY, 0.9), ("CO", OTHER if item == 5 else KEY, float("nan"))])


class Shaky(Steady):
    """Dies on 1, 3 and 4, and gives up with a message on 2."""

    name = "shaky"
    last_error = None

    def slices(self):
        return [list(range(6))]

    def read(self, item):
        item = item if isinstance(item, int) else item["n"]
        self.last_error = None
        if item in (1, 3, 4):
            raise ValueError(f"bad picture {item}")
        if item == 2:
            self.last_error = "lost connection"
            return []
        return [("CC", KEY, None)]


@pytest.fixture(autouse=True)
def shipped(spark):
    """Workers import the annotators from this file."""
    spark.sparkContext.addPyFile(__file__)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, i, "x") for i in range(7)], "item_id int, n int, error string")


def outcomes(df):
    return {r["item_id"]: (r["status"], r["reason"], r["n_failed"], r["first_error"]) for r in df.collect()}


WANT = {
    0: ("agreed", "agreed", 0, None), 1: ("single", "single", 1, "ValueError: bad picture 1"), 2: ("single", "single", 1, "lost connection"),
    3: ("no_result", "failed", 1, "ValueError: bad picture 3"), 4: ("no_result", "unparsed", 1, "ValueError: bad picture 4"),
    5: ("uncertain", "uncertain", 0, None),
}


def test_failed_is_not_nothing(items):
    reads = an.annotate(items.where("n < 6"), {"a": Steady, "b": Shaky}, ["n"])
    rows = {(r["item_id"], r["read_no"]): r for r in reads.collect()}
    assert rows[1, 2]["error"] and rows[1, 2]["inchikey"] is None and rows[0, 1]["confidence"] is None
    assert outcomes(ag.recognition_outcomes(reads, items)) == WANT | {6: ("no_result", "nothing", 0, None)}


def test_nothing_found_by_anyone(items):
    reads = an.annotate(items, {"a": Steady}, ["n"])
    assert outcomes(ag.recognition_outcomes(reads, items))[3] == ("no_result", "nothing", 0, None)


def test_data_source_reads_slices(spark):
    an.register_readings(spark)
    names = f"{__name__}:Steady, {__name__}:Shaky"
    reads = spark.read.format("readings").option("annotators", names).load()
    assert reads.rdd.getNumPartitions() == 4
    engines = {(r["item_id"], r["engine"], r["read_no"], r["error"]) for r in reads.collect()}
    assert (2, "shaky", 0, "lost connection") in engines and (0, "steady/x1", 1, None) in engines
    assert outcomes(ag.recognition_outcomes(reads, reads.select("item_id").distinct())) == WANT
    with pytest.raises(Exception, match="at least one annotator"):
        spark.read.format("readings").load().collect()


def test_no_items(items):
    assert an.annotate(items.where("n > 100"), {"a": Steady}, ["n"]).collect() == []
