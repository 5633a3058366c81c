"""Near-duplicate vectors by collision-counting projections.

Each unit vector is projected on many random lines. Two vectors collide on a line if their
projections lie within a window centred on either. For a pair at the threshold the difference on
a line is normal with a known spread, so the number of collisions that such a pair passes with the
wanted recall follows from the binomial distribution. Comparing all vectors on all lines would be
quadratic, so lines are taken in tables: only vectors in the same slice of every line of some table
meet; there they are sorted along a line, pairs within its window have their collisions on all
lines counted, and pairs that reach the calibrated count are verified by their cosine.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structaudit.llm.common import checkpointed
from structaudit.llm.components import components

SLICE = 2.0  # width of a slice on a table's line; unit vectors spread with deviation 1
WINDOW = 0.4  # half width of the counting window
OCCUPANCY = 16  # vectors that a cell holds on average, if all are unrelated
BLOCK = 2048  # vectors of a cell that one task compares with as many others
PAIRS = 20_000  # pairs whose collisions are counted at once


@dataclass(frozen=True)
class Lines:
    """How many lines and tables, and the count that a pair must reach."""

    lines: int
    tables: int
    least: int

    @functools.lru_cache(8)
    def directions(self, dim: int) -> np.ndarray:
        return np.random.default_rng(7_919).standard_normal((dim, self.lines * self.tables))

    def offsets(self) -> np.ndarray:
        return np.random.default_rng(104_729).random(self.lines * self.tables) * SLICE


def calibrated(n: int, threshold: float, recall: float) -> Lines:
    """Lines for ``n`` vectors: a pair exactly at the threshold is found with the wanted recall."""
    gap = math.sqrt(2 - 2 * threshold)
    normal = NormalDist()

    def same_slice(distance: float) -> float:
        r = SLICE / distance
        return 1 - 2 * normal.cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    # A table generates a pair that shares its cell and lies within the window on its first line.
    inside = 2 * normal.cdf(WINDOW / gap) - 1
    beside = 2 * gap / (math.sqrt(2 * math.pi) * SLICE) * (1 - math.exp(-((WINDOW / gap) ** 2) / 2))

    lines = max(2, math.ceil(math.log(max(n, 1) / OCCUPANCY) / -math.log(same_slice(math.sqrt(2))))) if n > OCCUPANCY else 2
    miss = (1 - recall) / 2
    tables = math.ceil(math.log(miss) / math.log1p(-(inside - beside) * same_slice(gap) ** (lines - 1)))
    p, total = inside, lines * tables
    spread = math.sqrt(total * p * (1 - p))
    return Lines(lines, tables, max(0, math.floor(total * p + normal.inv_cdf(miss) * spread)))


def _cells(lines: Lines, unit: np.ndarray) -> np.ndarray:
    """One 64-bit cell number for each vector and table."""
    at = np.floor((unit @ lines.directions(unit.shape[1]) + lines.offsets()) / SLICE).astype(np.int64).view(np.uint64)
    at = at.reshape(len(unit), lines.tables, lines.lines)
    cell = np.full(at.shape[:2], unit.shape[1] * 0x9E3779B1, np.uint64)
    for i in range(lines.lines):
        cell = (cell ^ at[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        cell ^= cell >> np.uint64(29)
    return cell.view(np.int64)


def _unit(column) -> np.ndarray:
    m = np.array(column.to_pylist() if hasattr(column, "to_pylist") else list(column), np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _linked(lines: Lines, ids, copies, cells, unit, block, i, j, table, threshold):
    """Links of one comparison: (id, linked rows) for each member, and edges that connect them."""
    n = len(ids)
    links, left, right = np.zeros(n, np.int64), [], []
    sides = unit @ lines.directions(unit.shape[1])
    line = table * lines.lines
    order = np.argsort(sides[:, line], kind="stable")
    value = sides[order, line]
    end = np.searchsorted(value, value + WINDOW, side="right")
    width = end - np.arange(n) - 1
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(np.cumsum(width[start:]), PAIRS)) + start)
        w = width[start:stop]
        a = np.repeat(np.arange(start, stop), w)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
        a, b = order[a], order[b]
        if i != j:
            across = block[a] != block[b]
            a, b = a[across], b[across]
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            # A pair that an earlier table generates too is counted there.
            firsts = slice(0, line, lines.lines)
            close = np.abs(sides[x, firsts] - sides[y, firsts]) <= WINDOW
            first = ~((cells[x, :table] == cells[y, :table]) & close).any(axis=1)
            x, y = x[first], y[first]
            many = (np.abs(sides[x] - sides[y]) <= WINDOW).sum(axis=1) >= lines.least
            x, y = x[many], y[many]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[near], y[near]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            left.append(x)
            right.append(y)
        start = stop
    x, y = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            break
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
    return links, label


def embedding_groups(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors link when their cosine in double precision reaches the threshold; those of different
    lengths never do. Null, empty or zero vectors and those with a null or non-finite component link with
    nothing. Equal vectors are one class before any comparison, so a vector with any number of
    copies costs one row; each copy counts the others as links. ``n_links`` counts distinct ids.
    Rows that repeat an id and its vector all get the same answer; an id with several vectors joins
    their components. A row without id links with nothing, its component is null and ``kept`` false.
    Extra columns are ignored, an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    largest = F.array_max(F.transform("v", F.abs))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & (largest > 0)
    # Scaled by the largest component, so that no square overflows or vanishes.
    scaled = F.transform("v", lambda x: x / largest)
    keyed = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), scaled)).withColumn(
        "class", F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))
    )
    classes = checkpointed(
        keyed.where("class is not null").select("vec_id", "class", "v").groupBy("class", "vec_id").agg(F.first("v").alias("v"))
        .groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    )
    lines = calibrated(classes.count(), threshold, recall)

    def to_cells(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for dim in set(pa.compute.list_value_length(t["v"]).to_pylist()):
                part = t.filter(pa.compute.equal(pa.compute.list_value_length(t["v"]), dim))
                cells = _cells(lines, _unit(part["v"]))
                yield pa.RecordBatch.from_arrays(
                    [part["class"].combine_chunks(), pa.array(cells.tolist(), pa.list_(pa.int64()))], ["class", "cells"]
                )

    placed = checkpointed(classes.select("class", "v").mapInArrow(to_cells, "class string, cells array<bigint>"))
    spread = placed.select("class", F.posexplode("cells").alias("t", "cell"))
    # The hot cells are cut in blocks, and each pair of blocks is a comparison of its own.
    sizes = spread.groupBy("t", "cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = spread.join(sizes, ["t", "cell"]).withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    )
    met = met.select("class", "t", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("class", "t", "cell", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = met.join(classes, "class").join(placed, "class")

    def compare(key, group):
        t, _, i, j, _ = (k.as_py() for k in key)
        ids = group["rep"].to_numpy()
        cells = np.array(group["cells"].to_pylist(), np.int64)
        links, label = _linked(
            lines, ids, group["copies"].to_numpy(), cells, _unit(group["v"]), group["block"].to_numpy(), i, j, t, threshold
        )
        some = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        return pa.table({"class": group["class"].take(pa.array(some)), "links": links[some], "a": ids[some], "b": ids[label[some]]})

    found = checkpointed(
        full.select("t", "cell", "i", "j", "class", "block", "rep", "copies", "cells", "v").groupBy("t", "cell", "i", "j", F.size("v"))
        .applyInArrow(compare, "class string, links bigint, a bigint, b bigint")
    )
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    copies = keyed.where("class is not null").select(F.col("vec_id").alias("a"), "class").join(classes.select("class", "rep"), "class")
    roots = components(found.select("a", "b").union(copies.where("a != rep").select("a", F.col("rep").alias("b"))))
    answers = classes.join(links, "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = keyed.select("vec_id", "class").join(answers, "class", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
