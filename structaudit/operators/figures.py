"""Page elements to page texts, figures and drawing regions.

``elements(deck, page, pos, kind, group_id, x0, y0, x1, y1, weight, text, n_bytes, px_w, px_h,
content)``. Kinds: text, raster, line, curve, rect, shape, group, picture.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.functions import boxes as bx
from structaudit.functions.text import strip
from structaudit.operators.ranking import numbered


def page_text(elements: DataFrame) -> DataFrame:
    """Text of each page: its stripped, non-empty pieces, one row each; ``part`` is their order.

    The page's text is the parts in order with a line break between two; it stays in rows, so a page of any
    length is no single value. The miner takes ``part`` along.
    """
    text = strip(F.col("text"))
    return elements.where(text != "").select("deck", "page", F.col("pos").alias("part"), text.alias("text"))


def page_figures(pictures: DataFrame) -> DataFrame:
    """Distinct figures per page with the name each content got where it first appeared in the deck.

    ``pictures(deck, page, pos, n_bytes, px_w, px_h, content)``. The number in a name counts
    every picture of the page, copies included.
    """
    kept = pictures.where(bx.keep_image(F.col("n_bytes"), F.col("px_w"), F.col("px_h"))).select(
        "deck", "page", "pos", F.sha2("content", 256).alias("digest")
    )
    named = numbered(kept, ["deck", "page"], [F.asc("pos")], "number", [F.floor(F.col("pos") / 4096)])
    return (
        named.groupBy("deck", "digest", "page")
        .agg(F.min(F.struct("pos", "number")).alias("first"))
        .select("deck", "digest", "page", "first.pos", "first.number")
    )


def figures(on_pages: DataFrame) -> DataFrame:
    """One row per deck and content: name, first place and number of pages.

    The pages themselves stay rows of :func:`page_figures`: a logo may be on every page, and its
    pages would not fit in one row.
    """
    return (
        on_pages.groupBy("deck", "digest")
        .agg(F.min(F.struct("page", "pos", "number")).alias("first"), F.count("*").alias("n_pages"))
        .select(
            "deck",
            "digest",
            F.format_string("s%03d_%02d", "first.page", "first.number").alias("name"),
            F.col("first.page").alias("first_page"),
            F.col("first.pos").alias("first_pos"),
            "n_pages",
        )
    )


def shape_regions(elements: DataFrame, min_shapes: int = bx.MIN_VECTOR_SHAPES) -> DataFrame:
    """Groups of at least ``min_shapes`` textless shapes, and their place.

    Grouped shapes use the box of their group (a ``group`` row); loose ones the union of theirs.
    """
    shape = (F.col("kind") == "shape") & (F.coalesce(strip(F.col("text")), F.lit("")) == "")
    loose = F.col("group_id").isNull()
    outline = F.col("kind") == "group"
    used = elements.where(shape | outline)
    edge = lambda agg, c: agg(F.when(F.when(loose, shape).otherwise(outline), F.col(c)))
    return (
        used.groupBy("deck", "page", "group_id")
        .agg(
            F.count_if(shape).alias("part_count"),
            *[edge(F.min, c).alias(c) for c in ("x0", "y0")],
            *[edge(F.max, c).alias(c) for c in ("x1", "y1")],
        )
        .where((F.col("part_count") >= min_shapes) & F.col("x0").isNotNull())
        .withColumn("grouped", F.col("group_id").isNotNull())
    )


def _merge_until_apart(edges: np.ndarray, weight: np.ndarray, gap: float, block: int = 1024):
    """Merge the boxes of one page until no two are within ``gap``.

    A round labels connected boxes with their smallest index and replaces them by their common
    box; the larger boxes may be near others, so rounds repeat until nothing merges.
    """
    while True:
        n = len(edges)
        label = np.arange(n)
        while True:
            low = label.copy()
            for start in range(0, n, block):
                b = edges[start : start + block, None, :]
                near = (
                    (b[..., 0] - gap <= edges[:, 2]) & (edges[:, 0] - gap <= b[..., 2])
                    & (b[..., 1] - gap <= edges[:, 3]) & (edges[:, 1] - gap <= b[..., 3])
                )
                low[start : start + block] = np.where(near, label, n).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = low
        kept, where = np.unique(label, return_inverse=True)
        if len(kept) == n:
            return edges, weight
        grown = edges[kept].copy()
        np.minimum.at(grown[:, :2], where, edges[:, :2])
        np.maximum.at(grown[:, 2:], where, edges[:, 2:])
        edges, weight = grown, np.bincount(where, weights=weight)


def _merge_pages(batches: Iterator[pd.DataFrame], gap: float) -> Iterator[pd.DataFrame]:
    """Merge page by page over rows that arrive sorted by page; the last page waits for the next batch."""
    keys, sides = ["deck", "page", "layer"], ["x0", "y0", "x1", "y1"]

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        edges, weight = rows[sides].to_numpy(dtype=float), rows["weight"].to_numpy(dtype=float)
        starts = np.flatnonzero(_page_starts(rows, keys))
        parts = [
            _merge_until_apart(edges[a:b], weight[a:b], gap) for a, b in zip(starts, [*starts[1:], len(rows)])
        ]
        heads = rows[keys].iloc[np.repeat(starts, [len(w) for _, w in parts])].reset_index(drop=True)
        heads[sides] = np.concatenate([e for e, _ in parts])
        return heads.assign(weight=np.concatenate([w for _, w in parts]).astype("int64"))

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(rows) == 0:
            continue
        last = int(np.flatnonzero(_page_starts(rows, keys))[-1])
        held = rows.iloc[last:].reset_index(drop=True)
        if last:
            yield merged(rows.iloc[:last].reset_index(drop=True))
    if held is not None and len(held):
        yield merged(held)


def _page_starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    ids = rows[keys]
    return (ids != ids.shift()).any(axis=1).to_numpy()


def cluster_boxes(boxes: DataFrame, gap: float = bx.CLUSTER_GAP) -> DataFrame:
    """Merge boxes of a (deck, page, layer) within ``gap``; a merged box grows, weights add up.

    A box that grows only comes closer to others, so the result does not depend on the order of
    the merges. Hence boxes whose corners share a cell of side ``gap``, which are near by
    construction, are merged first by a plain aggregate. That leaves one box per cell: what a
    task sees of a page is bounded by the page's area, not by its number of strokes.
    """
    cells = (
        boxes.groupBy("deck", "page", "layer", F.floor(F.col("x0") / gap).alias("cx"), F.floor(F.col("y0") / gap).alias("cy"))
        .agg(
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
            F.sum("weight").cast("bigint").alias("weight"),
        )
        .drop("cx", "cy")
    )
    keys = ["deck", "page", "layer"]
    ordered = cells.repartition(*keys).sortWithinPartitions(*keys)
    columns = [*keys, "x0", "y0", "x1", "y1", "weight"]
    schema = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in columns)
    return ordered.select(*columns).mapInPandas(lambda batches: _merge_pages(batches, gap), schema)


def cluster_regions(
    elements: DataFrame,
    gap: float = bx.CLUSTER_GAP,
    min_side: float = bx.MIN_REGION_SIDE,
    min_points: int = bx.MIN_VECTOR_POINTS,
) -> DataFrame:
    """Drawing regions per page, numbered in the order of their boxes.

    One raster is a picture; vectors need ``min_points`` corners together. Rectangles are
    outlines and count for nothing.
    """
    layer = F.when(F.col("kind") == "raster", "raster").when(F.col("kind").isin("line", "curve"), "vector")
    points = F.when(F.col("kind") == "raster", 1).when(F.col("kind") == "line", 2).otherwise(F.col("weight"))
    drawn = elements.withColumn("layer", layer).withColumn("weight", points).where("layer is not null")
    grown = cluster_boxes(drawn, gap)
    side = F.struct("x0", "y0", "x1", "y1")
    kept = grown.where(bx.big_enough(side, min_side) & ((F.col("layer") == "raster") | (F.col("weight") >= min_points)))
    order = [F.asc(c) for c in ("x0", "y0", "x1", "y1", "layer")]
    # Regions of a layer are 40 points wide and 12 apart, so a page holds a few hundred at most.
    return numbered(kept, ["deck", "page"], order, "region_no")


def near_boxes(boxes: DataFrame, gap: float = bx.CLUSTER_GAP, cell: float = 64.0) -> DataFrame:
    """For every box of a (deck, page): how many others are near, and the nearest of them.

    ``boxes(deck, page, box_id, x0, y0, x1, y1)``. Near as in :func:`structaudit.functions.boxes.is_near`; the nearest
    has the smallest gap (``distance``, zero where boxes overlap), then the smallest id. Boxes of one place are merged
    first and count as often as they occur. A box enters every cell of a grid that it touches once it has grown by half
    the gap; two boxes are met in the one cell that holds the upper left corner of what they share, so no pair comes
    twice. Pairs are folded into counts as they are met. Boxes without a side of their own stay points.
    """
    page, sides = ["deck", "page"], ["x0", "y0", "x1", "y1"]
    ids = boxes.select(*page, "box_id", *[F.col(c).cast("double").alias(c) for c in sides])
    places = ids.groupBy(*page, *sides).agg(F.count("*").alias("n"), F.min("box_id").alias("low"))
    half = gap / 2

    def cells(low: str, high: str, name: str) -> Column:
        ends = F.floor((F.col(low) - half) / cell), F.floor((F.col(high) + half) / cell)
        return F.explode(F.sequence(*ends)).alias(name)

    grid = places.select("*", cells("x0", "x1", "cx")).select("*", cells("y0", "y1", "cy"))
    other = grid.select(*page, "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in (*sides, "n", "low")])
    corner = [F.floor((F.greatest(f"{c}0", f"o_{c}0") - half) / cell) == F.col(f"c{c}") for c in ("x", "y")]
    mine, theirs = F.struct(*sides), F.struct(*[F.col(f"o_{c}").alias(c) for c in sides])
    met = grid.join(other, [*page, "cx", "cy"]).where(corner[0] & corner[1] & bx.is_near(mine, theirs, gap) & (mine != theirs))
    apart = [F.greatest(F.lit(0.0), F.col(f"o_{c}0") - F.col(f"{c}1"), F.col(f"{c}0") - F.col(f"o_{c}1")) for c in ("x", "y")]
    distance = F.sqrt(apart[0] * apart[0] + apart[1] * apart[1])
    found = met.groupBy(*page, *sides).agg(F.sum("o_n").alias("n_other"), F.min(F.struct(distance.alias("distance"), F.col("o_low").alias("id"))).alias("best"))
    # Of several boxes in one place each has the others at distance zero: the lowest id, or for that one the next.
    second = ids.join(places.where("n > 1"), [*page, *sides]).where("box_id > low").groupBy(*page, *sides).agg(F.min("box_id").alias("next"))
    told = places.join(found, [*page, *sides], "left").join(second, [*page, *sides], "left")
    same = F.when(F.col("n") > 1, F.struct(F.lit(0.0).alias("distance"), F.when(F.col("box_id") == F.col("low"), F.col("next")).otherwise(F.col("low")).alias("id")))
    nearest = F.least(same, F.col("best"))
    return ids.join(told, [*page, *sides]).select(
        *page, "box_id", (F.coalesce("n_other", F.lit(0)) + F.col("n") - 1).alias("n_near"), nearest["id"].alias("nearest"), nearest["distance"].alias("distance"),
    )
