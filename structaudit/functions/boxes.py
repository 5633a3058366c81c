"""Boxes on a page, and which pictures are worth keeping. A box is a struct (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in points, bytes and pixels.
CLUSTER_GAP = 12.0
MIN_REGION_SIDE = 40.0
REGION_PAD = 6.0
MIN_VECTOR_POINTS = 6
MIN_VECTOR_SHAPES = 6
MIN_IMAGE_BYTES = 4096
MIN_IMAGE_SIDE = 80


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def merged(a: Column, b: Column) -> Column:
    return box(
        F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])
    )


def is_near(a: Column, b: Column, gap: float = CLUSTER_GAP) -> Column:
    """Overlapping, or at most ``gap`` apart on both axes."""
    return (
        (a["x0"] - gap <= b["x1"]) & (b["x0"] - gap <= a["x1"]) & (a["y0"] - gap <= b["y1"]) & (b["y0"] - gap <= a["y1"])
    )


def big_enough(a: Column, side: float = MIN_REGION_SIDE) -> Column:
    return (a["x1"] - a["x0"] >= side) & (a["y1"] - a["y0"] >= side)


def padded(a: Column, width: Column, height: Column, pad: float = REGION_PAD) -> Column:
    """The box with a margin, kept on the page; NULL when nothing of it is on the page."""
    zero = F.lit(0.0)
    out = box(
        F.greatest(zero, a["x0"] - pad),
        F.greatest(zero, a["y0"] - pad),
        F.least(width, a["x1"] + pad),
        F.least(height, a["y1"] + pad),
    )
    return F.when((out["x1"] > out["x0"]) & (out["y1"] > out["y0"]), out)


def fraction_to_points(a: Column, width: Column, height: Column) -> Column:
    """Fractions counted from the top left to points counted from the bottom left."""
    return box(a["x0"] * width, (1.0 - a["y1"]) * height, a["x1"] * width, (1.0 - a["y0"]) * height)


def extent_to_fraction(left, top, size_x, size_y, width, height) -> Column:
    """Position and size in any unit to fractions of the slide; NULL for a slide without size."""
    fits = (width > 0) & (height > 0)
    return F.when(fits, box(left / width, top / height, (left + size_x) / width, (top + size_y) / height))


def keep_image(n_bytes: Column, width: Column, height: Column) -> Column:
    """Too few bytes or too few pixels is an icon; unknown pixels are kept."""
    return (n_bytes >= MIN_IMAGE_BYTES) & F.coalesce(F.least(width, height) >= MIN_IMAGE_SIDE, F.lit(True))


def content_name(stem: Column, content: Column) -> Column:
    """File name from the ASCII part of a stem and a content hash: same content, same name."""
    ascii_part = F.substring(F.regexp_replace(stem, "[^A-Za-z0-9_-]+", ""), 1, 32)
    base = F.when(ascii_part == "", "image").otherwise(ascii_part)
    return F.concat(base, F.lit("-"), F.substring(F.sha1(content), 1, 10), F.lit(".png"))


def image_label(stem: Column) -> Column:
    """(model, compound, crop) from ``<model>__<compound>[__crop]``."""
    crop = stem.endswith("__crop")
    core = F.when(crop, F.substr(stem, F.lit(1), F.length(stem) - 6)).otherwise(stem)
    model = F.substring_index(core, "__", 1)
    compound = F.substr(core, F.length(model) + 3)
    return F.struct(
        model.alias("model"), F.replace(compound, F.lit("_"), F.lit(" ")).alias("compound"), crop.alias("crop")
    )
