"""Crop rectangles and rotations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crop_valid(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """0 <= left < right <= 1 and the same down; all absent is valid, some not."""
    sides = (left, top, right, bottom)
    none = F.lit(True)
    every = F.lit(True)
    for s in sides:
        none &= s.isNull()
        every &= s.isNotNull()
    inside = (left >= 0) & (left < right) & (right <= 1) & (top >= 0) & (top < bottom) & (bottom <= 1)
    return none | (every & F.coalesce(inside, F.lit(False)))


def crop_editable(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Also wide and high enough to handle."""
    return crop_valid(left, top, right, bottom) & (right - left > 0.02) & (bottom - top > 0.02)


def crop_pixels(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Struct of pixel edges: truncated, at least one pixel, inside the image."""
    def low(x: Column, n: Column) -> Column:
        return F.least((x * n).cast("int"), n - 1)

    def high(x: Column, n: Column, start: Column) -> Column:
        return F.least(n, F.greatest(start + 1, (x * n).cast("int")))

    l, t = low(left, width), low(top, height)
    return F.struct(l.alias("left"), t.alias("top"), high(right, width, l).alias("right"), high(bottom, height, t).alias("bottom"))


def unit(x: Column) -> Column:
    """Clamped to [0, 1]; missing and non-finite values are 0."""
    finite = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(0.0)


def compose_crop(outer_low: Column, outer_high: Column, inner_low: Column, inner_high: Column) -> tuple[Column, Column]:
    """An inner crop given relative to an outer one, to four decimals."""
    span = outer_high - outer_low
    return (
        F.floor((outer_low + span * unit(inner_low)) * 10000 + 0.5) / 10000,
        F.floor((outer_low + span * unit(inner_high)) * 10000 + 0.5) / 10000,
    )


def rotate(current: Column, clockwise: bool) -> Column:
    return ((current + (90 if clockwise else 270)) % 360).cast("int")


def rotated_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    turned = rotation.isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


# What a camera's orientation mark asks for, as quarter turns
# clockwise after a mirroring from left to right.
ORIENTATIONS = {1: (False, 0), 2: (True, 0), 3: (False, 2), 4: (True, 2), 5: (True, 3), 6: (False, 1), 7: (True, 1), 8: (False, 3)}


def turned(x: Column, y: Column, width: Column, height: Column, quarters: Column) -> tuple[Column, Column]:
    """Where a pixel comes to lie after quarter turns clockwise."""
    return (
        F.when(quarters == 1, height - 1 - y).when(quarters == 2, width - 1 - x).when(quarters == 3, y).otherwise(x),
        F.when(quarters == 1, x).when(quarters == 2, height - 1 - y).when(quarters == 3, width - 1 - x).otherwise(y),
    )


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once a row. A filter takes the
    whole expression of each plain column it names down to the table, as often
    as it names it; columns that rest on each other multiply, until a row costs
    more than a thousand of others."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def upright_pixels(pixels: DataFrame, sizes: DataFrame | None, key: list[str]) -> DataFrame:
    """Pixels (key, x, y, …) put upright: by the orientation mark, then turned
    by ``rotation`` degrees, then cut to the crop and moved to its corner.

    ``sizes``: key, width, height, orientation, rotation, crop_left, crop_top,
    crop_right, crop_bottom (null: no crop). Pixels of images without a size go.
    None: the pixels have these columns themselves.
    """
    size = ("width", "height", "orientation", "rotation", "crop_left", "crop_top", "crop_right", "crop_bottom")
    columns = [c for c in pixels.columns if sizes is not None or c not in size]
    joined = pixels if sizes is None else pixels.join(sizes, key)
    turns, mirror = F.lit(0), F.lit(False)
    for mark in sorted(ORIENTATIONS):
        flip, quarters = ORIENTATIONS[mark]
        if quarters:
            turns = F.when(F.col("orientation") == mark, quarters).otherwise(turns)
        if flip:
            mirror |= F.coalesce(F.col("orientation") == mark, F.lit(False))
    more = (F.col("rotation") / 90).cast("int")
    turns = (turns + F.when(more.isin(1, 2, 3), more).otherwise(0)) % 4
    marked = computed(joined, lm_mirror=mirror, lm_turns=turns)
    width, height, turns = F.col("width"), F.col("height"), F.col("lm_turns")
    x, y = turned(F.when(F.col("lm_mirror"), width - 1 - F.col("x")).otherwise(F.col("x")), F.col("y"), width, height, turns)
    w, h = rotated_size(width, height, turns * 90)
    placed = computed(marked, lm_x=x, lm_y=y, lm_w=w, lm_h=h)
    sides = [F.col(f"crop_{s}") for s in ("left", "top", "right", "bottom")]
    cut = computed(placed, lm_box=F.when(sides[0].isNotNull(), crop_pixels(*sides, F.col("lm_w"), F.col("lm_h"))))
    inside = F.col("lm_box").isNull() | (
        (F.col("lm_x") >= F.col("lm_box.left")) & (F.col("lm_x") < F.col("lm_box.right"))
        & (F.col("lm_y") >= F.col("lm_box.top")) & (F.col("lm_y") < F.col("lm_box.bottom"))
    )
    moved = {"x": F.col("lm_x") - F.coalesce("lm_box.left", F.lit(0)), "y": F.col("lm_y") - F.coalesce("lm_box.top", F.lit(0))}
    return cut.where(inside).withColumns(moved).select(*columns)


def move_crop(low: Column, high: Column, by: Column) -> tuple[Column, Column]:
    """Shift an extent within [0, 1], its size kept."""
    shift = F.least(1 - high, F.greatest(-low, by))
    return low + shift, high + shift


def resize_crop(low: Column, high: Column, by: Column, least: float = 0.02) -> Column:
    """Move the high edge, keeping a minimal extent."""
    return F.least(F.lit(1.0), F.greatest(low + least, high + by))


def unscale(y: Column, top: Column, scale: Column, padding: Column) -> Column:
    """A coordinate of an enlarged, padded cut-out, back in the full image."""
    return F.greatest(F.lit(0.0), top + y / scale - padding)
