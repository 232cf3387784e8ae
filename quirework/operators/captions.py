"""Captions and their targets: geometry predicates and best-match joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.geometry import Box, box, contains, div
from quirework.operators.spatial import PAGE, best_overlap

TARGET_TYPES = ("table", "image", "graphics")


def _shared(a_low, a_high, b_low, b_high) -> Column:
    """Overlap of at least 80 % of the smaller extent, in whole numbers."""
    both = F.least(a_high, b_high) - F.greatest(a_low, b_low)
    return both * 5 >= F.least(a_high - a_low, b_high - b_low) * 4


def above(cap: Box, target: Box, dpi: int) -> Column:
    return (target.t >= div(cap.t + cap.b, F.lit(2))) & _shared(cap.l, cap.r, target.l, target.r) & (target.t - cap.b <= dpi)


def below(cap: Box, target: Box, dpi: int) -> Column:
    return (div(cap.t + cap.b, F.lit(2)) >= target.b) & _shared(cap.l, cap.r, target.l, target.r) & (cap.t - target.b <= dpi)


def beside(cap: Box, target: Box, dpi: int) -> Column:
    near = F.least(F.abs(target.l - cap.r), F.abs(cap.l - target.r)) <= dpi
    return _shared(cap.t, cap.b, target.t, target.b) & near


def type_fits(first_word: Column, target_type: Column) -> Column:
    """A caption beginning with "tab" goes with tables, any other with the rest."""
    return F.lower(first_word).startswith("tab") == (target_type == "table")


def find_captions(captions: DataFrame, targets: DataFrame, dpi: int, match_type: bool = True, exclude_inline: bool = True) -> DataFrame:
    """For each target the caption on each ``side``: above the last that qualifies from the top, below the first,
    beside the nearest (the later of equals), inside the last.

    captions: page keys, ``n``, box, ``first_word``, ``in_line``; targets: page
    keys, ``n``, box, ``type``. Target columns come out with prefix ``o_``.
    """
    t = targets.select(*[F.col(c).alias(c if c in PAGE else f"o_{c}") for c in targets.columns])
    c = captions.where(~F.coalesce("in_line", F.lit(False))) if exclude_inline else captions
    j = c.join(t, list(PAGE))
    if match_type:
        j = j.where(type_fits(F.col("first_word"), F.col("o_type")))
    cap, tar = box(), box("o_")
    sides = F.array_compact(F.array(
        F.when(above(cap, tar, dpi), "above"), F.when(below(cap, tar, dpi), "below"),
        F.when(beside(cap, tar, dpi), "beside"), F.when(contains(tar, cap), "inside"),
    ))
    j = j.withColumn("side", F.explode(sides))
    gap = F.least(F.abs(F.col("o_l") - F.col("r")), F.abs(F.col("l") - F.col("o_r")))
    place = F.when(F.col("side").isin("above", "inside"), -F.col("t")).when(F.col("side") == "below", F.col("t")).otherwise(gap)
    best = Window.partitionBy(*PAGE, "o_type", "o_n", "side").orderBy(place, F.col("t").desc(), F.col("n").desc())
    return j.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def caption_targets(captions: DataFrame, regions: DataFrame, types: tuple[str, ...] = TARGET_TYPES) -> DataFrame:
    """Regions that captions' target boxes (``target_l`` ...) mean: the same box, else the best overlap."""
    wanted = captions.select(*PAGE, F.col("n").alias("cap_n"), *[F.col(f"target_{c}").alias(c) for c in "lrtb"])
    return best_overlap(regions.where(F.col("type").isin(*types)), wanted, ["o_cap_n"])


def linked(captions: DataFrame, found: DataFrame) -> DataFrame:
    """Captions with the box and type of their targets as attributes."""
    t = found.select(*PAGE, "n", F.col("o_type").alias("target_type"), *[F.col(f"o_{c}").alias(f"target_{c}") for c in "lrtb"])
    return captions.join(t, [*PAGE, "n"], "left")
