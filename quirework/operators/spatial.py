"""Two-dimensional range joins and filters: words and regions against boxes of the same page.

Every join has the page as its equality key and the boxes as residual
predicate; with many boxes a page, ``binned_words_inside`` adds grid cells to
the key. No form needs a Cartesian product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.geometry import box, centre_in, contains, div, overlap_area, overlaps, point_in

PAGE = ("doc_id", "page_id")


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join by page; the right side's other columns come out with prefix ``o_``."""
    named = right.select(*[F.col(c).alias(c if c in PAGE else f"o_{c}") for c in right.columns])
    return left.join(named, list(PAGE))


def words_inside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre lies in a box of their page (right and bottom open); box columns get prefix ``o_``."""
    return _paired(words, boxes).where(point_in(F.col("cx"), F.col("cy"), box("o_")))


def binned_words_inside(words: DataFrame, boxes: DataFrame, cell: int = 200) -> DataFrame:
    """The same by grid cells: a box goes to the cells it meets, a word to the one cell of its centre."""
    w = words.withColumns({"gx": div(F.col("cx"), F.lit(cell)), "gy": div(F.col("cy"), F.lit(cell))})
    o = boxes.select(*[F.col(c).alias(c if c in PAGE else f"o_{c}") for c in boxes.columns])
    o = o.where("o_l < o_r and o_t < o_b")
    o = o.withColumn("gx", F.explode(F.sequence(div(F.col("o_l"), F.lit(cell)), div(F.col("o_r") - 1, F.lit(cell)))))
    o = o.withColumn("gy", F.explode(F.sequence(div(F.col("o_t"), F.lit(cell)), div(F.col("o_b") - 1, F.lit(cell)))))
    return w.join(o, [*PAGE, "gx", "gy"]).where(point_in(F.col("cx"), F.col("cy"), box("o_"))).drop("gx", "gy")


def words_outside_all(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words in no box of their page."""
    o = boxes.select(*[F.col(c).alias(f"o_{c}") for c in boxes.columns])
    on = [words[k] == o[f"o_{k}"] for k in PAGE] + [point_in(words["cx"], words["cy"], box("o_"))]
    return words.join(o, on, "left_anti")


def word_at(words: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (``x, y``) of a page the first word, in insertion order, whose box holds it."""
    hit = _paired(words, points).where(point_in(F.col("o_x"), F.col("o_y"), box()))
    first = Window.partitionBy(*PAGE, "o_x", "o_y").orderBy("pos")
    return hit.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def regions_inside(regions: DataFrame, boxes: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Regions contained in a box; fuzzy: regions whose centre lies in it. Words are not regions."""
    test = centre_in(box(), box("o_")) if fuzzy else contains(box("o_"), box())
    return _paired(regions, boxes).where(test)


def regions_including(regions: DataFrame, boxes: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Regions that contain a box; fuzzy: regions in which the box's centre lies. Largest first by ``rank``."""
    test = centre_in(box("o_"), box()) if fuzzy else contains(box(), box("o_"))
    hit = _paired(regions, boxes).where(test).withColumn("area", box().area)
    keys = [c for c in hit.columns if c.startswith("o_")]
    size = Window.partitionBy(*PAGE, *keys).orderBy(F.col("area").desc(), "type", "n")
    return hit.withColumn("rank", F.row_number().over(size))


def overlapping(items: DataFrame, boxes: DataFrame) -> DataFrame:
    return _paired(items, boxes).where(overlaps(box(), box("o_")))


def nesting(regions: DataFrame) -> DataFrame:
    """Each region with its parent: the smallest other region that contains it (``o_`` columns), if any."""
    pairs = _paired(regions, regions).where(contains(box("o_"), box()) & (box("o_").area > box().area))
    tight = Window.partitionBy(*PAGE, "type", "n").orderBy(box("o_").area, "o_type", "o_n")
    return pairs.withColumn("k", F.row_number().over(tight)).where("k = 1").drop("k")


def parent_block(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each word with the first block (by ``n``) that its centre lies in."""
    first = Window.partitionBy(*PAGE, "pos").orderBy("o_n")
    return words_inside(words, blocks).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def best_overlap(items: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """For each box the item of the same box, else the one of largest overlap squared over area (ties: larger area, then ``n``)."""
    own, other = box(), box("o_")
    same = (own.l == other.l) & (own.r == other.r) & (own.t == other.t) & (own.b == other.b)
    shared = overlap_area(own, other)
    pairs = _paired(items, boxes).where(overlaps(own, other))
    pairs = pairs.withColumns({"exact": same, "score": shared.cast("double") * shared / own.area, "area": own.area})
    best = Window.partitionBy(*PAGE, *key).orderBy(F.col("exact").desc(), F.col("score").desc(), F.col("area").desc(), "n")
    return pairs.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def ignoring(words: DataFrame, ignored: DataFrame, key: list[str]) -> DataFrame:
    return words.join(ignored.select(*key), key, "left_anti")


def adjust_contained(regions: DataFrame, band: DataFrame) -> DataFrame:
    """Cut regions vertically around a band (``l, r, t, b``) of their page: what lies inside it is dropped, what
    crosses an edge keeps the larger part outside, equal results are kept once."""
    joined = _paired(regions, band)
    own, cut = box(), box("o_")
    above, below = F.greatest(F.lit(0).cast("long"), cut.t - own.t), F.greatest(F.lit(0).cast("long"), own.b - cut.b)
    hit = overlaps(own, cut)
    out = joined.where(~hit | (above > 0) | (below > 0))
    keep_top = hit & (above >= below)
    keep_bottom = hit & (above < below)
    out = out.withColumn("new_t", F.when(keep_bottom, cut.b).otherwise(own.t)).withColumn("new_b", F.when(keep_top, cut.t).otherwise(own.b))
    return out.drop("t", "b").withColumnsRenamed({"new_t": "t", "new_b": "b"}).select(*regions.columns).distinct()
