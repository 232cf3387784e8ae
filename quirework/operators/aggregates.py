"""Grouped aggregations over layout objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.geometry import aggregate_box, box, div

RENDERED_PAGES = 65536
OCR, VECTORISED_OCR, DIGITISED_OCR, BORN_DIGITAL = 0, 1, 2, 3


def boxes(items: DataFrame, key: list[str]) -> DataFrame:
    return items.groupBy(*key).agg(*aggregate_box(box()))


def span_boxes(words: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """Enclosing boxes of word spans; null where a word starts left of its predecessor (the span wraps a line)."""
    w = words.withColumn("__back", F.col("l") < F.lag("l").over(Window.partitionBy(*key).orderBy(order)))
    g = w.groupBy(*key).agg(F.coalesce(F.bool_or("__back"), F.lit(False)).alias("__wraps"), *aggregate_box(box()))
    return g.select(*key, *[F.when(~F.col("__wraps"), F.col(c)).alias(c) for c in "lrtb"])


def counts(items: DataFrame, key: list[str]) -> DataFrame:
    return items.groupBy(*key).agg(F.count("*").alias("n"))


def distinct_values(items: DataFrame, key: list[str], column: str) -> DataFrame:
    return items.groupBy(*key).agg(F.sort_array(F.collect_set(column)).alias("values"))


def severity_levels(errors: DataFrame) -> DataFrame:
    """Error counts by severity, by category and severity, and by category, type and severity (``level`` 1 to 3)."""
    return errors.groupingSets(
        [["severity"], ["category", "severity"], ["category", "type", "severity"]], "category", "type", "severity"
    ).agg(F.count("*").alias("n"), (F.lit(3) - (F.grouping("category") + F.grouping("type"))).cast("long").alias("level"))


def document_origin(pages: DataFrame) -> DataFrame:
    """Origin flags of documents from per-page counts ``has_scan, words, font_words, vector_words``.

    Pages are rendered if fewer than two thirds are scans. Text is OCR if fewer
    than two thirds of the words use fonts, vectorised OCR if more than two
    thirds of those fonts are vectorised, else born digital or, over scans,
    digitised OCR.
    """
    s = lambda c: F.sum(F.col(c).cast("long"))
    g = pages.groupBy("doc_id").agg(F.count("*").alias("page"), s("has_scan").alias("scan"), s("words").alias("word"), s("font_words").alias("font"), s("vector_words").alias("vector"))
    few = F.col("scan") * 3 < F.col("page") * 2
    text = (
        F.when(F.col("font") * 3 < F.col("word") * 2, OCR).when(F.col("font") * 2 < F.col("vector") * 3, VECTORISED_OCR)
        .when(few, BORN_DIGITAL).otherwise(DIGITISED_OCR)
    )
    return g.select("doc_id", (F.when(few, RENDERED_PAGES).otherwise(0) + text).cast("long").alias("origin"))


def is_born_digital(origin: Column) -> Column:
    return origin.bitwiseAND(F.lit(RENDERED_PAGES)) != 0


def most_frequent(items: DataFrame, key: list[str], column: str, default: str) -> DataFrame:
    """Most frequent value (null counts as the default); ties to the smallest."""
    c = items.withColumn("__v", F.coalesce(F.col(column), F.lit(default))).groupBy(*key, "__v").count()
    best = Window.partitionBy(*key).orderBy(F.col("count").desc(), "__v")
    return c.withColumn("__k", F.row_number().over(best)).where("__k = 1").select(*key, F.col("__v").alias(column), F.col("count").alias("n"))


def majority_direction(words: DataFrame, key: list[str]) -> DataFrame:
    """The direction with more words than each other, else ``lr``."""
    n = {d: F.count_if(F.col("direction") == d) for d in ("bu", "td", "ud")}
    lr = F.count_if(F.coalesce("direction", F.lit("lr")) == "lr")
    g = words.groupBy(*key).agg(lr.alias("n_lr"), *[c.alias(f"n_{d}") for d, c in n.items()])
    out = F.lit("lr")
    for d in ("bu", "td", "ud"):
        others = [F.col(f"n_{o}") for o in ("lr", "bu", "td", "ud") if o != d]
        out = F.when(F.col(f"n_{d}") > F.greatest(*others), d).otherwise(out)
    return g.select(*key, out.alias("direction"))


def header_flags(cells: DataFrame, key: list[str], axis: str, other: str) -> DataFrame:
    """Leading columns (or rows) of which more than half the cells are headers: ``axis, is_label``."""
    g = cells.groupBy(*key, axis).agg((F.count_if("is_header") * 2 > F.count(other)).alias("most"))
    lead = Window.partitionBy(*key).orderBy(axis)
    return g.select(*key, axis, F.min("most").over(lead).alias("is_label"))


def rounded_mean(column: str) -> Column:
    """Mean as a whole number, halves up."""
    return div(F.sum(column) + div(F.count(column), F.lit(2)), F.count(column))


def tall_label(cells: DataFrame, key: list[str]) -> DataFrame:
    """Whether label cells take more than half of the merged width."""
    width = F.col("r") - F.col("l")
    return cells.groupBy(*key).agg((F.sum(F.when(F.col("is_header"), width).otherwise(0)) * 2 > F.sum(width)).alias("is_label"))
