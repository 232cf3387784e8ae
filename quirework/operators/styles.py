"""Document styles: parameters and page-feature anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.geometry import Box, parse_box, point_in, scale, scale_box
from quirework.functions.text import all_caps
from quirework.operators.streams import line_bands

STYLE_DPI = 72


def parameters(lines: DataFrame, line: str = "value") -> DataFrame:
    """``key, value`` of ``key = value`` lines; comments and blank lines are skipped, the last of equal keys wins by value."""
    r = lines.where(F.col(line).contains("=") & ~F.trim(line).startswith("//"))
    r = r.select(F.trim(F.substring_index(line, "=", 1)).alias("key"), F.trim(F.expr(f"substring({line}, instr({line}, '=') + 1)")).alias("value"))
    return r.groupBy("key").agg(F.max("value").alias("value"))


def subset(params: DataFrame, prefix: str) -> DataFrame:
    return params.where(F.col("key").startswith(prefix + ".")).withColumn("key", F.substring("key", len(prefix) + 2, 1 << 20))


def int_parameter(value: Column, default: int, dpi: int | None = None) -> Column:
    v = F.coalesce(value.try_cast("double").cast("int"), F.lit(default))
    return v if dpi is None else scale(v, STYLE_DPI, dpi)


def box_parameter(value: Column, dpi: int) -> list[Column]:
    l, r, t, b = parse_box(value)
    x = scale_box(Box(l, r, t, b), STYLE_DPI, dpi)
    return [x.l.alias("l"), x.r.alias("r"), x.t.alias("t"), x.b.alias("b")]


def anchor_matches(words: DataFrame, area: tuple[int, int, int, int], pattern: str, dpi: int, least_size: int = 0, most_size: int = 72, bold: bool | None = None, capitals: bool = False, last_page: int = 0) -> DataFrame:
    """``doc_id, matches``: whether on one of a document's first pages the words in an area, in reading order and joined
    without separators, match a pattern as a whole.

    The area is given at 72 dpi as left, right, top, bottom.
    """
    x = Box(*[F.lit((v * dpi + STYLE_DPI // 2) // STYLE_DPI) for v in area])
    w = words.where((F.col("page_id") <= last_page) & point_in(F.col("cx"), F.col("cy"), x) & F.col("font_size").between(least_size, most_size))
    if bold is not None:
        w = w.where(F.col("bold") == bold)
    if capitals:
        w = w.where(all_caps(F.col("str")))
    placed = w.join(line_bands(w).select("doc_id", "page_id", "pos", "place"), ["doc_id", "page_id", "pos"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "str"))), lambda s: s["str"]), "")
    pages = placed.groupBy("doc_id", "page_id").agg(text.alias("text"))
    return pages.groupBy("doc_id").agg(F.bool_or(F.col("text").rlike(f"^(?:{pattern})$")).alias("matches"))
