"""A deterministic page layout of the ``documents`` table: words, regions and annotations.

Words are white-space tokens, ten on a line, forty lines on a page. Everything
is computed row by row from the token's position, so the tables can be derived
on any number of executors without an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.geometry import aggregate_box, box, div

DPI = 100


def _n(x) -> Column:
    return x.cast("long")


def _dealt(docs: DataFrame) -> DataFrame:
    """Texts of fewer scan tasks than cores dealt to all cores; larger tables are read where they lie."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    # by a hash of the id: a partitioning by the id itself would be taken for that of joins and unions further on
    return docs.repartition(cores, F.xxhash64("doc_id")) if docs.rdd.getNumPartitions() < cores else docs


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page_id, pos, line, col, l, r, t, b, cx, cy, str, rel, direction, font_size, bold``."""
    tokens = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    w = _dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.posexplode(tokens).alias("i", "str"))
    i = F.col("i").cast("long")
    on_page = i % 400
    w = w.select(
        "doc_id", div(i, F.lit(400)).alias("page_id"), i.alias("pos"), div(on_page, F.lit(10)).alias("line"), (i % 10).alias("col"), "str"
    )
    left, top = 100 + 100 * F.col("col"), 100 + 30 * F.col("line")
    right = left + F.least(8 * F.length("str"), F.lit(90))
    return w.withColumns({
        "l": _n(left), "r": _n(right), "t": _n(top), "b": _n(top + 20),
        "cx": _n(div(left + right, F.lit(2))), "cy": _n(top + 10),
        "rel": F.when(F.col("str").endswith("."), "P").when(F.col("str").endswith("-"), "H").otherwise("S"),
        "direction": F.when(F.col("pos") % 11 == 0, "td").otherwise("lr"),
        "font_size": _n(8 + F.col("line") % 5), "bold": F.length("str") % 7 == 0,
    })


def lines(w: DataFrame) -> DataFrame:
    return w.groupBy("doc_id", "page_id", F.col("line").alias("n")).agg(*aggregate_box(box())).withColumn("type", F.lit("line"))


def blocks(w: DataFrame) -> DataFrame:
    n = div(F.col("line"), F.lit(10)).alias("n")
    return w.groupBy("doc_id", "page_id", n).agg(*aggregate_box(box())).withColumn("type", F.lit("block"))


def regions(w: DataFrame) -> DataFrame:
    """``doc_id, page_id, n, l, r, t, b, type``: a line region per line, a block region per ten lines."""
    return lines(w).unionByName(blocks(w))


def tables(w: DataFrame) -> DataFrame:
    """Words of each page's table (lines 10 to 19), with ``table_id`` = page."""
    return w.where(F.col("line").between(10, 19))


def annotations(w: DataFrame) -> DataFrame:
    """``doc_id, ann_id, type, first_pos, last_pos, first_page, last_page, create_no``: every 7th word spans 5 words
    as an entity, every 13th spans 20 as a passage; spans end with the document."""
    last = w.groupBy("doc_id").agg(F.max("pos").alias("end"))
    of = lambda step, size, name: w.where(F.col("pos") % step == 0).select(
        "doc_id", F.lit(name).alias("type"), F.col("pos").alias("first_pos"), (F.col("pos") + size - 1).alias("last_pos")
    )
    a = of(7, 5, "entity").unionByName(of(13, 20, "passage")).join(last, "doc_id")
    a = a.withColumn("last_pos", F.least("last_pos", "end")).drop("end")
    return a.withColumns({
        "first_page": div(F.col("first_pos"), F.lit(400)), "last_page": div(F.col("last_pos"), F.lit(400)),
        "create_no": F.col("first_pos") * 2 + (F.col("type") == "passage").cast("long"),
        "ann_id": F.concat("type", F.lit(":"), "first_pos", F.lit("-"), "last_pos"),
    })
