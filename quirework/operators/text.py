"""Ordered string aggregation of text streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.streams import spaced, with_previous


def _joined(parts):
    """Fold of ``(str, rel, spaced)`` in order: S adds a space if spaced, P a line end, H drops the last character, C nothing."""

    def step(acc, x):
        before = acc["out"]
        glue = (
            F.when(acc["rel"] == "S", F.when(x["spaced"], F.concat(before, F.lit(" "))).otherwise(before))
            .when(acc["rel"] == "P", F.concat(before, acc["end"]))
            .when(acc["rel"] == "H", F.substring(before, F.lit(1), F.length(before) - 1)).otherwise(before)
        )
        return F.struct(F.concat(glue, x["str"]).alias("out"), x["rel"].alias("rel"), acc["end"].alias("end"))

    return step


def concatenated(words: DataFrame, key: list[str], ignore_line_breaks: bool = False, stream: str = "doc_id", order: str = "pos") -> DataFrame:
    """``key, text``: each group's words in stream order with their relations applied.

    A group is a part of one stream. Where a group leaves words out, a plain
    space stands for them.
    """
    w = with_previous(words, key=stream, order=order).withColumn("spaced", F.coalesce(spaced(), F.lit(False)))
    jump = Window.partitionBy(*key).orderBy(order)
    w = w.withColumn("linked", F.col(order) - F.lag(order).over(jump) == 1)
    item = F.struct(F.col(order).alias("at"), "str", "rel", "spaced", F.coalesce("linked", F.lit(True)).alias("linked"))
    g = w.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("parts"))
    end = F.lit(" " if ignore_line_breaks else "\r\n")
    start = F.struct(F.lit("").alias("out"), F.lit("C").alias("rel"), end.alias("end"))
    fold = _joined("parts")

    def step(acc, x):
        plain = F.struct(F.concat(acc["out"], F.lit(" "), x["str"]).alias("out"), x["rel"].alias("rel"), acc["end"].alias("end"))
        return F.when(x["linked"], fold(acc, x)).otherwise(plain)

    return g.select(*key, F.aggregate("parts", start, step, lambda acc: acc["out"]).alias("text"))


def elided(words: DataFrame, key: list[str], most: int, stream: str = "doc_id", order: str = "pos") -> DataFrame:
    """``concatenated``, but texts of more than ``most`` words and characters are cut to the first and last words of
    about half the length each, with `` ... `` between."""
    by = Window.partitionBy(*key).orderBy(order)
    size = F.length("str") + 1
    w = words.withColumns({
        "n": F.count("*").over(Window.partitionBy(*key)), "chars": F.sum(size).over(Window.partitionBy(*key)),
        "head": F.sum(size).over(by), "tail": F.sum(size).over(Window.partitionBy(*key).orderBy(F.col(order).desc())),
    })
    long_ = (F.col("n") > most) & (F.col("chars") > most)
    half = most // 2
    whole = concatenated(w.where(~long_), key, True, stream, order)
    heads = concatenated(w.where(long_ & (F.col("head") <= half)), key, True, stream, order).withColumnRenamed("text", "a")
    tails = concatenated(w.where(long_ & (F.col("tail") <= half)), key, True, stream, order).withColumnRenamed("text", "z")
    keys = w.where(long_).select(*key).distinct()
    cut = keys.join(heads, key, "left").join(tails, key, "left")
    cut = cut.select(*key, F.concat(F.coalesce("a", F.lit("")), F.lit(" ... "), F.coalesce("z", F.lit(""))).alias("text"))
    return whole.unionByName(cut)


def xml_of(words: DataFrame, key: list[str], element: str = "paragraph") -> DataFrame:
    """``key, xml``: a group's text as one escaped element."""
    from quirework.functions.text import xml_escape

    t = concatenated(words, key, True)
    return t.select(*key, F.concat(F.lit(f"<{element}>"), xml_escape(F.col("text")), F.lit(f"</{element}>")).alias("xml"))
