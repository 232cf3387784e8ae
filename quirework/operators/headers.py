"""Header words of connected tables: fuzzy matching, splits at relative places, reading order of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.geometry import Box, box, contains, overlap_area

TABLE = ["doc_id", "table_id"]


def _close(a: Box, b: Box):
    """Boxes that contain one another or share more than nine tenths of the smaller."""
    return contains(a, b) | contains(b, a) | (overlap_area(a, b) * 10 > F.least(a.area, b.area) * 9)


def matches(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id, table_id, other_id, matches`` for pairs of tables by their header words (``str`` and a box relative to
    the table's).

    Word numbers must be within 20 %. Headers match if all words of both find an equal word (letter case ignored) at a
    close place; else if nine tenths of each side's words find a word there and the characters of equal words outweigh
    those of others by more than 4.5 to 1.
    """
    a = words.select(*TABLE, F.monotonically_increasing_id().alias("a_no"), F.lower("str").alias("a"), *[F.col(c) for c in "lrtb"])
    b = words.select(
        "doc_id", F.col("table_id").alias("other_id"), F.monotonically_increasing_id().alias("b_no"), F.lower("str").alias("z"), *[F.col(c).alias(f"o_{c}") for c in "lrtb"]
    )
    n = words.groupBy(*TABLE).agg(F.count("*").alias("n"), F.sum(F.length("str")).alias("chars"))
    j = pairs.join(a, TABLE).join(b, ["doc_id", "other_id"]).where(_close(box(), box("o_")))
    keys = ["doc_id", "table_id", "other_id"]
    g = j.groupBy(*keys).agg(
        F.count_distinct("a_no").alias("met_a"), F.count_distinct("b_no").alias("met_b"),
        F.count_distinct(F.when(F.col("a") == F.col("z"), F.col("a_no"))).alias("same_a"), F.count_distinct(F.when(F.col("a") == F.col("z"), F.col("b_no"))).alias("same_b"),
        F.sum(F.when(F.col("a") == F.col("z"), F.length("a") * 2).otherwise(0)).alias("same_chars"),
    )
    na = n.withColumnsRenamed({"n": "n_a", "chars": "c_a"})
    nb = n.select("doc_id", F.col("table_id").alias("other_id"), F.col("n").alias("n_b"), F.col("chars").alias("c_b"))
    r = pairs.join(na, TABLE, "left").join(nb, ["doc_id", "other_id"], "left").join(g, keys, "left").na.fill(0)
    sizes = F.abs(F.col("n_a") - F.col("n_b")) * 5 <= F.greatest("n_a", "n_b")
    all_same = (F.col("same_a") == F.col("n_a")) & (F.col("same_b") == F.col("n_b"))
    most_met = (F.col("met_a") * 10 >= F.col("n_a") * 9) & (F.col("met_b") * 10 >= F.col("n_b") * 9)
    outweigh = (F.col("c_a") + F.col("c_b") - F.col("same_chars")) * 9 < F.col("same_chars") * 2
    return r.select(*keys, (sizes & (all_same | most_met & outweigh) & (F.col("n_a") > 0)).alias("matches"))


def split_relative(bands: DataFrame, extents: DataFrame, model: str | int, splits: DataFrame) -> DataFrame:
    """Bands of all tables of a document cut where the model table's bands were split, at the same relative places.

    splits: ``doc_id, at`` in the model's own coordinates.
    """
    e = extents.select(*TABLE, F.col("low").alias("e_low"), F.col("high").alias("e_high"))
    m = e.where(F.col("table_id") == model).select("doc_id", F.col("e_low").alias("m_low"), F.col("e_high").alias("m_high"))
    at = splits.join(m, "doc_id").select("doc_id", ((F.col("at") - F.col("m_low")) / (F.col("m_high") - F.col("m_low"))).alias("p"))
    own = e.join(at, "doc_id").select(*TABLE, F.round(F.col("e_low") + F.col("p") * (F.col("e_high") - F.col("e_low"))).cast("long").alias("at"))
    cuts = bands.join(own, TABLE).where("low < at and at < high").groupBy(*TABLE, "n").agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    edges = F.concat(F.array("low"), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array("high"))
    j = bands.join(cuts, [*TABLE, "n"], "left").withColumn("edges", edges)
    parts = j.select(*TABLE, F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("k", "a"), "edges")
    parts = parts.select(*TABLE, F.col("a").alias("low"), F.get("edges", F.col("k") + 1).alias("high"))
    w = Window.partitionBy(*TABLE).orderBy("low")
    return parts.select(*TABLE, (F.row_number().over(w) - 1).cast("long").alias("n"), "low", "high")


def copy_markers(cells: DataFrame, model: DataFrame) -> DataFrame:
    """Header markers of the model table's places set on the same places of the others."""
    m = model.select("doc_id", "row", "col", F.col("marked").alias("m"))
    return cells.drop("marked").join(m, ["doc_id", "row", "col"], "left").withColumn("marked", F.coalesce("m", F.lit(False))).drop("m")


def axes(direction: str) -> tuple[list, list]:
    """Sort keys of rows and of columns of a cell matrix for a text direction."""
    c = F.col
    return {
        "lr": ([c("t"), c("b")], [c("l"), c("r")]), "ud": ([c("b").desc(), c("t").desc()], [c("r").desc(), c("l").desc()]),
        "bu": ([c("l"), c("r")], [c("b").desc(), c("t").desc()]), "td": ([c("r").desc(), c("l").desc()], [c("t"), c("b")]),
    }[direction]


def word_order(words_in_cells: DataFrame, directions: DataFrame | None = None, key: list[str] = TABLE) -> DataFrame:
    """``place`` of table words: cells row by row, in a cell by its majority direction; a merged cell's words count once.

    Paragraph ends within a cell become plain separations; a cell's last word ends a paragraph.
    """
    w = words_in_cells
    if directions is not None:
        w = w.drop("direction").join(directions, [*key, "cell_id"], "left")
    d = F.coalesce("direction", F.lit("lr"))
    across = F.when(d == "bu", F.col("cx")).when(d == "td", -F.col("cx")).when(d == "ud", -F.col("cy")).otherwise(F.col("cy"))
    along = F.when(d == "bu", -F.col("cy")).when(d == "td", F.col("cy")).when(d == "ud", -F.col("cx")).otherwise(F.col("cx"))
    w = w.withColumns({"across": across, "along": along})
    order = Window.partitionBy(*key).orderBy("row", "col", "across", "along", "pos")
    last = F.lead("cell_id").over(order).isNull() | (F.lead("cell_id").over(order) != F.col("cell_id"))
    w = w.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    return w.withColumn("rel", F.when(last, "P").when(F.col("rel") == "P", "S").otherwise(F.col("rel"))).drop("across", "along")
