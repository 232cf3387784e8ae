"""Table reconstruction: rows and columns from white space, cells, grids, edits, and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.geometry import Box, box, contains, div, overlaps, point_in
from quirework.functions.text import csv_cell, xml_escape
from quirework.operators.streams import gaps, number_streams, voted_gaps
from quirework.plans.scratch import written

TABLE = ["doc_id", "table_id"]
#: Height of the bands by which words meet cells: about a line.
BAND = 32


def bands(words: DataFrame, axis: str, least: int, key: list[str] = TABLE, least_count: int = -1, vote: bool = True) -> DataFrame:
    """Rows (axis y) or columns (axis x) of tables from the gaps between their words.

    ``key, n, low, high``: bands between kept gaps, numbered from 0. A table
    without words or gaps has none; a leading gap opens an empty band, which is
    dropped.
    """
    low, high = ("t", "b") if axis == "y" else ("l", "r")
    whole = Window.partitionBy(*key)
    origin, end = F.min(low).over(whole), F.max(high).over(whole)
    placed = words.select(*key, low, high, origin.alias("origin"), (end - origin).alias("extent"))
    shifted = placed.select(*key, "origin", "extent", (F.col(low) - F.col("origin")).alias("lo"), (F.col(high) - F.col("origin")).alias("hi"))
    # origin and extent are one value a table, so they can go along as keys; all steps need the words dealt once, by table
    each = [*key, "origin", "extent"]
    g = gaps(shifted, "lo", "hi", least, each)
    g = voted_gaps(g, each, least_count) if vote else g
    w = Window.partitionBy(*each).orderBy("gap_start")
    before = F.struct(F.coalesce(F.lag("gap_end").over(w), F.lit(0).cast("long")).alias("a"), F.col("gap_start").alias("z"))
    after = F.when(F.lead("gap_end").over(w).isNull(), F.struct(F.col("gap_end").alias("a"), F.col("extent").alias("z")))
    out = g.select(*key, "origin", before.alias("x"), after.alias("y")).select(*key, "origin", F.explode(F.array("x", "y")).alias("x"))
    out = out.where("x.a < x.z").select(*key, "origin", "x.*")
    number = Window.partitionBy(*key).orderBy("a")
    return out.select(
        *key, (F.row_number().over(number) - 1).cast("long").alias("n"), (F.col("a") + F.col("origin")).alias("low"), (F.col("z") + F.col("origin")).alias("high")
    )


def rows_of(words: DataFrame, dpi: int = 100, existing: DataFrame | None = None, key: list[str] = TABLE) -> DataFrame:
    return _with_existing(bands(words, "y", dpi // 50, key), existing, key)


def columns_of(words: DataFrame, dpi: int = 100, existing: DataFrame | None = None, key: list[str] = TABLE) -> DataFrame:
    return _with_existing(bands(words, "x", dpi // 30, key), existing, key)


def _with_existing(found: DataFrame, existing: DataFrame | None, key: list[str]) -> DataFrame:
    """Tables that have bands already keep them."""
    return found if existing is None else existing.unionByName(found.join(existing.select(*key).distinct(), key, "left_anti"))


def cells(rows: DataFrame, columns: DataFrame, existing: DataFrame | None = None, key: list[str] = TABLE) -> DataFrame:
    """``key, row, col, l, r, t, b, cell_id``: every crossing of a table's rows and columns.

    An existing cell of the very box is taken, else one that contains it, else a new one.
    """
    grid = rows.select(*key, F.col("n").alias("row"), F.col("low").alias("t"), F.col("high").alias("b")).join(
        columns.select(*key, F.col("n").alias("col"), F.col("low").alias("l"), F.col("high").alias("r")), key
    )
    new_id = F.concat_ws(",", *[F.col(c).cast("string") for c in "lrtb"])
    if existing is None:
        return grid.withColumn("cell_id", new_id)
    o = existing.select(*key, F.col("cell_id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in "lrtb"])
    j = grid.join(o, [grid[k] == o[k] for k in key] + [contains(box("o_"), Box(*[grid[c] for c in "lrtb"]))], "left").drop(*[o[k] for k in key])
    same = (F.col("o_l") == F.col("l")) & (F.col("o_r") == F.col("r")) & (F.col("o_t") == F.col("t")) & (F.col("o_b") == F.col("b"))
    pick = Window.partitionBy(*key, "row", "col").orderBy(F.coalesce(same, F.lit(False)).desc(), "o_t", "o_l", "o_id")
    j = j.withColumn("k", F.row_number().over(pick)).where("k = 1")
    take = lambda c: F.coalesce(f"o_{c}", c).alias(c)
    return j.select(*key, "row", "col", *[take(c) for c in "lrtb"], F.coalesce("o_id", new_id).alias("cell_id"))


def spurious(existing: DataFrame, used: DataFrame, key: list[str] = TABLE) -> DataFrame:
    return existing.join(used.select(*key, "cell_id"), [*key, "cell_id"], "left_anti")


def words_in_cells(words: DataFrame, cells_: DataFrame, key: list[str] = TABLE) -> DataFrame:
    """Each word with the cell its centre lies in; with overlapping cells the first by height, then place.

    Words meet the cells of their band of BAND units of height, not all cells of the table.
    """
    c = cells_.select(*key, "row", "col", "cell_id", *[F.col(x).alias(f"o_{x}") for x in "lrtb"])
    c = c.withColumn("band", F.explode(F.sequence(div(F.col("o_t"), F.lit(BAND)), div(F.col("o_b"), F.lit(BAND)))))
    w = words.drop("row", "col", "cell_id").withColumn("band", div(F.col("cy"), F.lit(BAND)))
    j = w.join(c, [*key, "band"]).drop("band").where(point_in(F.col("cx"), F.col("cy"), box("o_")))
    first = Window.partitionBy(*key, "pos").orderBy(F.col("o_t") + F.col("o_b"), F.col("o_l") + F.col("o_r"), "row", "col")
    return j.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def cell_texts(words: DataFrame, cells_: DataFrame, key: list[str] = TABLE) -> DataFrame:
    """``cells_`` with ``text``: words in stream order, a space between; merged cells repeat theirs in every place."""
    w = words_in_cells(words, cells_, key)
    t = w.groupBy(*key, "cell_id").agg(F.array_sort(F.collect_list(F.struct("pos", "str"))).alias("ws"))
    t = t.select(*key, "cell_id", F.array_join(F.transform("ws", lambda x: x["str"]), " ").alias("text"))
    return cells_.join(t, [*key, "cell_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def grid(cells_: DataFrame, key: list[str] = TABLE) -> DataFrame:
    """``row_span, col_span`` of each place's cell and whether the place ``opens`` it (is its top left)."""
    same = Window.partitionBy(*key, "cell_id")
    g = cells_.withColumns({"first_row": F.min("row").over(same), "first_col": F.min("col").over(same), "last_row": F.max("row").over(same), "last_col": F.max("col").over(same)})
    return g.withColumns({
        "row_span": F.col("last_row") - F.col("first_row") + 1, "col_span": F.col("last_col") - F.col("first_col") + 1,
        "opens": (F.col("row") == F.col("first_row")) & (F.col("col") == F.col("first_col")),
    }).drop("first_row", "first_col", "last_row", "last_col")


def separated(cells_: DataFrame, separator: str = ",", key: list[str] = TABLE) -> DataFrame:
    """``key, data``: one line a row, cells by column; merged cells repeat their text."""
    c = cells_.withColumn("out", csv_cell(F.col("text"), separator))
    rows = c.groupBy(*key, "row").agg(F.array_sort(F.collect_list(F.struct("col", "out"))).alias("cs"))
    rows = rows.select(*key, "row", F.array_join(F.transform("cs", lambda x: x["out"]), separator).alias("line"))
    t = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("ls"))
    return t.select(*key, F.array_join(F.transform("ls", lambda x: x["line"]), "\r\n").alias("data"))


def xml(cells_: DataFrame, header_rows: int = 1, key: list[str] = TABLE) -> DataFrame:
    """``key, data``: table element with spans; places that only repeat a merged cell are skipped."""
    g = grid(cells_, key).where("opens")
    tag = F.when(F.col("row") < header_rows, "th").otherwise("td")
    span = lambda n, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    out = F.concat(F.lit("<"), tag, span("colspan", "col_span"), span("rowspan", "row_span"), F.lit(">"), xml_escape(F.col("text")), F.lit("</"), tag, F.lit(">"))
    rows = g.withColumn("out", out).groupBy(*key, "row").agg(F.array_sort(F.collect_list(F.struct("col", "out"))).alias("cs"))
    rows = rows.select(*key, "row", F.concat(F.lit("<tr>"), F.array_join(F.transform("cs", lambda x: x["out"]), ""), F.lit("</tr>")).alias("line"))
    t = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("ls"))
    return t.select(*key, F.concat(F.lit("<table>"), F.array_join(F.transform("ls", lambda x: x["line"]), ""), F.lit("</table>")).alias("data"))


def labels(cells_: DataFrame, axis: str, key: list[str] = TABLE) -> DataFrame:
    """Row labels (axis row: first cell of each row) or column headers (axis col): ``key, labels`` by place."""
    other = "col" if axis == "row" else "row"
    first = cells_.groupBy(*key, axis).agg(F.min_by("text", other).alias("label"))
    g = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(axis, "label"))).alias("ls"))
    return g.select(*key, F.transform("ls", lambda x: x["label"]).alias("labels"))


def compatible(labels_: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs ``table_id, other_id`` of one document whose label lists agree in length and from the second label on."""
    a = labels_.select("doc_id", "table_id", F.col("labels").alias("a"))
    b = labels_.select("doc_id", F.col("table_id").alias("other_id"), F.col("labels").alias("z"))
    j = pairs.join(a, ["doc_id", "table_id"]).join(b, ["doc_id", "other_id"])
    tail = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    return j.where((F.size("a") == F.size("z")) & (tail(F.col("a")) == tail(F.col("z")))).select("doc_id", "table_id", "other_id")


def connected(links: DataFrame) -> DataFrame:
    """``doc_id, table_id, chain, place``: tables linked by ``next_id``, named after the first of their chain.

    A cycle is broken before its smallest table. Of several tables with one
    successor the smallest counts as its predecessor; the others end chains.
    """
    node = lambda c: F.struct("doc_id", F.col(c).alias("table_id"))
    before = links.where("next_id is not null").groupBy(node("next_id").alias("word_id")).agg(F.min(node("table_id")).alias("prev_id"))
    nodes = links.select(node("table_id").alias("word_id")).distinct().join(before, "word_id", "left")
    placed = number_streams(nodes).select(
        F.col("word_id.doc_id").alias("doc_id"), F.col("word_id.table_id").alias("table_id"), F.col("stream_id.table_id").alias("chain"), F.col("stream_pos").alias("place")
    )
    placed = written(placed, "chains")
    left = links.join(placed.select("doc_id", "table_id"), ["doc_id", "table_id"], "left_anti")
    if left.isEmpty():
        return placed
    least = left.groupBy("doc_id").agg(F.min("table_id").alias("m"))
    broken = left.join(least, "doc_id").withColumn("next_id", F.when(F.col("next_id") != F.col("m"), F.col("next_id"))).drop("m")
    return placed.unionByName(connected(written(broken, "broken")))


def matching_bands(bands_: DataFrame, extents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bands of connected tables that correspond: the candidate's relative centre lies strictly within the reference's
    relative span, and exactly one candidate of the other table does."""
    e = extents.select("doc_id", "table_id", "low", "high").withColumnsRenamed({"low": "e_low", "high": "e_high"})
    rel = bands_.join(e, ["doc_id", "table_id"]).withColumns({
        "p": (F.col("low") - F.col("e_low")).cast("double") / (F.col("e_high") - F.col("e_low")),
        "q": (F.col("high") - F.col("e_low")).cast("double") / (F.col("e_high") - F.col("e_low")),
    }).select("doc_id", "table_id", "n", "p", "q")
    other = rel.select("doc_id", F.col("table_id").alias("other_id"), F.col("n").alias("other_n"), ((F.col("p") + F.col("q")) / 2).alias("c"))
    j = pairs.join(rel, ["doc_id", "table_id"]).join(other, ["doc_id", "other_id"]).where("p < c and c < q")
    one = Window.partitionBy("doc_id", "table_id", "n", "other_id")
    return j.withColumn("k", F.count("*").over(one)).where("k = 1").select("doc_id", "table_id", "n", "other_id", "other_n")


def by_position(bands_: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bands of tables with equally many bands, matched by number."""
    size = bands_.groupBy("doc_id", "table_id").agg(F.count("*").alias("k"))
    a = bands_.join(size, ["doc_id", "table_id"])
    b = a.select("doc_id", F.col("table_id").alias("other_id"), "n", "k")
    return pairs.join(a.select("doc_id", "table_id", "n", "k"), ["doc_id", "table_id"]).join(b, ["doc_id", "other_id", "n", "k"]).drop("k")


def merge_bands(bands_: DataFrame, merged: Column, key: list[str] = TABLE) -> DataFrame:
    """Neighbouring bands for which ``merged`` holds become one; numbers are given anew."""
    w = Window.partitionBy(*key).orderBy("n")
    b = bands_.withColumn("m", merged)
    b = b.withColumn("g", F.sum(F.when(F.col("m") & F.coalesce(F.lag("m").over(w), F.lit(False)), 0).otherwise(1)).over(w))
    out = b.groupBy(*key, "g").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return out.withColumn("n", (F.row_number().over(Window.partitionBy(*key).orderBy("low")) - 1).cast("long")).select(*key, "n", "low", "high")


def split_band(words: DataFrame, band: DataFrame, axis: str, at_low: int, at_high: int, fuzzy: bool = True, key: list[str] = TABLE) -> DataFrame:
    """Split a band in up to three by a range: words before, inside and after it (by centre, or by containment).

    Parts without words vanish; with fewer than two parts the band stays whole.
    """
    low, high, c = ("l", "r", "cx") if axis == "x" else ("t", "b", "cy")
    lo, hi = F.lit(at_low).cast("long"), F.lit(at_high).cast("long")
    part = (
        F.when(F.col(c) < lo, 0).when(F.col(c) < hi, 1).otherwise(2) if fuzzy
        else F.when(F.col(high) <= lo, 0).when((F.col(low) >= lo) & (F.col(high) <= hi), 1).when(F.col(low) >= hi, 2)
    )
    b = band.select(*key, "n", F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    w = words.join(b, key).where((F.col(c) >= F.col("b_low")) & (F.col(c) < F.col("b_high"))).withColumn("part", part).where("part is not null")
    parts = w.groupBy(*key, "n", "part").agg(F.min(low).alias("low"), F.max(high).alias("high"))
    several = Window.partitionBy(*key, "n")
    parts = parts.withColumn("k", F.count("*").over(several)).where("k > 1").drop("k")
    whole = band.join(parts.select(*key, "n").distinct(), [*key, "n"], "left_anti").select(*key, "n", F.lit(0).alias("part"), "low", "high")
    return parts.unionByName(whole)


def merge_cells(cells_: DataFrame, area: DataFrame, key: list[str] = TABLE) -> DataFrame:
    """Merge the cells that meet an area, which grows over every cell it cuts until nothing changes."""
    now = area.select(*key, *[F.col(c).alias(f"o_{c}") for c in "lrtb"])
    while True:
        hit = cells_.join(now, key).where(overlaps(box(), box("o_")))
        grown = written(
            hit.groupBy(*key).agg(*[F.min(F.least(c, f"o_{c}")).alias(f"o_{c}") for c in "lt"], *[F.max(F.greatest(c, f"o_{c}")).alias(f"o_{c}") for c in "rb"])
            .select(*key, *[f"o_{c}" for c in "lrtb"]), "grown",
        )
        if grown.exceptAll(now.select(*grown.columns)).isEmpty():
            break
        now = grown
    new_id = F.concat_ws(",", *[F.col(f"o_{c}").cast("string") for c in "lrtb"])
    j = cells_.join(now, key, "left")
    inside = F.coalesce(overlaps(box(), box("o_")), F.lit(False))
    return j.select(
        *[F.col(c) for c in cells_.columns if c not in ("l", "r", "t", "b", "cell_id")],
        *[F.when(inside, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in "lrtb"],
        F.when(inside, new_id).otherwise(F.col("cell_id")).alias("cell_id"),
    )


def split_cells(cells_: DataFrame, key: list[str] = TABLE) -> DataFrame:
    """Merged cells fall apart into one cell for each place, bounded by the single cells of their row and column."""
    g = grid(cells_, key)
    col_l = g.where("col_span = 1").groupBy(*key, "col").agg(F.min("l").alias("c_l"), F.max("r").alias("c_r"))
    row_t = g.where("row_span = 1").groupBy(*key, "row").agg(F.min("t").alias("r_t"), F.max("b").alias("r_b"))
    j = g.join(col_l, [*key, "col"], "left").join(row_t, [*key, "row"], "left")
    wide, tall = F.col("col_span") > 1, F.col("row_span") > 1
    out = j.select(
        *key, "row", "col", F.when(wide, F.coalesce("c_l", "l")).otherwise(F.col("l")).alias("l"), F.when(wide, F.coalesce("c_r", "r")).otherwise(F.col("r")).alias("r"),
        F.when(tall, F.coalesce("r_t", "t")).otherwise(F.col("t")).alias("t"), F.when(tall, F.coalesce("r_b", "b")).otherwise(F.col("b")).alias("b"),
    )
    return out.withColumn("cell_id", F.concat_ws(",", *[F.col(c).cast("string") for c in "lrtb"]))


def header_rows(cells_: DataFrame, key: list[str] = TABLE, view: bool = False) -> DataFrame:
    """``row, is_header``: the first row always (in a view: if there are more than two), then marked rows without a break."""
    rows = cells_.groupBy(*key, "row").agg(F.bool_or("marked").alias("m"))
    w = Window.partitionBy(*key)
    first = (F.col("row") == 0) & (F.count("*").over(w) > 2 if view else F.lit(True))
    r = rows.withColumn("h", first | F.coalesce("m", F.lit(False)))
    return r.select(*key, "row", F.min("h").over(w.orderBy("row")).alias("is_header"))


def combined_grid(cells_: DataFrame, chains: DataFrame, header: int = 1) -> DataFrame:
    """One grid from a chain of tables: rows of continued tables follow, their repeated header rows left out."""
    j = cells_.join(chains, ["doc_id", "table_id"]).where((F.col("place") == 0) | (F.col("row") >= header))
    rows = j.select("doc_id", "chain", "place", "row").distinct()
    number = Window.partitionBy("doc_id", "chain").orderBy("place", "row")
    rows = rows.withColumn("grid_row", (F.row_number().over(number) - 1).cast("long"))
    return j.join(rows, ["doc_id", "chain", "place", "row"])
