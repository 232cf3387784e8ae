"""Line deduplication by a fixed-depth template tree.

A line's tokens with digits are variable fields, written ``<*>``. The tree has
one level for the token count and one for each of the DEPTH leading tokens;
lines meet in its leaves. In a leaf, the line that most texts hold founds a
template, and lines that agree with it in SIMILAR of their tokens belong to it,
their differing tokens being variable fields too; what is left founds further
templates in the same way, until no leaf has two open lines that three texts may
hold, and remaining lines stand for themselves. A template
that occurs in LEAST_TEXTS distinct texts or more recurs, and its lines are
dropped everywhere. Lines of fewer than LEAST_TOKENS tokens are never dropped.

Everything is DataFrame functions. A line is masked once and written with its
hashes; counting works on the hashes, and tokens are looked at only in leaves
in which lines could join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import materialize

DEPTH = 3
SIMILAR = 0.7
LEAST_TEXTS = 3
#: Shorter lines say too little to be told from chance: most of their tokens are the tree's leading ones.
LEAST_TOKENS = 4
#: A round founds the templates of so many lines of a leaf at once, four times as many each round.
FIRST_LINES, MOST_LINES = 8, 1024
#: A leaf's lines are compared with its founders in so many tasks.
SALTS = 8
FIELD = "<*>"


def masked_lines(text):
    """A text's lines with white space as single spaces and every token that holds a digit as a variable field.

    White space is looked at only in texts that have any but single spaces and line ends.
    """
    odd = F.lit(False)
    for w in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | text.contains(w)
    flat = F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}+|[\x09\x0B-\x0D]", " ")).otherwise(text)
    plain = F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))
    digits = F.transform(
        plain, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(x)
    )
    return F.transform(digits, lambda x: F.struct(x.alias("masked"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("tokens")))


def _md5(text):
    return F.unhex(F.md5(text.cast("binary")))


def _lines(texts: DataFrame) -> DataFrame:
    """``text_key, pos, line_key, leaf, masked`` of the lines that are long enough."""
    # key and lines are columns before the lines are exploded: beside the explosion, the key would be made for each line;
    # the explosion is outer, since for others the planner makes a filter of the array and masks the lines twice
    keyed = texts.select(_md5(F.col("text")).alias("text_key"), masked_lines(F.col("text")).alias("lines"))
    rows = keyed.select("text_key", F.posexplode_outer("lines").alias("pos", "x")).where((F.col("x.tokens") >= LEAST_TOKENS) & (F.col("x.masked") != ""))
    leaf = F.xxhash64("x.tokens", F.substring_index("x.masked", " ", DEPTH))
    return rows.select("text_key", "pos", _md5(F.col("x.masked")).alias("line_key"), leaf.alias("leaf"), F.col("x.masked").alias("masked"))


def _similar(a, b):
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same >= F.size(a) * SIMILAR


def _may_join(lines: DataFrame) -> DataFrame:
    """Lines that share one of their segments with another line of their leaf; no others can be similar to any.

    Similar lines of m tokens differ in d = m - ceil(SIMILAR m) places at most, so of d + 1 segments one is the same in both.
    """
    m = F.col("m")
    last = m - F.ceil(m * SIMILAR)  # segments are numbered 0 to d
    begin = lambda i: F.lit(DEPTH) + F.floor(i * (m - DEPTH) / (last + 1))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.xxhash64(i, F.slice("w", (begin(i) + 1).cast("int"), (begin(i + 1) - begin(i)).cast("int"))))
    keys = lines.select("leaf", "line_key", F.split("masked", " ").alias("w")).withColumn("m", F.size("w").cast("long"))
    keys = keys.select("leaf", "line_key", F.explode(parts).alias("part"))
    common = keys.groupBy("leaf", "part").agg(F.count("*").alias("c")).where("c > 1").select("leaf", "part")
    alive = keys.join(common, ["leaf", "part"], "left_semi").select("line_key").distinct()
    return lines.join(alive, "line_key", "left_semi")


def _still_open(lines: DataFrame) -> DataFrame:
    """Lines of leaves in which a template may yet have several lines and recur."""
    lines = materialize(_may_join(lines), "open")
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n").alias("texts"))
    return lines.join(leaves.where((F.col("lines") > 1) & (F.col("texts") >= LEAST_TEXTS)).select("leaf"), "leaf", "left_semi")


def _founders(lines: DataFrame, most: int) -> DataFrame:
    """``leaf, founders``: of each leaf's ``most`` first lines, those that join none before them, in order.

    Founding one template after the other gives the same: whether a line founds depends on the lines before it only.
    """
    w = Window.partitionBy("leaf").orderBy(F.col("n").desc(), "line_key")
    top = lines.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    top = top.select("leaf", F.struct("k", "line_key", F.split("masked", " ").alias("model")).alias("f"))
    top = top.groupBy("leaf").agg(F.array_sort(F.collect_list("f")).alias("top"))
    none = F.slice("top", 1, 0)
    joins = lambda acc, x: F.exists(acc, lambda f: _similar(x["model"], f["model"]))
    return top.select("leaf", F.aggregate("top", none, lambda acc, x: F.when(joins(acc, x), acc).otherwise(F.concat(acc, F.array(x)))).alias("founders"))


def recurring(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(occurrences, dropped)`` for rows ``text``.

    occurrences: ``text_key, pos, line_key`` of the texts' lines, copies of a
    text included; dropped: ``line_key, template`` of lines that belong to
    recurring templates.
    """
    lines = materialize(_lines(texts), "lines", "zstd")
    occ = lines.select("text_key", "pos", "line_key")
    per_line = materialize(
        lines.groupBy("line_key", "leaf", "text_key").count().groupBy("line_key", "leaf").agg(F.count("*").alias("n")), "per-line"
    )
    shared = per_line.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n").alias("n")).where(
        (F.col("lines") > 1) & (F.col("n") >= LEAST_TEXTS)
    )
    shared = materialize(shared.select("leaf"), "leaves")
    tokens = lines.join(shared, "leaf", "left_semi").select("leaf", "line_key", "masked").distinct()
    open_ = materialize(_still_open(tokens.join(per_line.select("line_key", "n"), "line_key")), "open")
    assigned = open_.select("line_key", F.col("line_key").alias("template")).limit(0)
    most = FIRST_LINES
    while not open_.isEmpty():
        founders = _founders(open_, most).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = open_.withColumn("salt", F.pmod(F.xxhash64("line_key"), F.lit(SALTS)).cast("int"))
        mates = salted.join(founders, ["leaf", "salt"]).withColumn("w", F.split("masked", " "))
        first = F.get(F.filter("founders", lambda f: _similar(F.col("w"), f["model"])), F.lit(0))
        mates = materialize(mates.select("line_key", "leaf", "masked", "n", first["line_key"].alias("template")), "mates")
        assigned = assigned.union(mates.where("template is not null").select("line_key", "template"))
        open_ = materialize(_still_open(mates.where("template is null").drop("template")), "open")
        most = min(4 * most, MOST_LINES)
    # a template's texts are counted once each, however many of its lines they hold
    grouped = (
        occ.join(assigned, "line_key").select("template", "text_key").distinct().groupBy("template").agg(F.count("*").alias("n"))
    )
    often = grouped.where(F.col("n") >= LEAST_TEXTS).select("template")
    alone = per_line.where(F.col("n") >= LEAST_TEXTS).join(assigned.select("line_key"), "line_key", "left_anti")
    dropped = assigned.join(often, "template", "left_semi").select("line_key", "template").union(
        alone.select("line_key", F.col("line_key").alias("template"))
    )
    return occ, materialize(dropped, "dropped")


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row, recurring lines left out of the text.

    A null text has no lines and stays null; an empty text has one empty line.
    Copies of a text count as one text and lose the same lines; an empty table
    gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    occ, dropped = recurring(texts)
    gone = occ.join(dropped.select("line_key"), "line_key", "left_semi").groupBy("text_key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", _md5(F.col("text")).alias("text_key"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.join(materialize(gone, "gone"), "text_key", "left")
    # what stays are the runs of lines between those that go
    before = F.concat(F.array(F.lit(-1)), "gone")
    after = F.concat("gone", F.array(F.size("lines")))
    runs = F.zip_with(before, after, lambda a, b: F.slice("lines", a + 2, b - a - 1))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.flatten(runs))
    return rows.select(
        "doc_id", F.coalesce(F.array_size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"),
    )
