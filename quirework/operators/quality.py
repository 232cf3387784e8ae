"""Quality findings: protocol files, counts, order, subjects, and pluggable checkers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions.geometry import box, contains

FIELDS = ("description", "source", "subject_class", "subject_type", "subject_id", "page_id", "last_page_id", "first_word", "last_word")
SEVERITIES = ("blocker", "critical", "major", "minor")


def parse_protocol(lines: DataFrame, file: str = "file", at: str = "at", line: str = "line") -> DataFrame:
    """Errors from protocol lines (tab-separated, in order of ``at`` within ``file``).

    CATEGORY and TYPE lines set the context of the ERROR and FALPOS lines that
    follow. The severity may be missing, then it is critical. Rows too short to
    name a subject are skipped.
    """
    f = F.split(line, "\t", -1)
    rows = lines.select(F.col(file).alias("file"), F.col(at).alias("at"), f.alias("f"))
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.get("f", F.lit(0))
    rows = rows.withColumn("category", F.last(F.when(kind == "CATEGORY", F.get("f", F.lit(1))), ignorenulls=True).over(order))
    rows = rows.withColumn("type", F.last(F.when(kind == "TYPE", F.get("f", F.lit(1))), ignorenulls=True).over(order))
    rows = rows.where(kind.isin("ERROR", "FALPOS"))
    graded = F.get("f", F.lit(1)).isin(*SEVERITIES)
    first = F.when(graded, 2).otherwise(1)
    part = lambda i: F.get("f", first + i)
    cols = [part(i).alias(n) for i, n in enumerate(FIELDS)]
    out = rows.select(
        "file", "at", "category", "type", F.when(graded, F.get("f", F.lit(1))).otherwise("critical").alias("severity"),
        (F.get("f", F.lit(0)) == "FALPOS").alias("false_positive"), *cols,
    )
    ints = {c: F.col(c).try_cast("int") for c in ("page_id", "last_page_id")}
    return out.where(F.col("last_page_id").isNotNull()).withColumns(ints)


def write_protocol(errors: DataFrame) -> DataFrame:
    """``at, line``: the protocol of parsed errors: categories, their types, then errors before false positives."""
    tab = lambda *c: F.concat_ws("\t", *c)
    cats = errors.select("category").distinct().select("category", F.lit("").alias("type"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), tab(F.lit("CATEGORY"), "category", "category", F.lit("")).alias("line"))
    types = errors.select("category", "type").distinct().select("category", "type", F.lit(1).alias("part"), F.lit(0).cast("long").alias("k"), tab(F.lit("TYPE"), "type", "type", F.lit("")).alias("line"))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS]
    rows = errors.select(
        "category", "type", F.when(F.col("false_positive"), 3).otherwise(2).alias("part"), F.col("at").cast("long").alias("k"),
        tab(F.when(F.col("false_positive"), "FALPOS").otherwise("ERROR"), "severity", *fields).alias("line"),
    )
    return cats.unionByName(types).unionByName(rows).orderBy("category", "type", "part", "k", "line").select("line")


def without_false_positives(errors: DataFrame, false_positives: DataFrame, key: list[str]) -> DataFrame:
    """Newly added errors that are marked false positive already are refused; marking later removes none."""
    return errors.join(false_positives.select(*key), key, "left_anti")


def ordered(errors: DataFrame) -> DataFrame:
    """``rank``: page, last page, general before specific, first word up, last word down, subject type."""
    w = Window.partitionBy("doc_id").orderBy(
        F.col("page_id").asc_nulls_first(), F.col("last_page_id").asc_nulls_first(), F.col("first_pos").asc_nulls_first(),
        F.col("last_pos").desc_nulls_first(), F.col("subject_type").asc_nulls_first(), "error_id",
    )
    return errors.withColumn("rank", F.row_number().over(w))


def subjects(errors: DataFrame, words: DataFrame, regions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Errors with the object that they mean (``found_id``), by subject class.

    word: the word at ``first_pos``; region: the region of that type and number
    on the page; annotation: the annotation of that type and span, else the
    smallest region of that type around its first word; document: itself.
    """
    e = errors
    doc = e.where("subject_class = 'document'").withColumn("found_id", F.col("doc_id").cast("string"))
    w = words.select("doc_id", F.col("pos").alias("first_pos"), F.lit(True).alias("hit"))
    word = e.where("subject_class = 'word'").join(w, ["doc_id", "first_pos"], "left")
    word = word.withColumn("found_id", F.when(F.col("hit"), F.col("first_pos").cast("string"))).drop("hit")
    r = regions.select("doc_id", "page_id", F.col("type").alias("subject_type"), F.col("n").cast("string").alias("subject_id"), F.lit(True).alias("hit"))
    region = e.where("subject_class = 'region'").join(r, ["doc_id", "page_id", "subject_type", "subject_id"], "left")
    region = region.withColumn("found_id", F.when(F.col("hit"), F.concat_ws("@", "subject_type", "subject_id"))).drop("hit")
    ann = e.where("subject_class = 'annotation'")
    a = annotations.select("doc_id", F.col("type").alias("subject_type"), "first_pos", "last_pos", "ann_id")
    ann = ann.join(a, ["doc_id", "subject_type", "first_pos", "last_pos"], "left")
    at = words.select("doc_id", F.col("pos").alias("first_pos"), "page_id", *[F.col(c).alias(f"w_{c}") for c in "lrtb"])
    around = (
        ann.where("ann_id is null").select("doc_id", "error_id", "subject_type", "first_pos").join(at, ["doc_id", "first_pos"])
        .join(regions.withColumnRenamed("type", "subject_type"), ["doc_id", "page_id", "subject_type"]).where(contains(box(), box("w_")))
        .withColumn("area", box().area).groupBy("doc_id", "error_id").agg(F.min_by("n", "area").alias("region_n"))
    )
    ann = ann.join(around, ["doc_id", "error_id"], "left").withColumn(
        "found_id", F.coalesce("ann_id", F.concat_ws("@", F.when(F.col("region_n").isNotNull(), F.col("subject_type")), F.col("region_n").cast("string")))
    ).drop("ann_id", "region_n")
    out = doc
    for part in (word, region, ann):
        out = out.unionByName(part)
    return out


Checker = Callable[[DataFrame], DataFrame]
_checkers: dict[str, tuple[str, str, Checker]] = {}


def checker(name: str, category: str, type_: str) -> Callable[[Checker], Checker]:
    """Register a function from words to findings ``doc_id, page_id, first_pos, last_pos, description, severity``."""

    def register(f: Checker) -> Checker:
        _checkers[name] = (category, type_, f)
        return f

    return register


def run_checkers(words: DataFrame, names: list[str] | None = None) -> DataFrame:
    out = None
    for name in sorted(names or _checkers):
        category, type_, f = _checkers[name]
        found = f(words).select(
            "doc_id", F.lit(name).alias("source"), F.lit(category).alias("category"), F.lit(type_).alias("type"), "severity", "page_id",
            "first_pos", "last_pos", "description",
        )
        out = found if out is None else out.unionByName(found)
    return out


@checker("shouting", "wording", "all-caps")
def shouting(words: DataFrame) -> DataFrame:
    hit = words.where(F.col("str").rlike(r"^\p{Lu}{4,}"))
    return hit.select("doc_id", "page_id", F.col("pos").alias("first_pos"), F.col("pos").alias("last_pos"), F.lit("word in capitals").alias("description"), F.lit("minor").alias("severity"))


@checker("open-hyphen", "layout", "hyphenation")
def open_hyphen(words: DataFrame) -> DataFrame:
    hit = words.where(F.col("rel") == "H")
    return hit.select("doc_id", "page_id", F.col("pos").alias("first_pos"), F.col("pos").alias("last_pos"), F.lit("word ends in a hyphen").alias("description"), F.lit("major").alias("severity"))


def read_protocols(spark: SparkSession, path: str) -> DataFrame:
    """Lines of protocol files as ``file, at, line``; line numbers come from whole-file reading, one file a row."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where("line <> ''")
