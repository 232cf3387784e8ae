"""Readers and writers of document files: recognised-word HTML, entity folders, XML and plain text, reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import xml_escape

ENTITIES = ("pages", "words", "regions", "annotations", "fonts", "supplements")
_SPAN = r"(?is)<span\b[^>]*class=['\"][^'\"]*ocrx_word['\"][^>]*title=['\"][^'\"]*bbox (\d+) (\d+) (\d+) (\d+)[^'\"]*['\"][^>]*>(.*?)</span>"


def ocr_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """Recognised words of pages: ``l, r, t, b, str`` and all other columns. Titles give left, top, right, bottom."""
    found = F.regexp_extract_all(html, F.lit(_SPAN), F.lit(0))
    rows = pages.withColumn("span", F.explode(found))
    part = lambda i: F.regexp_extract("span", _SPAN, i)
    text = F.trim(F.regexp_replace(part(5), "<[^>]*>", ""))
    return rows.select(
        *[c for c in pages.columns if c != html], part(1).cast("int").alias("l"), part(3).cast("int").alias("r"), part(2).cast("int").alias("t"),
        part(4).cast("int").alias("b"), text.alias("str"),
    )


def ocr_languages(names: str) -> list[str]:
    """Distinct languages of a ``+`` list, ignoring case, English first."""
    seen = dict.fromkeys(n.strip().lower() for n in names.split("+") if n.strip())
    return sorted(seen, key=lambda n: n != "eng")


def store(document: dict[str, DataFrame], path: str) -> None:
    """A folder of Parquet tables, one per entity; large tables are laid out by document."""
    for name, df in document.items():
        if name not in ENTITIES:
            raise ValueError(f"unknown entity {name}")
        df.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: tuple[str, ...] = ENTITIES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def entry_list(supplements: DataFrame) -> DataFrame:
    """Tab-separated list of stored entries: name, size, checksum."""
    return supplements.select(
        F.concat_ws("\t", "supp_id", F.octet_length("payload").cast("string"), F.md5("payload")).alias("value")
    )


def write_text(texts: DataFrame, path: str, column: str = "text") -> None:
    texts.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def document_xml(paragraphs: DataFrame, key: str = "doc_id", order: str = "paragraph", text: str = "text") -> DataFrame:
    """``key, xml``: paragraphs of a document as escaped elements in order."""
    item = F.struct(F.col(order).alias("at"), F.concat(F.lit("<paragraph>"), xml_escape(F.col(text)), F.lit("</paragraph>")).alias("x"))
    g = paragraphs.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("ps"))
    return g.select(key, F.concat(F.lit("<document>"), F.array_join(F.transform("ps", lambda p: p["x"]), ""), F.lit("</document>")).alias("xml"))


def figures(supplements: DataFrame) -> DataFrame:
    return supplements.where("supp_type = 'figure'").select("doc_id", "supp_id", "mime", "page_id", "payload")


def page_images(pages: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Pages with the image of the first store that has one."""
    p = primary.select("doc_id", "page_id", F.col("payload").alias("first"))
    q = fallback.select("doc_id", "page_id", F.col("payload").alias("second"))
    j = pages.join(p, ["doc_id", "page_id"], "left").join(q, ["doc_id", "page_id"], "left")
    return j.withColumn("payload", F.coalesce("first", "second")).drop("first", "second")


def bigrams(spark: SparkSession, path: str) -> DataFrame:
    """``bigram, share, n`` of tab-separated frequency lists; counts may have thousands separators."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("//"))
    return rows.select(
        F.get(f, F.lit(0)).alias("bigram"), F.get(f, F.lit(1)).try_cast("double").alias("share"),
        F.regexp_replace(F.get(f, F.lit(2)), "[.,]", "").try_cast("long").alias("n"),
    )


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)
