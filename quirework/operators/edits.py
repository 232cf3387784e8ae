"""Edits as batch rewrites: words, annotations and regions after changes, and edit scripts between strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.geometry import box, point_in

LEVELS = {"raw": 0, "words": 1, "paragraphs": 2, "streams": 3}
NORMALISE, NO_TABLES, NO_CAPTIONS, PAGE_TITLES, LABELS, ARTIFACTS = 4, 8, 16, 128, 256, 512


def in_scope(words: DataFrame, flags: int) -> DataFrame:
    """Words of the stream types (``stream_type``) that a view with these flags shows.

    Deleted words never; tables, and captions with footnotes, unless excluded. From level paragraphs on, page titles,
    labels and artifacts only if included.
    """
    out = ["deleted"]
    if flags & NO_TABLES:
        out.append("table")
    if flags & NO_CAPTIONS:
        out += ["caption", "footnote"]
    if flags & 3 >= LEVELS["paragraphs"]:
        out += [t for t, bit in (("pageTitle", PAGE_TITLES), ("label", LABELS), ("artifact", ARTIFACTS)) if not flags & bit]
    return words.where(~F.coalesce("stream_type", F.lit("mainText")).isin(*out))


def rewrite(words: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words with new strings (``new_str``; null removes) and relations (``new_rel``); streams are numbered anew.

    The predecessor of removed words keeps the looser of the relations around them: a paragraph end survives.
    """
    e = edits.select(key, "pos", "new_str", "new_rel", F.lit(True).alias("hit"))
    w = words.join(e, [key, "pos"], "left")
    gone = F.coalesce("hit", F.lit(False)) & F.col("new_str").isNull()
    w = w.withColumns({"gone": gone, "str": F.coalesce("new_str", "str"), "rel": F.coalesce("new_rel", "rel")})
    by = Window.partitionBy(key).orderBy("pos")
    group = F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(by)
    w = w.withColumn("group", group)
    tail = w.where("gone and rel = 'P'").select(key, "group").distinct().withColumn("ends", F.lit(True))
    w = w.where("not gone").join(tail, [key, "group"], "left")
    w = w.withColumn("rel", F.when(F.col("ends"), "P").otherwise(F.col("rel")))
    return w.withColumn("new_pos", (F.row_number().over(by) - 1).cast("long")).drop("gone", "group", "ends", "hit", "new_str", "new_rel")


def carry_annotations(annotations: DataFrame, rewritten: DataFrame, key: str = "doc_id") -> DataFrame:
    """Annotations in new positions; those whose first or last word is gone are dropped."""
    at = rewritten.select(key, "pos", "new_pos")
    first = at.select(key, F.col("pos").alias("first_pos"), F.col("new_pos").alias("new_first"))
    last = at.select(key, F.col("pos").alias("last_pos"), F.col("new_pos").alias("new_last"))
    return annotations.join(first, [key, "first_pos"]).join(last, [key, "last_pos"])


def carry_regions(regions: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Regions that still hold a word."""
    w = rewritten.select("doc_id", "page_id", "cx", "cy")
    on = [regions["doc_id"] == w["doc_id"], regions["page_id"] == w["page_id"], point_in(w["cx"], w["cy"], box())]
    return regions.join(w, on, "left_semi")


def change_annotations(annotations: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, renamed: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Annotations removed (key, ``ann_id``), renamed (``new_type``) and added; equal ids are added once."""
    out = annotations
    if removed is not None:
        out = out.join(removed.select(key, "ann_id"), [key, "ann_id"], "left_anti")
    if renamed is not None:
        r = renamed.select(key, "ann_id", "new_type")
        out = out.join(r, [key, "ann_id"], "left")
        changed = F.concat("new_type", F.substring("ann_id", F.length("type") + 1, F.length("ann_id")))
        out = out.withColumns({"ann_id": F.coalesce(changed, "ann_id"), "type": F.coalesce("new_type", "type")}).drop("new_type")
    if added is not None:
        out = out.unionByName(added.join(out.select(key, "ann_id"), [key, "ann_id"], "left_anti"))
    return out


def edit_script(a: str, b: str) -> str:
    """Fewest-edit script from a to b: K keep, R replace, I insert, D delete, one letter a step."""
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1), np.int32)
    d[:, 0], d[0] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            out.append("K" if a[i - 1] == b[j - 1] else "R")
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            out.append("D")
            i -= 1
        else:
            out.append("I")
            j -= 1
    return "".join(reversed(out))


def edit_scripts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    @F.pandas_udf("string")
    def script(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([edit_script(p or "", q or "") for p, q in zip(x, y)], dtype=object)

    return pairs.withColumn("script", script(a, b))


def apply_script(words: list[str], script: str, new: str) -> list[str]:
    """New strings of words after a script over their joined text; words left without characters come out empty."""
    out, w, at, j = ["" for _ in words], 0, 0, 0
    for step in script:
        while w < len(words) - 1 and at >= len(words[w]):
            w, at = w + 1, 0
        if step in "KRI":
            out[w] += new[j]
            j += 1
        if step in "KRD":
            at += 1
    return out


def subject_extents(errors: DataFrame, regions: DataFrame, words: DataFrame) -> DataFrame:
    """First and last page and word of errors' subjects: regions by their words, documents and fonts none (page -1)."""
    whole = errors.where("subject_class in ('document', 'font')").select("doc_id", "error_id", F.lit(-1).cast("long").alias("first_page"), F.lit(-1).cast("long").alias("last_page"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"))
    spans = errors.where("subject_class in ('word', 'annotation')").select("doc_id", "error_id", "first_pos", "last_pos")
    at = lambda p, q: words.select("doc_id", F.col("pos").alias(p), F.col("page_id").alias(q))
    spans = spans.join(at("first_pos", "first_page"), ["doc_id", "first_pos"]).join(at("last_pos", "last_page"), ["doc_id", "last_pos"])
    spans = spans.select("doc_id", "error_id", "first_page", "last_page", F.col("first_pos").alias("first_word"), F.col("last_pos").alias("last_word"))
    r = errors.where("subject_class = 'region'").select("doc_id", "error_id", "page_id", F.col("subject_type").alias("type"), F.col("subject_id").cast("long").alias("n"))
    r = r.join(regions, ["doc_id", "page_id", "type", "n"])
    inner = r.join(words.select("doc_id", "page_id", "pos", "cx", "cy", "line"), ["doc_id", "page_id"]).where(point_in(F.col("cx"), F.col("cy"), box()))
    order = F.struct("line", "cx", "pos")
    inner = inner.groupBy("doc_id", "error_id", "page_id").agg(F.min_by("pos", order).alias("first_word"), F.max_by("pos", order).alias("last_word"))
    inner = inner.select("doc_id", "error_id", F.col("page_id").alias("first_page"), F.col("page_id").alias("last_page"), "first_word", "last_word")
    return whole.unionByName(spans).unionByName(inner)


def region_tree(regions: DataFrame, parents: DataFrame) -> DataFrame:
    """Kind of each region of a page tree: ``block`` without children, ``column`` if its children stack within its width, else ``region``."""
    c = parents.groupBy("doc_id", "page_id", F.col("o_type").alias("type"), F.col("o_n").alias("n")).agg(F.count("*").alias("children"), F.count_if(F.col("r") - F.col("l") >= (F.col("o_r") - F.col("o_l")) * 0.8).alias("wide"))
    j = regions.join(c, ["doc_id", "page_id", "type", "n"], "left")
    kind = F.when(F.col("children").isNull(), "block").when(F.col("wide") == F.col("children"), "column").otherwise("region")
    return j.withColumn("kind", kind).drop("children", "wide")
