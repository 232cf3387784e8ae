"""Registered queries of tokens, styles, table bands and edits, beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirework.functions import text as tx
from quirework.functions.geometry import div, turned
from quirework.operators import aggregates, edits, intervals, streams, tables
from quirework.plans.queries import _COLS, _ORIGIN, _TW, _table_words, _words, document_origin, query
from quirework.sources import layout
from quirework.streaming import changes


@query("SELECT a.doc_id, ann_id, f.str AS first_word, z.str AS last_word FROM annots a JOIN words f ON a.doc_id = f.doc_id AND f.pos = first_pos JOIN words z ON a.doc_id = z.doc_id AND z.pos = last_pos")
def annotation_end_words(spark, d):
    w = _words(spark, d).select("doc_id", "pos", "str")
    a = layout.annotations(_words(spark, d))
    first, last = (w.select("doc_id", F.col("pos").alias(f"{n}_pos"), F.col("str").alias(f"{n}_word")) for n in ("first", "last"))
    return a.join(first, ["doc_id", "first_pos"]).join(last, ["doc_id", "last_pos"]).select("doc_id", "ann_id", "first_word", "last_word")


@query("SELECT doc_id, ann_id, first_pos <= 100 AND last_pos + 1 >= 103 AS spans FROM annots WHERE first_pos <= 119 AND last_pos + 1 >= 101")
def token_spans(spark, d):
    a = layout.annotations(_words(spark, d)).select("doc_id", "ann_id", F.col("first_pos").alias("start"), (F.col("last_pos") + 1).alias("end"))
    hit = intervals.token_overlapping(a, 100, 120)
    whole = intervals.token_spanning(hit, 100, 103).select("doc_id", "ann_id", F.lit(True).alias("spans"))
    return hit.join(whole, ["doc_id", "ann_id"], "left").select("doc_id", "ann_id", F.coalesce("spans", F.lit(False)).alias("spans"))


@query("SELECT doc_id, ann_id FROM annots WHERE doc_id IN (SELECT doc_id FROM words WHERE pos = 50 AND rel = 'S')")
def annotations_in_streams(spark, d):
    w = _words(spark, d)
    return intervals.in_streams(layout.annotations(w), w.where("pos = 50 and rel = 'S'")).select("doc_id", "ann_id")


@query("SELECT doc_id, page_id, array_to_string(list_sort(list_distinct(list(font_size))), ' ') AS sizes FROM words GROUP BY ALL")
def distinct_font_sizes(spark, d):
    v = aggregates.distinct_values(_words(spark, d), ["doc_id", "page_id"], "font_size")
    return v.select("doc_id", "page_id", F.array_join(F.col("values").cast("array<string>"), " ").alias("sizes"))


@query("SELECT doc_id, first_pos FROM annots WHERE type = 'entity' INTERSECT SELECT doc_id, first_pos FROM annots WHERE type = 'passage'")
def common_starts(spark, d):
    a = layout.annotations(_words(spark, d))
    return a.where("type = 'entity'").select("doc_id", "first_pos").intersect(a.where("type = 'passage'").select("doc_id", "first_pos"))


@query(", g AS (SELECT doc_id, page_id, n, b - t AS height, t - lag(b) OVER w AS gap, n // 3 = lag(n // 3) OVER w AS same FROM lines WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY t, n)) "
       "SELECT doc_id, page_id, coalesce((sum(gap) FILTER (same))::BIGINT // nullif(count(gap) FILTER (same), 0), sum(height)::BIGINT // count(*) // 4) AS in_cell, "
       "coalesce((sum(gap) FILTER (NOT same))::BIGINT // nullif(count(gap) FILTER (NOT same), 0), sum(height)::BIGINT // count(*) // 2) AS across FROM g GROUP BY ALL")  # fmt: skip
def row_gap_means(spark, d):
    lines = layout.lines(_words(spark, d)).withColumn("cell", div(F.col("n"), F.lit(3)))
    return streams.row_gap_means(lines, ["doc_id", "page_id"])


_WORD_CELLS = _TW + ", wc AS (SELECT doc_id, table_id, line AS row, col, l, r, length(str) % 4 > 0 AND col < 4 AS is_header FROM tw)"


def _word_cells(spark, d):
    """Each table word as a cell; most words of the first four columns are headers."""
    header = (F.length("str") % 4 > 0) & (F.col("col") < 4)
    return _table_words(spark, d).select("doc_id", "table_id", F.col("line").alias("row"), "col", "l", "r", header.alias("is_header"))


@query(_WORD_CELLS + " SELECT doc_id, table_id, col, bool_and(most) OVER (PARTITION BY doc_id, table_id ORDER BY col) AS is_label FROM "
       "(SELECT doc_id, table_id, col, count(*) FILTER (is_header) * 2 > count(*) AS most FROM wc GROUP BY ALL)")  # fmt: skip
def header_columns(spark, d):
    return aggregates.header_flags(_word_cells(spark, d), tables.TABLE, "col", "row")


@query(_WORD_CELLS + " SELECT doc_id, table_id, sum(CASE WHEN is_header THEN r - l ELSE 0 END) * 2 > sum(r - l) AS is_label FROM wc GROUP BY ALL")
def wide_labels(spark, d):
    return aggregates.tall_label(_word_cells(spark, d), tables.TABLE)


@query(_ORIGIN.replace("SELECT doc_id, (CASE", ", o AS (SELECT doc_id, (CASE") + ") SELECT doc_id, (origin & 65536) <> 0 AS born_digital FROM o")
def born_digital(spark, d):
    return document_origin(spark, d).select("doc_id", aggregates.is_born_digital(F.col("origin")).alias("born_digital"))


@query("SELECT doc_id, pos, CASE direction WHEN 'lr' THEN 'td' ELSE 'ud' END AS clockwise, CASE direction WHEN 'lr' THEN 'bu' ELSE 'lr' END AS counter FROM words WHERE line = 0")
def turned_directions(spark, d):
    w = _words(spark, d).where("line = 0")
    return w.select("doc_id", "pos", turned(F.col("direction"), True).alias("clockwise"), turned(F.col("direction"), False).alias("counter"))


@query("SELECT doc_id, pos, (font_size & 4) <> 0 AS has, font_size | 1 AS with_one, font_size & ~8 AS without_eight FROM words WHERE line = 1")
def style_bits(spark, d):
    b = F.col("font_size")
    return _words(spark, d).where("line = 1").select("doc_id", "pos", tx.has_style(b, 4).alias("has"), tx.with_style(b, 1).alias("with_one"), tx.with_style(b, 8, False).alias("without_eight"))


@query("SELECT doc_id, pos FROM (SELECT doc_id, pos, str || CASE WHEN pos % 5 = 0 THEN '-' ELSE '' END AS s, lead(str) OVER (PARTITION BY doc_id ORDER BY pos) AS f FROM words) "
       "WHERE regexp_matches(s, '\\p{L}-$') AND regexp_matches(f, '^\\p{Ll}')")  # fmt: skip
def hyphen_breaks(spark, d):
    w = _words(spark, d).select("doc_id", "pos", F.concat("str", F.when(F.col("pos") % 5 == 0, "-").otherwise("")).alias("s"), F.lead("str").over(Window.partitionBy("doc_id").orderBy("pos")).alias("f"))
    return w.where(tx.hyphenated(F.col("s"), F.col("f"))).select("doc_id", "pos")


@query("SELECT doc_id, ann_id, type FROM (SELECT doc_id, CASE WHEN first_pos % 2 = 0 AND type = 'entity' THEN 'name' ELSE type END AS type, first_pos, last_pos FROM annots "
       "WHERE NOT (type = 'passage' AND first_pos % 3 = 0)) t, LATERAL (SELECT type || ':' || first_pos || '-' || last_pos AS ann_id) "
       "UNION ALL SELECT DISTINCT doc_id, 'note:0-0', 'note' FROM annots")  # fmt: skip
def changed_annotations(spark, d):
    a = layout.annotations(_words(spark, d))
    gone = a.where("type = 'passage' and first_pos % 3 = 0")
    renamed = a.where("type = 'entity' and first_pos % 2 = 0").withColumn("new_type", F.lit("name"))
    note = a.where("first_pos = 0 and type = 'entity'").withColumns({"ann_id": F.lit("note:0-0"), "type": F.lit("note"), "last_pos": F.col("first_pos")})
    return edits.change_annotations(a, note, gone, renamed).select("doc_id", "ann_id", "type")


@query(_TW + _COLS + ", m AS (SELECT *, CASE WHEN n % 3 < 2 AND lag(n % 3 < 2) OVER w THEN 0 ELSE 1 END AS o FROM cs WINDOW w AS (PARTITION BY doc_id, table_id ORDER BY n)), "
       "g AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, table_id ORDER BY n) AS g FROM m) "
       "SELECT doc_id, table_id, row_number() OVER (PARTITION BY doc_id, table_id ORDER BY min(low)) - 1 AS n, min(low) AS low, max(high) AS high FROM g GROUP BY doc_id, table_id, g")  # fmt: skip
def merged_columns(spark, d):
    return tables.merge_bands(tables.columns_of(_table_words(spark, d)), F.col("n") % 3 < 2)


@query(_TW + ", lb AS (SELECT doc_id, table_id, array_agg(length(str) % 2 ORDER BY col) AS ls FROM tw WHERE line = 10 AND col < 4 GROUP BY ALL) "
       "SELECT a.doc_id, a.table_id, b.table_id AS other_id FROM lb a JOIN lb b ON a.doc_id = b.doc_id AND b.table_id = a.table_id + 1 AND len(a.ls) = len(b.ls) AND a.ls[2:] = b.ls[2:]")  # fmt: skip
def compatible_tables(spark, d):
    w = _table_words(spark, d).where("line = 10 and col < 4")
    cells = w.select("doc_id", "table_id", "col", F.lit(0).alias("row"), (F.length("str") % 2).alias("text"))
    found = tables.labels(cells, "col")
    pairs = found.select("doc_id", "table_id", (F.col("table_id") + 1).alias("other_id"))
    return tables.compatible(found, pairs)


@query("SELECT doc_id, pos, CASE WHEN pos % 97 = 3 THEN 'new' ELSE str END AS str, CASE WHEN pos % 101 = 5 THEN 'C' ELSE rel END AS rel FROM words WHERE doc_id IN (SELECT doc_id FROM words WHERE pos = 3)")
def repaired_words(spark, d):
    """Words of documents that string and relation changes touch; of several changes of a value the last counts."""
    w = _words(spark, d)
    event = lambda at, attr, value, seq: w.where(at).select("doc_id", F.col("pos").cast("string").alias("object_id"), F.lit("change").alias("kind"), F.lit(attr).alias("attr"), F.lit(value).alias("new"), F.lit(seq).cast("long").alias("seq"))
    e = event("pos % 97 = 3", "str", "old", 1).unionByName(event("pos % 97 = 3", "str", "new", 2)).unionByName(event("pos % 101 = 5", "rel", "C", 3))
    return changes.touched_documents(e, w).select("doc_id", "pos", "str", "rel")
