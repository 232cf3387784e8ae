"""Interval joins over text streams: annotations are closed intervals of word positions in one document's stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.geometry import div


def by_type_and_page(annotations: DataFrame, type_: str | None = None, first_page: int | None = None, last_page: int | None = None) -> DataFrame:
    out = annotations if type_ is None else annotations.where(F.col("type") == type_)
    if first_page is not None:
        out = out.where((F.col("last_page") >= first_page) & (F.col("first_page") <= (first_page if last_page is None else last_page)))
    return out


def at_words(annotations: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Annotations that start at one position or end at the other; one scan, so nothing is found twice."""
    starts = F.lit(False) if first is None else F.col("first_pos") == first
    ends = F.lit(False) if last is None else F.col("last_pos") == last
    return annotations.where(starts | ends)


def _named(spans: DataFrame, key: str) -> DataFrame:
    return spans.select(*[F.col(c).alias(c if c == key else f"q_{c}") for c in spans.columns])


def _bin(at, width: int):
    return div(F.col(at), F.lit(width))


def _binned(df: DataFrame, first: str, last: str, width: int) -> DataFrame:
    """Each row once for every bin of positions that it meets."""
    return df.withColumn("bin", F.explode(F.sequence(_bin(first, width), _bin(last, width))))


def spanning(annotations: DataFrame, spans: DataFrame, key: str = "doc_id", width: int = 32) -> DataFrame:
    """Annotations that reach over the whole of a span (``first_pos, last_pos``); span columns get prefix ``q_``.

    An annotation goes to all bins that it meets, a span to that of its first position, so a pair meets once.
    """
    q = _named(spans, key).withColumn("bin", _bin("q_first_pos", width))
    pairs = _binned(annotations, "first_pos", "last_pos", width).join(q, [key, "bin"])
    return pairs.where("first_pos <= q_first_pos and q_last_pos <= last_pos").drop("bin")


def overlapping(annotations: DataFrame, spans: DataFrame, key: str = "doc_id", width: int = 32) -> DataFrame:
    """Pairs of annotations and spans that share a position, by bins: a pair counts in the first bin that it shares."""
    q = _binned(_named(spans, key), "q_first_pos", "q_last_pos", width)
    pairs = _binned(annotations, "first_pos", "last_pos", width).join(q, [key, "bin"]).where("last_pos >= q_first_pos and first_pos <= q_last_pos")
    return pairs.where(F.col("bin") == div(F.greatest("first_pos", "q_first_pos"), F.lit(width))).drop("bin")


def inside(annotations: DataFrame, parents: DataFrame, key: str = "doc_id", width: int = 32) -> DataFrame:
    """Children of parents, both as half-open token ranges ``start, end``; ``rel_start, rel_end`` count from the parent's start.

    A parent goes to all bins that it meets, a child to that of its start.
    """
    q = parents.select(*[F.col(c).alias(c if c == key else f"q_{c}") for c in parents.columns]).where("q_start < q_end")
    q = q.withColumn("bin", F.explode(F.sequence(_bin("q_start", width), div(F.col("q_end") - 1, F.lit(width)))))
    hit = annotations.withColumn("bin", _bin("start", width)).join(q, [key, "bin"]).drop("bin")
    hit = hit.where("start >= q_start and start <= q_end - 1 and end >= q_start + 1 and end <= q_end")
    return hit.withColumns({"rel_start": F.col("start") - F.col("q_start"), "rel_end": F.col("end") - F.col("q_start")})


def token_overlapping(annotations: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open token ranges that overlap ``[start, end)``."""
    return annotations.where((F.col("start") <= end - 1) & (F.col("end") >= start + 1))


def token_spanning(annotations: DataFrame, start: int, end: int) -> DataFrame:
    return annotations.where((F.col("start") <= start) & (F.col("end") >= end))


def ordered(annotations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Annotation order as ``rank``: start up, end down, creation number up; equal ids once."""
    order = Window.partitionBy(key).orderBy("first_pos", F.col("last_pos").desc(), "create_no")
    return merged(annotations, key).withColumn("rank", F.row_number().over(order))


def merged(annotations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Annotations of equal id become the first created one; a map column ``attrs`` gains what later ones add."""
    rows = annotations.columns
    grouped = annotations.groupBy(key, "ann_id")
    first = F.min_by(F.struct(*[c for c in rows if c not in (key, "ann_id", "attrs")]), F.col("create_no")).alias("f")
    if "attrs" not in rows:
        return grouped.agg(first).select(key, "ann_id", "f.*").select(*rows)
    all_attrs = F.array_sort(F.collect_list(F.struct("create_no", "attrs")), lambda a, b: (a["create_no"] - b["create_no"]).cast("int"))
    early_wins = F.aggregate(
        F.transform("all", lambda x: F.coalesce(x["attrs"], F.create_map().cast("map<string,string>"))),
        F.create_map().cast("map<string,string>"),
        lambda acc, m: F.map_concat(acc, F.map_filter(m, lambda k, v: ~F.map_contains_key(acc, k))),
    )
    return grouped.agg(first, all_attrs.alias("all")).select(key, "ann_id", "f.*", early_wins.alias("attrs")).select(*rows)


def add_unique(existing: DataFrame, added: DataFrame, key: str = "doc_id") -> DataFrame:
    """Existing annotations and those added ones whose id is new, the first created of each."""
    new = added.join(existing.select(key, "ann_id"), [key, "ann_id"], "left_anti")
    return existing.unionByName(merged(new, key))


def cut_at(annotations: DataFrame, cuts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cutting ``[cut_first, cut_last]`` out of a stream trims annotations that reach over just one side of it.

    Those within it or apart from it, and those that span it wholly, stay.
    """
    j = annotations.join(cuts, key, "left")
    a, b, c, d = (F.col(x) for x in ("first_pos", "last_pos", "cut_first", "cut_last"))
    left_over, right_over = (a < c) & (b >= c), (a <= d) & (b > d)
    new_last = F.when(left_over & ~right_over, c - 1).otherwise(b)
    new_first = F.when(right_over & ~left_over, d + 1).otherwise(a)
    return j.withColumns({"new_first": new_first, "new_last": new_last})


def resolve_cells(annotations: DataFrame, word_cells: DataFrame, mode: str = "split", key: str = "doc_id") -> DataFrame:
    """Annotations over table cells (``word_cells``: key, pos, cell): those within one cell stay; others are split by
    runs of cells, removed, or cut to their first (cutToStart) or last (cutToEnd) cell."""
    w = annotations.withColumn("pos", F.explode(F.sequence("first_pos", "last_pos"))).join(word_cells, [key, "pos"])
    by = Window.partitionBy(key, "ann_id").orderBy("pos")
    w = w.withColumn("new", (~F.col("cell").eqNullSafe(F.lag("cell").over(by))).cast("int"))
    runs = (
        w.withColumn("run", F.sum("new").over(by)).groupBy(key, "ann_id", "type", "create_no", "run")
        .agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    )
    whole = Window.partitionBy(key, "ann_id")
    runs = runs.withColumn("runs", F.max("run").over(whole))
    if mode == "remove":
        runs = runs.where("runs = 1")
    elif mode == "cutToStart":
        runs = runs.where("run = 1")
    elif mode == "cutToEnd":
        runs = runs.where("run = runs")
    return runs.drop("runs")


def in_streams(annotations: DataFrame, streams: DataFrame, key: str = "doc_id") -> DataFrame:
    return annotations.join(streams.select(key), key, "left_semi")
