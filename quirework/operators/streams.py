"""Sequence operators: text streams are rows ordered by a position within a key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.geometry import box, div
from quirework.plans.scratch import written


def _by(key, order):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([order] if isinstance(order, str) else order))


def neighbours(words: DataFrame, key="doc_id", order="pos", columns=("str",)) -> DataFrame:
    w = _by(key, order)
    return words.withColumns({f"{p}_{c}": f(c).over(w) for c in columns for p, f in (("prev", F.lag), ("next", F.lead))})


def heads_and_tails(words: DataFrame, scope: str = "document", key: str = "doc_id", order: str = "pos") -> DataFrame:
    """``is_head, is_tail``: no neighbour at all (document) or none on the same page (page)."""
    w = _by(key, order)
    before, after = F.lag(order).over(w), F.lead(order).over(w)
    head, tail = before.isNull(), after.isNull()
    if scope == "page":
        head |= F.lag("page_id").over(w) != F.col("page_id")
        tail |= F.lead("page_id").over(w) != F.col("page_id")
    return words.withColumns({"is_head": head, "is_tail": tail})


def region_heads(words_in_region: DataFrame, all_words: DataFrame, region_key: list[str]) -> DataFrame:
    """Words in a region (``o_`` box columns) whose predecessor's centre is outside it; here the right and bottom
    edges belong to the region, unlike in the test that words are inside."""
    w = _by("doc_id", "pos")
    before = all_words.select(
        "doc_id", "pos", F.lag("cx").over(w).alias("p_cx"), F.lag("cy").over(w).alias("p_cy"), F.lag("page_id").over(w).alias("p_page")
    )
    o = box("o_")
    inside = (F.col("p_cx") >= o.l) & (F.col("p_cx") <= o.r) & (F.col("p_cy") >= o.t) & (F.col("p_cy") <= o.b)
    j = words_in_region.join(before, ["doc_id", "pos"])
    return j.where(F.col("p_page").isNull() | (F.col("p_page") != F.col("page_id")) | ~inside)


def number_streams(links: DataFrame, id_col: str = "word_id", prev_col: str = "prev_id", max_rounds: int = 40) -> DataFrame:
    """``word_id, stream_id, stream_pos`` from predecessor links: the head's id and the distance from it.

    Pointer doubling: each round jumps twice as far, so a stream of n words takes
    about log2(n) rounds. As positions have no gaps, each round settles some
    word until only words that hang on cycles are left; these have no head and
    are left out. A link to a word that isn't there makes its owner a head.
    """
    ids = links.select(F.col(id_col).alias("k"))
    now = links.select(F.col(id_col).alias("word_id"), F.col(prev_col).alias("at"))
    now = now.join(ids, F.col("at") == F.col("k"), "left").select("word_id", F.col("k").alias("at"))
    now = now.select("word_id", F.coalesce("at", "word_id").alias("at"), F.col("at").isNotNull().cast("long").alias("n"))
    open_before = None
    for _ in range(max_rounds):
        now = written(now, "jump")
        far = now.select(F.col("word_id").alias("k"), F.col("at").alias("at2"), F.col("n").alias("n2"))
        now = now.join(far, F.col("at") == F.col("k")).select(
            "word_id", F.col("at2").alias("at"), (F.col("n") + F.col("n2")).alias("n"), (F.col("n2") > 0).alias("moved")
        )
        now = written(now, "jumped")
        still_open = now.where("moved").count()
        now = now.drop("moved")
        if still_open in (0, open_before):
            break
        open_before = still_open
    heads = now.where("n = 0 and word_id = at").select(F.col("word_id").alias("k"))
    return now.join(heads, F.col("at") == F.col("k"), "left_semi").select("word_id", F.col("at").alias("stream_id"), F.col("n").alias("stream_pos"))


def stream_order(words: DataFrame) -> DataFrame:
    """``rank`` over all words of a document: streams by head page, head top, head left, then position."""
    by_stream = Window.partitionBy("doc_id", "stream_id")
    at_head = lambda c: F.min_by(c, "stream_pos").over(by_stream)
    w = words.withColumns({"head_page": at_head("page_id"), "head_top": at_head("t"), "head_left": at_head("l")})
    order = Window.partitionBy("doc_id").orderBy("head_page", "head_top", "head_left", "stream_id", "stream_pos")
    return w.withColumn("rank", F.row_number().over(order))


def segments(words: DataFrame, opens: Column, name: str, key="doc_id", order="pos") -> DataFrame:
    """Number segments from 0; ``opens`` says of a row that a segment begins with it (the first row always does)."""
    w = _by(key, order)
    flag = F.when(F.lag(order).over(w).isNull(), 0).otherwise(opens.cast("int"))
    return words.withColumn("__open", F.coalesce(flag, F.lit(0))).withColumn(name, F.sum("__open").over(w)).drop("__open")


def paragraphs(words: DataFrame, key="doc_id", order="pos") -> DataFrame:
    """``paragraph``: a paragraph ends with a word of relation P or with the stream."""
    return segments(words, F.lag("rel").over(_by(key, order)) == "P", "paragraph", key, order)


def runs(words: DataFrame, name: str = "run", key="doc_id", order="pos") -> DataFrame:
    """Islands of consecutive positions among the rows that are left."""
    w = _by(key, order)
    return segments(words, F.col(order) - F.lag(order).over(w) > 1, name, key, order)


def make_stream(words: DataFrame, key="doc_id", order="pos") -> DataFrame:
    """Chosen words cut from their stream and joined to one of their own: run number and new position."""
    return runs(words, "run", key, order).withColumn("new_pos", (F.row_number().over(_by(key, order)) - 1).cast("long"))


def flow_break(a_prefix: str = "p_", b_prefix: str = "") -> Column:
    """Whether text flow breaks between two left-to-right words: page, direction, or line changes."""
    p = lambda c: F.col(f"{a_prefix}{c}")
    q = lambda c: F.col(f"{b_prefix}{c}")
    return (
        (p("page_id") != q("page_id")) | (p("direction") != q("direction")) | (p("b") <= q("t")) | (q("b") <= p("t"))
        | ((p("cy") <= q("t")) & (p("b") <= q("cy"))) | ((q("cy") <= p("t")) & (q("b") <= p("cy")))
    )


def spaced(a_prefix: str = "p_", b_prefix: str = "", least: Column | None = None) -> Column:
    """Whether two words are set apart: a flow break, overtaking, or a gap of 15 % of their mean height (or ``least``)."""
    p = lambda c: F.col(f"{a_prefix}{c}")
    q = lambda c: F.col(f"{b_prefix}{c}")
    d = q("l") - p("r")
    h = div((p("b") - p("t")) + (q("b") - q("t")), F.lit(2))
    wide = d >= least if least is not None else h * 3 <= d * 20
    return flow_break(a_prefix, b_prefix) | (q("l") < p("cx")) | wide


def with_previous(words: DataFrame, columns=("page_id", "direction", "l", "r", "t", "b", "cx", "cy", "rel", "str"), key="doc_id", order="pos") -> DataFrame:
    w = _by(key, order)
    return words.withColumns({f"p_{c}": F.lag(c).over(w) for c in columns})


def tokens(words: DataFrame, raw: bool = False, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """Merged word runs: ``token_idx, start_offset, value, ws, first_pos, last_pos``.

    A token begins at the stream's start, after relations S and P, and at every
    word in raw mode. Its words are joined, hyphens at relation H dropped. Its
    white space is what separates it from the next token: a line end after P,
    else one space where flow breaks, the line goes back, or words are spaced.
    """
    w = with_previous(words, key=key, order=order)
    opens = F.lit(True) if raw else F.col("p_rel").isin("S", "P")
    w = segments(w, opens, "token_idx", key, order)
    gap = F.col("l") - F.col("p_r")
    mean = div(F.col("p_b") - F.col("p_t") + 7 + F.col("b") - F.col("t") + 7, F.lit(16))
    before = (
        F.when(F.col("p_rel").isNull(), "").when(F.col("p_rel") == "P", "\r\n")
        .when(F.col("p_rel").isin("C", "H") & F.lit(not raw), "")
        .when(flow_break() | (F.col("l") < F.col("p_l")) | spaced() | (mean <= gap), " ").otherwise("")
    )
    w = w.withColumn("before", before)
    part = F.when(F.col("rel") == "H", F.regexp_replace("str", "-$", "")).otherwise(F.col("str"))
    part = F.when(F.lead("token_idx").over(_by(key, order)) == F.col("token_idx"), part).otherwise(F.col("str"))
    w = w.withColumn("part", part)
    inner = F.array_sort(F.collect_list(F.struct(order, "part")))
    t = w.groupBy(key, "token_idx").agg(
        F.array_join(F.transform(inner, lambda x: x["part"]), "").alias("value"), F.min(order).alias("first_pos"),
        F.max(order).alias("last_pos"), F.min_by("before", order).alias("before"),
    )
    by = _by(key, "token_idx")
    t = t.withColumn("ws", F.coalesce(F.lead("before").over(by), F.lit("")))
    size = (F.length("value") + F.length("ws")).cast("long")
    offset = F.coalesce(F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return t.withColumn("start_offset", offset).drop("before")


def token_at(tokens_: DataFrame, offset: int) -> DataFrame:
    """The token that holds a character offset of its document."""
    size = F.length("value") + F.length("ws")
    return tokens_.where((F.col("start_offset") <= offset) & (offset < F.col("start_offset") + size))


def gaps(boxes: DataFrame, low: str, high: str, least: int, key: list[str]) -> DataFrame:
    """``gap_start, gap_end, width`` of stretches no box covers, from 0 on, closed by a box and at least ``least`` wide.

    A running maximum of ends stands for the projection profile; a stretch before
    the first box counts, one after the last doesn't.
    """
    w = Window.partitionBy(*key).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.max(high).over(w), F.lit(0).cast("long"))
    g = boxes.withColumn("gap_start", start).withColumn("gap_end", F.col(low)).withColumn("width", F.col("gap_end") - F.col("gap_start"))
    return g.where((F.col("width") >= least) & (F.col("width") > 0)).select(*key, "gap_start", "gap_end", "width")


def voted_gaps(gaps_: DataFrame, key: list[str], least_count: int = -1) -> DataFrame:
    """Gaps at least as wide as the winning width: that of largest (gaps this wide) times width; ties to the wider."""
    sizes = gaps_.groupBy(*key, "width").count()
    wider = Window.partitionBy(*key).orderBy(F.col("width").desc())
    n = F.sum("count").over(wider)
    score = sizes.withColumn("n", n).where(F.col("n") >= least_count).withColumn("score", F.col("n") * F.col("width"))
    best = score.where("score > 0").groupBy(*key).agg(F.max(F.struct("score", "width")).alias("best"))
    won = best.select(*key, F.col("best.width").alias("least"))
    return gaps_.join(won, key).where("width >= least").drop("least")


def word_blocks(words: DataFrame, least: int, key: list[str]) -> DataFrame:
    """Blocks of neighbouring words on a line: a new block begins where the gap before a word is at least ``least``."""
    w = Window.partitionBy(*key).orderBy("l", "pos")
    opens = (F.col("l") - F.lag("r").over(w)) >= least
    seg = words.withColumn("__o", F.coalesce(opens.cast("int"), F.lit(0))).withColumn("block", F.sum("__o").over(w))
    return seg.groupBy(*key, "block").agg(
        F.min("l").alias("l"), F.max("r").alias("r"), F.min("t").alias("t"), F.max("b").alias("b"), F.count("*").alias("words")
    )


def row_gap_means(lines: DataFrame, key: list[str]) -> DataFrame:
    """Mean gaps between lines within cells and across them (whole numbers); a quarter and half of the mean height where there are none."""
    w = Window.partitionBy(*key).orderBy("t", "n")
    g = lines.withColumns({"gap": F.col("t") - F.lag("b").over(w), "same": F.col("cell") == F.lag("cell").over(w), "height": F.col("b") - F.col("t")})
    mean = lambda cond, part: F.coalesce(
        div(F.sum(F.when(cond, F.col("gap"))), F.count(F.when(cond, F.col("gap")))), div(div(F.sum("height"), F.count("height")), F.lit(part))
    )
    return g.groupBy(*key).agg(mean(F.col("same"), 4).alias("in_cell"), mean(~F.col("same"), 2).alias("across"))


def string_around(words: DataFrame, key="doc_id", order="pos") -> DataFrame:
    """``around``: the whole string that a word belongs to over continue and hyphen links."""
    w = segments(words, F.lag("rel").over(_by(key, order)).isin("S", "P"), "piece", key, order)
    part = F.when(F.col("rel") == "H", F.regexp_replace("str", "-$", "")).otherwise(F.col("str"))
    last = F.lead("piece").over(_by(key, order)).eqNullSafe(F.col("piece"))
    w = w.withColumn("part", F.when(last, part).otherwise(F.col("str")))
    whole = Window.partitionBy(key, "piece").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return w.withColumn("around", F.array_join(F.collect_list("part").over(whole), "")).drop("part", "piece")


def line_bands(words: DataFrame, key=("doc_id", "page_id"), max_words: int = 100_000) -> DataFrame:
    """Reading order of a page: words by centre height are cut into bands, a new one where neither the word's centre
    lies in the height of the band's **first** word nor that one's in the word's; bands are read left to right.

    The break looks back to the band's first word, so this is a fold over a
    page's words, done in the JVM; ``band, place`` come out.
    """
    item = F.struct("cy", "cx", "pos", "t", "b")
    page = words.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(
        F.lit(-1).alias("band"), F.lit(0).cast("long").alias("cy"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("b"),
        F.array().cast("array<int>").alias("out"),
    )

    def step(acc, x):
        apart = (acc["band"] < 0) | ~(((x["cy"] >= acc["t"]) & (x["cy"] < acc["b"])) | ((acc["cy"] >= x["t"]) & (acc["cy"] < x["b"])))
        band = F.when(apart, acc["band"] + 1).otherwise(acc["band"])
        keep = lambda c: F.when(apart, x[c]).otherwise(acc[c]).alias(c)
        return F.struct(band.alias("band"), keep("cy"), keep("t"), keep("b"), F.concat(acc["out"], F.array(band)).alias("out"))

    bands = F.aggregate("items", start, step, lambda acc: acc["out"])
    rows = page.select(*key, F.explode(F.arrays_zip("items", bands.alias("bands"))).alias("z"))
    rows = rows.select(*key, F.col("z.items.pos").alias("pos"), F.col("z.items.cx").alias("cx"), F.col("z.bands").alias("band"))
    w = Window.partitionBy(*key).orderBy("band", "cx", "pos")
    return rows.withColumn("place", (F.row_number().over(w) - 1).cast("long")).select(*key, "pos", F.col("band").cast("long").alias("band"), "place")


def interleaved(words: DataFrame, level: str = "paragraphs") -> DataFrame:
    """Words of several streams of a document in the order of a normalisation level.

    streams: whole streams by their heads; paragraphs: paragraph by paragraph,
    the stream whose next paragraph starts first (page, top, left) goes next;
    words: the same by runs between relations S and P; raw: word by word.
    Which stream goes next depends on what was taken before, so each document is
    merged in one pass by a function over its (stream-ordered) units.
    """
    if level == "streams":
        return stream_order(words).select("doc_id", "stream_id", "stream_pos", (F.col("rank") - 1).cast("long").alias("place"))
    key = ["doc_id", "stream_id"]
    prev = F.lag("rel").over(_by(key, "stream_pos"))
    opens = {"raw": F.lit(True), "words": prev.isin("S", "P"), "paragraphs": prev == "P"}[level]
    units = segments(words, opens, "unit", key, "stream_pos")
    heads = units.groupBy("doc_id", "stream_id", "unit").agg(
        F.min_by(F.struct("page_id", "t", "l"), "stream_pos").alias("h"), F.min("stream_pos").alias("first"), F.count("*").alias("n")
    ).select("doc_id", "stream_id", "unit", "h.*", "first", "n")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in heads.schema if f.name in ("doc_id", "stream_id")) + ", unit long, at long"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        queues = {s: list(g.sort_values("unit")[["page_id", "t", "l", "unit", "n"]].itertuples(index=False)) for s, g in pdf.groupby("stream_id")}
        heap = [((q[0].page_id, q[0].t, q[0].l), s, 0) for s, q in queues.items()]
        heapq.heapify(heap)
        out, at = [], 0
        while heap:
            _, s, i = heapq.heappop(heap)
            u = queues[s][i]
            out.append((pdf["doc_id"].iloc[0], s, u.unit, at))
            at += u.n
            if i + 1 < len(queues[s]):
                v = queues[s][i + 1]
                heapq.heappush(heap, ((v.page_id, v.t, v.l), s, i + 1))
        return pd.DataFrame(out, columns=["doc_id", "stream_id", "unit", "at"])

    places = heads.groupBy("doc_id").applyInPandas(merge, schema)
    joined = units.join(places, ["doc_id", "stream_id", "unit"]).join(heads.select("doc_id", "stream_id", "unit", "first"), ["doc_id", "stream_id", "unit"])
    return joined.select("doc_id", "stream_id", "stream_pos", (F.col("at") + F.col("stream_pos") - F.col("first")).alias("place"))
