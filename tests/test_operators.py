"""Hand-made fixtures for operators and edge cases that the driver's tables don't reach."""

import random

from pyspark.sql import functions as F

from quirework.functions import geometry, ids
from quirework.functions import text as tx
from quirework.operators import aggregates, captions, glyphs, intervals, quality, spatial, streams, styles, tables
from quirework.sources import formats
from quirework.streaming import changes


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, *exprs):
    return spark.range(1).select(*exprs).first()


def words(spark, items):
    """items: doc, page, pos, l, r, t, b, str, rel."""
    df = spark.createDataFrame(items, "doc_id long, page_id long, pos long, l long, r long, t long, b long, str string, rel string")
    return df.withColumns({"cx": F.expr("(l + r) div 2"), "cy": F.expr("(t + b) div 2"), "direction": F.lit("lr"), "line": F.expr("t div 30"), "font_size": F.lit(10), "bold": F.lit(False)})


def test_box_edges_are_open(spark):
    w = words(spark, [(1, 0, 0, 0, 10, 0, 10, "in", "S"), (1, 0, 1, 15, 25, 0, 10, "edge", "S"), (1, 0, 2, 5, 10, 15, 25, "low", "S")])
    box = spark.createDataFrame([(1, 0, 0, 0, 20, 0, 20)], "doc_id long, page_id long, n long, l long, r long, t long, b long")
    assert rows(spatial.words_inside(w, box), "str") == [("in",)]
    assert rows(spatial.binned_words_inside(w, box, 7), "str") == [("in",)]
    assert rows(spatial.words_outside_all(w, box), "str") == [("edge",), ("low",)]


def test_binned_join_equals_plain(spark):
    random.seed(3)
    w = words(spark, [(random.randrange(3), 0, i, x := random.randrange(500), x + 10, y := random.randrange(500), y + 10, "w", "S") for i in range(300)])
    boxes = spark.createDataFrame([(random.randrange(3), 0, i, x := random.randrange(400), x + random.randrange(1, 150), y := random.randrange(400), y + random.randrange(1, 150)) for i in range(40)], "doc_id long, page_id long, n long, l long, r long, t long, b long")
    assert rows(spatial.words_inside(w, boxes), "pos", "o_n") == rows(spatial.binned_words_inside(w, boxes, 64), "pos", "o_n")


def test_interval_joins_equal_all_pairs(spark):
    random.seed(4)
    data = [(random.randrange(3), x := random.randrange(200), x + random.randrange(90), i) for i in range(80)] + [(1, 31, 32, 80), (1, 32, 32, 81), (1, 0, 63, 82)]
    spans = spark.createDataFrame(data, "doc_id long, first_pos long, last_pos long, k long")
    tokens = spans.select("doc_id", F.col("first_pos").alias("start"), F.col("last_pos").alias("end"), "k")
    pairs = [(a, q) for a in data for q in data if a[0] == q[0]]
    of = lambda test: sorted((a[3], q[3]) for a, q in pairs if test(a, q))
    assert rows(intervals.overlapping(spans, spans), "k", "q_k") == of(lambda a, q: a[2] >= q[1] and a[1] <= q[2])
    assert rows(intervals.spanning(spans, spans), "k", "q_k") == of(lambda a, q: a[1] <= q[1] and q[2] <= a[2])
    assert rows(intervals.inside(tokens, tokens), "k", "q_k") == of(lambda a, q: q[1] <= a[1] <= q[2] - 1 and q[1] + 1 <= a[2] <= q[2])


def test_gaps_and_vote(spark):
    boxes = spark.createDataFrame([(1, 5, 10), (1, 15, 20), (1, 29, 30), (1, 39, 50), (1, 41, 45)], "k long, lo long, hi long")
    g = streams.gaps(boxes, "lo", "hi", 1, ["k"])
    assert rows(g, "gap_start", "gap_end") == [(0, 5), (10, 15), (20, 29), (30, 39)]  # a leading gap counts, a trailing one can't
    assert rows(streams.voted_gaps(g, ["k"]), "width") == [(5,), (5,), (9,), (9,)]  # 4 * 5 beats 2 * 9
    tie = spark.createDataFrame([(1, 0, 4, 4), (1, 6, 8, 2)], "k long, gap_start long, gap_end long, width long")
    assert rows(streams.voted_gaps(tie, ["k"]), "width") == [(4,)]  # 1 * 4 ties with 2 * 2: the wider wins
    assert streams.voted_gaps(tie, ["k"], 5).count() == 0


def test_gaps_equal_projection_profile(spark):
    random.seed(5)
    data = [(k, x := random.randrange(100), x + random.randrange(1, 12)) for k in range(20) for _ in range(8)]
    got = rows(streams.gaps(spark.createDataFrame(data, "k long, lo long, hi long"), "lo", "hi", 2, ["k"]), "k", "gap_start", "gap_end")
    want = []
    for k in range(20):
        ink = set()
        for q, a, b in data:
            if q == k:
                ink |= set(range(a, b))
        at = 0
        for x in sorted(ink):
            if x - at >= 2:
                want.append((k, at, x))
            at = x + 1
    assert got == sorted(want)


def test_relations_and_tokens(spark):
    w = words(spark, [(1, 0, 0, 0, 30, 0, 20, "exam-", "H"), (1, 0, 1, 0, 30, 30, 50, "ple", "S"), (1, 0, 2, 60, 90, 30, 50, "ends.", "P"), (1, 0, 3, 0, 30, 60, 80, "New", "C"), (1, 0, 4, 31, 50, 60, 80, "ly-", "H")])
    t = streams.tokens(w)
    assert rows(t, "token_idx", "value", "ws", "start_offset") == [(0, "example", " ", 0), (1, "ends.", "\r\n", 8), (2, "Newly-", "", 15)]
    from quirework.operators import text as otext

    assert [r.text for r in otext.concatenated(w, ["doc_id"]).collect()] == ["example ends.\r\nNewly-"]
    assert rows(streams.paragraphs(w).groupBy("paragraph").count(), "paragraph", "count") == [(0, 3), (1, 2)]


def test_streams_from_links(spark):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("y", "z"), ("z", "y")], "word_id string, prev_id string")
    assert rows(streams.number_streams(links), "word_id", "stream_id", "stream_pos") == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("x", "x", 0)]


def test_line_bands_look_at_the_first_word(spark):
    w = words(spark, [(1, 0, 0, 50, 60, 0, 20, "b", "S"), (1, 0, 1, 0, 10, 8, 28, "a", "S"), (1, 0, 2, 20, 30, 19, 39, "c", "S")])
    # the second word's centre is in the first's height; the third's is in the second's only, and opens a band
    assert rows(streams.line_bands(w), "pos", "band", "place") == [(0, 0, 1), (1, 0, 0), (2, 1, 2)]


def test_wrapped_spans_have_no_box(spark):
    w = words(spark, [(1, 0, 0, 50, 60, 0, 20, "a", "S"), (1, 0, 1, 0, 10, 30, 50, "b", "S"), (2, 0, 0, 0, 10, 0, 20, "a", "S"), (2, 0, 1, 20, 30, 0, 20, "b", "S")])
    assert rows(aggregates.span_boxes(w, ["doc_id"]).where("l is not null"), "doc_id", "l", "r") == [(2, 0, 30)]


def test_connected_tables_and_cycles(spark):
    links = spark.createDataFrame([(1, 5, 7), (1, 7, 9), (1, 9, None), (2, 1, 2), (2, 2, 1), (2, 4, None)], "doc_id long, table_id long, next_id long")
    assert rows(tables.connected(links), "doc_id", "table_id", "chain", "place") == [(1, 5, 5, 0), (1, 7, 5, 1), (1, 9, 5, 2), (2, 1, 1, 0), (2, 2, 1, 1), (2, 4, 4, 0)]


def _grid(spark):
    return spark.createDataFrame(
        [(1, 1, r, c, c * 10, c * 10 + 10, r * 10, r * 10 + 10, "m" if r < 2 and c < 2 else f"{r}-{c}", "A & \"B\"" if r < 2 and c < 2 else f"{r}{c}") for r in range(3) for c in range(3)],
        "doc_id long, table_id long, row long, col long, l long, r long, t long, b long, cell_id string, text string",
    )


def test_grid_csv_and_xml(spark):
    g = _grid(spark)
    assert rows(tables.grid(g).where("opens and row_span > 1"), "row", "col", "row_span", "col_span") == [(0, 0, 2, 2)]
    csv = tables.separated(g).first().data.split("\r\n")
    assert csv[0] == '"A & ""B""","A & ""B""","02"'
    x = tables.xml(g).first().data
    assert x.startswith('<table><tr><th colspan="2" rowspan="2">A &amp; &quot;B&quot;</th><th>02</th></tr><tr><td>12</td>')
    assert tables.separated(g, "\t").first().data.split("\r\n")[2] == "20\t21\t22"


def test_cells_prefer_existing(spark):
    key = "doc_id long, table_id long, n long, low long, high long"
    r, c = spark.createDataFrame([(1, 1, 0, 0, 10), (1, 1, 1, 10, 20)], key), spark.createDataFrame([(1, 1, 0, 0, 10), (1, 1, 1, 10, 20)], key)
    old = spark.createDataFrame([(1, 1, 0, 20, 0, 10, "wide"), (1, 1, 0, 10, 10, 20, "same"), (1, 1, 90, 99, 90, 99, "stray")], "doc_id long, table_id long, l long, r long, t long, b long, cell_id string")
    got = tables.cells(r, c, old)
    assert rows(got, "row", "col", "cell_id") == [(0, 0, "wide"), (0, 1, "wide"), (1, 0, "same"), (1, 1, "10,20,10,20")]
    assert rows(tables.spurious(old, got), "cell_id") == [("stray",)]


def test_merging_and_splitting(spark):
    key = "doc_id long, table_id long, n long, low long, high long"
    b = spark.createDataFrame([(1, 1, i, i * 10, i * 10 + 8) for i in range(4)], key)
    assert rows(tables.merge_bands(b, F.col("n").isin(1, 2)), "n", "low", "high") == [(0, 0, 8), (1, 10, 28), (2, 30, 38)]
    w = words(spark, [(1, 0, i, x, x + 4, 0, 10, "w", "S") for i, x in enumerate((0, 3, 12, 22))]).withColumn("table_id", F.lit(1).cast("long"))
    band = spark.createDataFrame([(1, 1, 0, 0, 30)], key)
    assert rows(tables.split_band(w, band, "x", 10, 20), "part", "low", "high") == [(0, 0, 7), (1, 12, 16), (2, 22, 26)]
    assert rows(tables.split_band(w, band, "x", 40, 50), "part", "low", "high") == [(0, 0, 30)]
    area = spark.createDataFrame([(1, 1, 15, 25, 5, 9)], "doc_id long, table_id long, l long, r long, t long, b long")
    m = tables.merge_cells(_grid(spark), area)
    assert m.where("row = 0 and col > 0").select("cell_id").distinct().count() == 1
    s = tables.split_cells(_grid(spark))
    assert s.select("cell_id").distinct().count() == 9 or s.count() == 9


def test_labels_and_compatibility(spark):
    data = [(1, t, r, 0, x) for t, ls in ((1, ["q", "a", "b"]), (2, ["z", "a", "b"]), (3, ["q", "a", "c"])) for r, x in enumerate(ls)]
    c = spark.createDataFrame(data, "doc_id long, table_id long, row long, col long, text string")
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "doc_id long, table_id long, other_id long")
    assert rows(tables.compatible(tables.labels(c, "row"), pairs), "table_id", "other_id") == [(1, 2)]


def test_header_rows(spark):
    c = spark.createDataFrame([(1, 1, r, 0, r in (1, 3)) for r in range(4)], "doc_id long, table_id long, row long, col long, marked boolean")
    assert [r.is_header for r in tables.header_rows(c).orderBy("row").collect()] == [True, True, False, False]
    two = c.where("row < 2").withColumn("marked", F.lit(False))
    assert [r.is_header for r in tables.header_rows(two, view=True).orderBy("row").collect()] == [False, False]


def test_caption_rules(spark):
    box = "doc_id long, page_id long, n long, l long, r long, t long, b long"
    caps = spark.createDataFrame([(1, 0, 1, 0, 100, 0, 20, "Table", False), (1, 0, 2, 0, 100, 40, 60, "Tab.", False), (1, 0, 3, 0, 100, 300, 320, "Fig.", False), (1, 0, 4, 0, 100, 310, 330, "Table", False)], box + ", first_word string, in_line boolean")
    target = spark.createDataFrame([(1, 0, 9, 0, 100, 100, 210, "table")], box + ", type string")
    assert rows(captions.find_captions(caps, target, 100), "side", "n") == [("above", 2), ("below", 4)]
    shifted = target.withColumn("l", F.lit(21).cast("long")).withColumn("r", F.lit(121).cast("long"))
    assert captions.find_captions(caps, shifted, 100).count() == 0  # 79 % of the smaller extent
    assert captions.find_captions(caps.where("n = 4"), target, 99).count() == 0


def test_annotations(spark):
    a = spark.createDataFrame([(1, "x", 1, {"k": "1"}, 0, 5), (1, "x", 2, {"k": "2", "m": "3"}, 0, 5)], "doc_id long, ann_id string, create_no long, attrs map<string,string>, first_pos long, last_pos long")
    r = intervals.merged(a).first()
    assert r.attrs == {"k": "1", "m": "3"} and r.create_no == 1
    runs = spark.createDataFrame([(1, p, c) for p, c in enumerate("aabbc")], "doc_id long, pos long, cell string")
    ann = spark.createDataFrame([(1, "y", "t", 1, 0, 4)], "doc_id long, ann_id string, type string, create_no long, first_pos long, last_pos long")
    for mode, want in (("split", [(0, 1), (2, 3), (4, 4)]), ("remove", []), ("cutToStart", [(0, 1)]), ("cutToEnd", [(4, 4)])):
        assert rows(intervals.resolve_cells(ann, runs, mode), "first_pos", "last_pos") == want
    cut = spark.createDataFrame([(1, 2, 3)], "doc_id long, cut_first long, cut_last long")
    pieces = spark.createDataFrame([(1, 0, 2), (1, 3, 9), (1, 0, 9), (1, 2, 3)], "doc_id long, first_pos long, last_pos long")
    assert rows(intervals.cut_at(pieces, cut), "first_pos", "last_pos", "new_first", "new_last") == [(0, 2, 0, 1), (0, 9, 0, 9), (2, 3, 2, 3), (3, 9, 4, 9)]


def _java_hash(s):
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h


def test_ids(spark):
    for name in ("paragraph", "table", "word"):
        assert one(spark, ids.name_hash(F.lit(name)))[0] == _java_hash(name)
    b = geometry.Box(*[F.lit(v) for v in (1, 2, 3, 65536 + 4)])
    uid = one(spark, ids.local_uid(F.lit("paragraph"), F.lit(7), F.lit(-1), b))[0]
    assert uid == f"{_java_hash('paragraph'):08X}0007FFFF0001000300020004"
    doc = "0123456789ABCDEF0123456789ABCDEF"
    assert one(spark, ids.uuid(F.lit(uid), F.lit(doc)))[0] == f"{int(uid, 16) ^ int(doc, 16):032X}"
    assert one(spark, ids.document_key(F.lit(12)))[0] == f"{_java_hash('12'):08X}" * 4


def test_scalars(spark):
    s = lambda e: one(spark, e)[0]
    assert s(tx.fix_number(F.lit(". 25"))) == "0.25" and s(tx.fix_number(F.lit("1.25"))) == "1.25"
    assert s(tx.csv_cell(F.lit('a"b'))) == '"a""b"' and s(tx.csv_cell(F.lit("a"), "\t")) == "a" and s(tx.csv_cell(F.lit(None), "\t")) == '""'
    assert s(tx.normalise(F.lit("café–ß"))) == "cafe-ss"
    assert s(geometry.scale(F.lit(10), 72, 100)) == 14 and s(geometry.scale(F.lit(10), 72, 100, "F")) == 13 and s(geometry.scale(F.lit(10), 72, 100, "C")) == 14
    assert s(geometry.turned(F.lit(None).cast("string"), True)) == "td" and s(geometry.turned(F.lit("lr"), False)) == "bu"
    assert s(geometry.parse_box(F.lit("[1,2,3,4]"))[3]) == 4 and s(geometry.parse_box(F.lit("[1,2]"))[0]) is None
    assert s(tx.has_style(F.lit(5), tx.SERIF)) and s(tx.with_style(F.lit(5), tx.BOLD, False)) == 4
    assert formats.ocr_languages("deu+ENG+fra+eng") == ["eng", "deu", "fra"]


def test_protocol_round_trip(spark):
    lines = ["CATEGORY\tc\tC\td", "TYPE\tt\tT\td", "ERROR\tmajor\tbad\tme\tword\tw\tid\t1\t2\tf\tl", "ERROR\tworse\tme\tword\tw\tid\t3\t3\tf\tl", "FALPOS\tminor\tno\tme\tword\tw\tid\t1\t1\tf\tl", "ERROR\tshort"]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "file string, at int, line string")
    e = quality.parse_protocol(df)
    assert rows(e, "severity", "page_id", "false_positive") == [("critical", 3, False), ("major", 1, False), ("minor", 1, True)]
    text = [r.line for r in quality.write_protocol(e).collect()]
    assert [t.split("\t")[0] for t in text] == ["CATEGORY", "TYPE", "ERROR", "ERROR", "FALPOS"]
    again = quality.parse_protocol(spark.createDataFrame([("p", i, x) for i, x in enumerate(text)], "file string, at int, line string"))
    assert rows(again, "severity", "description", "page_id") == rows(e, "severity", "description", "page_id")


def test_origin(spark):
    p = spark.createDataFrame([(1, True, 9, 9, 0), (2, False, 9, 9, 0), (3, True, 9, 1, 0), (4, True, 9, 9, 8)], "doc_id long, has_scan boolean, words long, font_words long, vector_words long")
    got = dict(rows(aggregates.document_origin(p), "doc_id", "origin"))
    assert got == {1: aggregates.DIGITISED_OCR, 2: 65536 + aggregates.BORN_DIGITAL, 3: aggregates.OCR, 4: aggregates.VECTORISED_OCR}


def test_glyphs(spark):
    g = spark.createDataFrame([(1, "00666600", 4), (2, "06666000", 4), (3, "FFFFFFFF", 4)], "glyph_id long, image string, width int")
    assert [(r.a, r.b, r.sim) for r in glyphs.similar_pairs(g, 0.5).collect()] == [(1, 2, 1.0)]
    m = g.where("glyph_id = 1").select(*glyphs.margins(F.col("image"), F.col("width"))).first()
    assert tuple(m) == (2, 2, 1, 1)
    assert one(spark, glyphs.from_bits(glyphs.bits(F.lit("0A5F"))))[0] == "0A5F"
    v = spark.createDataFrame([("a", "x", 1), ("b", "x", 3), ("b", "y", 1), ("c", "x", 2), ("c", "y", 1), ("d", "x", 9), ("d", "y", 1), ("d", "z", 1)], "image string, str string, n long")
    assert rows(glyphs.vote(v), "image", "str") == [("a", "x"), ("b", "x"), ("d", "x")]
    lines = spark.createDataFrame([("0A\tx 3\ty 1",), ("DISCARD\tq 1",), ("0B\tDISCARD",)], "value string")
    assert rows(glyphs.read_glyphs(lines), "image", "str", "n") == [("0A", "x", 3), ("0A", "y", 1)]
    assert glyphs.ink_distance("80000000", 4)[3].tolist() == [3, 4, 5, 6]


def test_styles_and_formats(spark):
    p = styles.parameters(spark.createDataFrame([("a.b = 1",), ("// no = 2",), ("a.c=[1,2,3,4]",)], "value string"))
    assert rows(styles.subset(p, "a"), "key", "value") == [("b", "1"), ("c", "[1,2,3,4]")]
    page = spark.createDataFrame([(1, "<p><span class='ocrx_word' id='w' title='bbox 1 2 30 40; x_wconf 9'>He<b>y</b></span></p>")], "page_id long, html string")
    assert rows(formats.ocr_words(page), "l", "r", "t", "b", "str") == [(1, 30, 2, 40, "Hey")]


def test_entity_folder_round_trip(spark, tmp_path):
    w = words(spark, [(1, 0, 0, 0, 30, 0, 20, "a", "S"), (2, 0, 0, 0, 30, 0, 20, "b", "S")])
    formats.store({"words": w}, str(tmp_path))
    assert rows(formats.load(spark, str(tmp_path), ("words",))["words"], "doc_id", "str") == [(1, "a"), (2, "b")]


def test_changes_as_stream(spark, tmp_path):
    schema = changes.EVENT
    data = [(1, "2026-01-01 00:00:00", 1, "attribute", "7", "str", None, "x"), (2, "2026-01-01 00:00:01", 1, "attribute", "7", "str", "x", "y"), (3, "2026-01-01 00:00:02", 1, "remove", "8", "str", "q", None)]
    df = spark.createDataFrame(data, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(changes.latest(df), "object_id", "value", "changes") == [("7", "y", 2)]
    df.write.parquet(str(tmp_path / "in"))
    stream = changes.stateful(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("changed").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.object_id, r.value, r.changes) for r in spark.table("changed").collect()}
    assert ("7", "y", 2) in got and ("8", None, 1) in got
    w = words(spark, [(1, 0, 7, 0, 30, 0, 20, "old", "S"), (2, 0, 7, 0, 30, 0, 20, "b", "S")])
    assert rows(changes.touched_documents(df, w), "doc_id", "str") == [(1, "y")]


def test_stream_scope(spark):
    from quirework.operators import edits

    w = spark.createDataFrame([(t,) for t in ("mainText", "table", "caption", "footnote", "pageTitle", "label", "artifact", "deleted", None)], "stream_type string")
    kept = lambda flags: {r.stream_type for r in edits.in_scope(w, flags).collect()}
    assert kept(0) == {"mainText", "table", "caption", "footnote", "pageTitle", "label", "artifact", None}
    assert kept(3 | edits.NO_TABLES | edits.NO_CAPTIONS | edits.LABELS) == {"mainText", "label", None}


def test_edits(spark):
    from quirework.operators import edits

    w = words(spark, [(1, 0, i, i * 10, i * 10 + 8, 0, 20, s, r) for i, (s, r) in enumerate((("a", "S"), ("b", "P"), ("c", "S"), ("d", "S")))])
    e = spark.createDataFrame([(1, 1, None, None), (1, 2, "C", None)], "doc_id long, pos long, new_str string, new_rel string")
    out = edits.rewrite(w, e)
    assert rows(out, "pos", "new_pos", "str", "rel") == [(0, 0, "a", "P"), (2, 1, "C", "S"), (3, 2, "d", "S")]
    ann = spark.createDataFrame([(1, "t:0-2", "t", 0, 2), (1, "t:1-3", "t", 1, 3)], "doc_id long, ann_id string, type string, first_pos long, last_pos long")
    assert rows(edits.carry_annotations(ann, out), "ann_id", "new_first", "new_last") == [("t:0-2", 0, 1)]
    named = spark.createDataFrame([(1, "t:0-2", "u")], "doc_id long, ann_id string, new_type string")
    assert rows(edits.change_annotations(ann, renamed=named, removed=ann.where("first_pos = 1"), added=ann), "ann_id", "type") == [("t:0-2", "t"), ("t:1-3", "t"), ("u:0-2", "u")]
    boxes = spark.createDataFrame([(1, 0, 1, 10, 19, 0, 20), (1, 0, 2, 0, 9, 0, 20)], "doc_id long, page_id long, n long, l long, r long, t long, b long")
    assert rows(edits.carry_regions(boxes, out), "n") == [(2,)]


def test_edit_scripts():
    from quirework.operators.edits import apply_script, edit_script

    assert edit_script("kitten", "sitting").count("K") == 4 and edit_script("", "ab") == "II" and edit_script("ab", "") == "DD"
    assert apply_script(["ab", "cd"], edit_script("abcd", "ad"), "ad") == ["a", "d"]


def test_attributes_and_hooks(spark):
    from quirework.functions import attributes
    from quirework.plans import hooks

    d = spark.createDataFrame([(1, 2, {"note": "x"})], "doc_id long, page_id long, attrs map<string,string>")
    r = d.select(attributes.attribute(d, "pageId").alias("p"), attributes.attribute(d, "note").alias("n"), attributes.attribute(d, "gone", "-").alias("g"), attributes.names_of(d).alias("all")).first()
    assert (r.p, r.n, r.g, r["all"]) == ("2", "x", "-", ["documentId", "note", "pageId"])
    assert attributes.set_attributes(d, {"note": "y", "k": "v"}, replace=False).first().attrs == {"note": "x", "k": "v"}
    assert attributes.remove_attributes(d, "note").first().attrs == {}
    assert spark.range(1).select(hooks.tokenized(F.lit("It's 1,000 (co-op).")).alias("t")).first().t == ["It's", "1,000", "(", "co-op", ")", "."]

    @hooks.image_store("none", 5)
    def none(pages):
        return pages.where("false").withColumn("payload", F.lit(b""))

    @hooks.image_store("all", 1)
    def every(pages):
        return pages.withColumn("payload", F.lit(b"i"))

    assert bytes(hooks.page_images(d.drop("attrs")).first().payload) == b"i"


def test_headers(spark):
    from quirework.operators import headers

    data = [(1, t, s, i * 10, i * 10 + 8, 0, 10) for t, ss in ((1, ("Name", "Year")), (2, ("name", "YEAR")), (3, ("City", "Zone"))) for i, s in enumerate(ss)]
    w = spark.createDataFrame(data, "doc_id long, table_id long, str string, l long, r long, t long, b long")
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "doc_id long, table_id long, other_id long")
    assert rows(headers.matches(w, pairs), "other_id", "matches") == [(2, True), (3, False)]
    ext = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 1000, 1200)], "doc_id long, table_id long, low long, high long")
    b = ext.withColumn("n", F.lit(0).cast("long"))
    cut = spark.createDataFrame([(1, 25)], "doc_id long, at long")
    assert rows(headers.split_relative(b, ext, 1, cut), "table_id", "low", "high") == [(1, 0, 25), (1, 25, 100), (2, 1000, 1050), (2, 1050, 1200)]


def test_glyph_clusters(spark):
    p = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 5, 0.7), (3, 4, 0.1)], "a long, b long, sim double")
    assert rows(glyphs.clusters(p), "glyph", "cluster") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_streaming_windows_and_listener(spark, tmp_path):
    data = [(i, f"2026-01-01 00:{m:02d}:00", "click") for i, m in enumerate((0, 1, 6, 7, 30))]
    df = spark.createDataFrame(data, "event_id long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = changes.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "5 minutes", watermark="1 minute")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2, 2]
    assert rows(changes.tumbling(df, "5 minutes"), "n") == [(1,), (2,), (2,)]
    seen = []
    q = changes.listen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b, i: seen.append(b.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 5


def test_rho_shaped_links_end(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("h", None), ("i", "h")], "word_id string, prev_id string")
    assert rows(streams.number_streams(links), "word_id", "stream_id", "stream_pos") == [("h", "h", 0), ("i", "h", 1)]


def test_similar_glyphs_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(12)
    base = rng.integers(0, 256, (8, 8), dtype=np.uint8)
    data = []
    for i in range(40):
        x = base[i % 8].copy()
        x[rng.integers(0, 8)] ^= 1 << rng.integers(0, 8)
        data.append((i, x.tobytes().hex().upper(), 8))
    got = {(r.a, r.b): r.sim for r in glyphs.similar_pairs(spark.createDataFrame(data, "glyph_id long, image string, width int"), 0.7).collect()}
    maps = [glyphs._bitmap(im, w) for _, im, w in data]
    size = [tuple(np.ptp(np.nonzero(m), axis=1)) for m in maps]
    want = {}
    for a in range(40):
        for b in range(a + 1, 40):
            s = glyphs.similarity(maps[a], maps[b])
            if s >= 0.7 and all(abs(int(p) - int(q)) <= 2 for p, q in zip(size[a], size[b])):
                want[a, b] = s
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(got) > 40


def test_best_vectors_equal_brute_force(spark):
    """Copies, repeated ids, odd components and several blocks a key against all pairs; no row is made for a pair."""
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (60, 3)).astype(float).tolist()
    data = [(i, i % 2, [float(x) / 4 for x in v[i % 40]]) for i in range(60)]
    data += [(100, 0, v[0]), (100, 0, v[1]), (100, 1, v[2]), (101, 0, v[0]), (102, 0, None), (103, 0, []), (104, 0, [1.0, None, 2.0]), (105, 0, [1.0])]
    data += [(106, 2, [math.nan, 1.0]), (107, 2, [math.inf, -1.0]), (108, 2, [2.0, 1.0]), (109, 2, [2.0 + 1e-10, 1.0]), (110, 2, [2.0, 1.0]), (111, 3, [1.0]), (112, None, [1.0]), (None, 2, [9.0, 9.0])]

    def sim(x, y):
        both = [(p, q) for p, q in zip(x or [], y or []) if p is not None and q is not None]
        return round(sum((p * q for p, q in both), 0.0), 9) if both else None

    def rank(s):
        return (0, 0) if s is None else (2, 0) if math.isnan(s) else (1, s)

    want = {}
    for a, k, x in data:
        for b, m, y in data:
            if None not in (a, b, k) and k == m and a != b:
                s = sim(x, y)
                t = (rank(s), -b)
                if a not in want or t > want[a]:
                    want[a] = t
    d = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    for least, most in ((512, 4096), (3, 8), (1, 1)):
        got = {r.a: (rank(r.sim), -r.b) for r in glyphs.best_of_vectors(d, least=least, most=most).collect()}
        assert {a: t[1] for a, t in got.items()} == {a: t[1] for a, t in want.items()}
        assert all(got[a][0] == want[a][0] for a in want)


def test_best_matches_make_no_rows_for_pairs(spark, sf):
    from quirework.plans.queries import QUERIES

    plan = QUERIES["glyph_mutual_best"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "FlatMapGroupsInArrow" in plan


def test_similar_classes_hold_all_pairs(spark):
    """Classes and links give the pairs of all glyphs, and the copies of a bitmap are one row each."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (2, 8), dtype=np.uint8)
    kinds = []
    for i in range(12):
        x = base[i % 2].copy()
        x[rng.integers(0, 8)] ^= 1 << rng.integers(0, 8)
        kinds.append(x.tobytes().hex().upper())
    data = [(i, kinds[i * i % 12], 8) for i in range(60)] + [(60, kinds[0], 16), (7, kinds[1], 8), (61, "00" * 8, 8), (62, "00" * 8, 8), (63, None, 8), (None, kinds[0], 8), (64, "00" * 8 + "F", 8), (65, "001", 5), (66, "002", 5), (67, "004", 5), (68, "0040", 5), (69, "", 8)]
    d = spark.createDataFrame(data, "glyph_id long, image string, width int")
    want = {(r.a, r.b, round(r.sim, 12)) for r in glyphs.similar_pairs(d, 0.7).collect()}
    out = glyphs.similar_classes(d, 0.7).collect()
    member = {}
    for r in out:
        if r.other is None:
            member.setdefault(r["class"], []).append(r.glyph_id)
    got = {(a, b, 1.0) for ids in member.values() for a in ids for b in ids if a < b}
    for r in out:
        if r.other is not None:
            got |= {(min(a, b), max(a, b), round(r.sim, 12)) for a in member[r["class"]] for b in member[r.other] if a != b}
    assert got == want and len(want) > 200 and any(s < 1 for *_, s in want)


def test_copies_of_a_name_grow_no_pairs(spark, tmp_path):
    from quirework.plans.queries import QUERIES

    names = ["old plate", "old plates", "hot gear"]
    spark.range(3000).select(F.col("id").alias("p_partkey"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 3 + 1).cast("int")).alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    out = QUERIES["glyph_similarity"](spark, str(tmp_path)).collect()
    assert sorted(r.glyph_id for r in out if r.glyph_id is not None) == list(range(3000)) and len(out) <= 3000 + 3
    assert len({r["class"] for r in out if r.glyph_id is not None}) == 3
