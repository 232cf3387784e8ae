"""The llm operators against brute force, round trips and held-out accuracy, and their defined edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quirework.llm import apportion, decontaminate, feistel_shards, hnsw, line_templates, main_text, ppm_langid, private_data
from quirework.llm import simhash_dedup, warc
from quirework.llm.common import connected_components, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns whose names the operators use themselves
EXTRA = DOCS + ", size long, shard int, fp long, score double, base string, __row long, key string, u long, __h string, __uid long, __p long, __key string, __times int, __found string, times int, s string, c0 string"


def docs(spark, items, schema=DOCS):
    width = len(schema.split(", "))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in items], schema)


def frame(df, key="doc_id"):
    return df.toPandas().sort_values(key, kind="stable").reset_index(drop=True)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "x" * 50_000), (6, "the same text here"), (7, "the same text here"), (7, "the same text here"), (None, "a text without an id"), (8, "ü😀 é")]


@pytest.mark.parametrize("run", [
    feistel_shards.shard_documents, feistel_shards.shard_rows, apportion.mix_documents, apportion.mix_rows, ppm_langid.identify,
    ppm_langid.keep_identified, simhash_dedup.near_duplicates, simhash_dedup.keep_one, private_data.personal_data,
    private_data.sanitise, line_templates.drop_templates,
    lambda d: decontaminate.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    lambda d: decontaminate.drop_contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
])
def test_odd_rows_empty_tables_and_clashing_columns(spark, run):
    assert run(docs(spark, [])).count() == 0
    plain, wide = run(docs(spark, ODD)), run(docs(spark, ODD, EXTRA))
    values = lambda df: sorted(map(str, df.select(*[F.col(f"`{c}`") for c in plain.columns]).collect()))
    assert values(wide) == values(plain)
    names = [x.split()[0] for x in EXTRA.split(", ")]
    if set(DOCS.replace(" long", "").replace(" string", "").split(", ")) <= set(plain.columns):  # a stage: all columns stay
        assert set(names) <= set(wide.columns)


def test_row_counts_on_odd_rows(spark):
    d = docs(spark, ODD)
    for run in (feistel_shards.shard_documents, apportion.mix_documents, ppm_langid.identify, simhash_dedup.near_duplicates, private_data.personal_data, line_templates.drop_templates):
        assert run(d).count() == len(ODD)


# ---- 1: decontamination


def _edit(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_best_substring_is_exact():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (12, 40))
        assert decontaminate.best_substring(a, b)[0] == _edit(a, b)


def test_decontamination_recall_and_precision():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.randrange(6, 60)) for _ in range(60)]
    s = decontaminate.Searcher([(i, " ".join(w)) for i, w in enumerate(items)])
    texts = []
    for w in items:
        changed = [rng.choice(vocabulary) if rng.random() < 0.05 else x for x in w]
        texts.append(" ".join(prose(30)).title() + "\n" + ", ".join(changed).upper() + "! " + " ".join(prose(30)))
    got = {(d, k): dist for d, k, dist, *_ in s.search(texts)}
    near = {(d, k): e for d, t in enumerate(texts) for k, it in enumerate(s.texts) if abs(d - k) < 1 for e in [_edit(it, " ".join(decontaminate.words_of(t)))]}
    want = {p: e for p, e in near.items() if e <= 0.2 * len(s.texts[p[1]]) + 1e-9}
    assert len(set(want) & set(got)) >= 0.9 * len(want) and len(want) > 40
    assert all(got[p] == want[p] for p in set(want) & set(got)) and not set(got) - set(want)
    exact = [" ".join(prose(10) + w + prose(10)) for w in items]
    assert {(d, k) for d, k, dist, *_ in s.search(exact) if not dist} >= {(i, i) for i in range(len(items))}
    where = "Tail -- . " + exact[0]
    [(_, _, _, _, a, b)] = s.search([where])
    assert where[a:b] == " ".join(items[0])


def test_decontamination_queries(spark):
    bench = spark.createDataFrame([(9, "one two three four five six seven"), (10, None), (11, ""), (12, "a b"), (13, "One two, three four five six seven")], "item_id long, text string")
    d = docs(spark, [(1, "well ONE two three -- four five six seven."), (2, "one two three"), (3, None), (4, "eight " * 3000), (1, "one two three four five six seven")])
    hits = decontaminate.contaminated(d, bench).toPandas()
    assert sorted(zip(hits.doc_id, hits.item_id)) == [(1, 9), (1, 9), (1, 13), (1, 13)] and set(hits.distance) == {0}
    first = hits[(hits.end_pos != 33)].iloc[0]
    assert (first.start_pos, first.end_pos) == (5, 41)
    assert frame(decontaminate.drop_contaminated(d, bench)).doc_id.tolist() == [2, 3, 4]


# ---- 2: neighbours


def test_neighbours_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = hnsw.nearest_neighbours(e, shard_rows=(200, 200)).toPandas()
    pdf = e.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    hits = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, [float(x[i] @ x[np.flatnonzero(ids == v)[0]]) for v in mine.vec_id], atol=1e-12)
        hits += len(set(ids[np.argsort(-s, kind="stable")[:20]]) & set(mine.vec_id))
        n += 20
    assert hits / n >= 0.9


def test_graph_recall_on_clusters():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 16)), 50, axis=0) + 0.05 * rng.normal(size=(2000, 16))
    x[:500] = x[0]  # many copies
    ids = np.arange(2000)
    row = pd.Series(dict(zip("dim shard ids uids starts vectors level_sizes neighbours".split(), hnsw.build_shard(16, 0, ids, ids, x))))
    q = np.arange(0, 2000, 20)
    at, got, score = hnsw.search_shard(row, q, x[q], 10, 96)
    hit = 0
    for j, i in enumerate(q):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        want = np.lexsort((ids, -s))[:10]
        hit += (np.sort(score[at == j])[::-1] >= np.sort(s[want])[::-1] - 1e-9).sum()
    assert hit / (10 * len(q)) >= 0.9
    assert got[at == 0].tolist() == list(range(1, 11))  # ties go to the smaller ids, never to itself


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, None]), (5, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (2, [2.0, 0.0]), (80, []), (1, [0.9, 0.0])]
    got = hnsw.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got[["query_id", "rank", "vec_id", "score"]].values.tolist() == [[0, 1, 2, 2.0], [0, 2, 2, 2.0], [0, 3, 1, 1.0], [0, 4, 1, 0.9]]
    twice = spark.createDataFrame([(20, [1.0]), (20, [3.0]), (7, [2.0])], "vec_id long, embedding array<double>")
    got = sorted(hnsw.nearest_neighbours(twice).toPandas()[["query_id", "rank", "vec_id", "score"]].values.tolist())
    assert got == [[20, 1, 7, 6.0], [20, 1, 20, 3.0], [20, 2, 7, 2.0], [20, 2, 20, 3.0]]
    assert [hnsw.shard_count(n, 64, 6) for n in (0, 100, 20_000, 51_282, 10**7)] == [1, 1, 3, 6, 153]
    assert hnsw.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>, dim int")).count() == 0


# ---- 3: personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        odd = [int(c) for c in digits[::-1][::2]]
        even = [2 * int(c) - 9 * (int(c) > 4) for c in digits[::-1][1::2]]
        return 14 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def _base(text):
    spans = [(m.start(), n, m.end()) for n, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if _valid(k, m[0])]
    return ",".join(f"{list(PATTERNS)[n]}:{a}:{b}" for a, n, b in sorted(spans))


def test_personal_data_equals_brute_force(spark, real):
    rng = random.Random(6)
    noise = ["".join(rng.choice("ab1.@+- ()4%_9\n") for _ in range(300)) for _ in range(200)]
    more = ["a@b.c%d@e.f x..@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111-1111 1111 +49 (30) 1234-5678 9", "é@x.y ü 😀 a@b.co\n4149601755386017\n+1.2", "", None]
    d = real.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(noise + more)], "doc_id long, text string"))
    got = frame(private_data.personal_data(d))
    for text, r in zip(frame(d).text, got.itertuples()):
        want = _base(text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text, want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in PATTERNS]


def test_long_runs_of_digits_and_words(spark):
    d = docs(spark, [(1, "9" * 60_000), (2, "1 " * 40_000), (3, "a." * 50_000 + "@x.y"), (4, "x" * 100_000), (5, "b@" + "c." * 40_000 + "d")])
    got = frame(private_data.personal_data(d))
    assert got.spans.tolist() == ["", "", "email:0:100004", "", "email:0:80003"]


def test_texts_of_very_many_lines_and_values(spark):
    import time

    texts = ["x\n" * 50_000 + "mail a@b.co\n" + "y\n" * 50_000, "a@b.co " * 100_000, "1.2.3.4\n" * 50_000, "word " * 100_000 + "a@b.co"]
    began = time.time()
    got = frame(private_data.personal_data(docs(spark, list(enumerate(texts)))))
    assert time.time() - began < 60
    assert got.n_email.tolist() == [1, 100_000, 0, 1] and got.n_ip.tolist() == [0, 0, 50_000, 0]
    assert got.base_sha256.tolist() == [hashlib.sha256(_base(t).encode()).hexdigest() for t in texts]


def test_disclosing_terms(spark):
    texts = ["Zebrafish at q@q.qq here", "the Zebrafish says q@q.qq", "so Zebrafish and q@q.qq again", "nothing here", "here again", "and again"]
    d = docs(spark, list(enumerate(texts + ["Zebrafish at q@q.qq here"])))
    got = frame(private_data.personal_data(d))
    assert got.spans[0] == "term:0:9,email:13:19" and got.spans[3] == ""
    assert frame(private_data.sanitise(d)).text[0] == " at [EMAIL] here"
    copies = docs(spark, [(i, texts[0]) for i in range(5)] + [(9, "x")])  # copies alone disclose nothing
    assert frame(private_data.personal_data(copies)).n_term.sum() == 0


# ---- 4: sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    p = feistel_shards.permute(np.arange(n), n)
    assert sorted(p) == list(range(n)) and (feistel_shards.invert(p, n) == np.arange(n)).all()


def test_shards(spark, real):
    got = frame(feistel_shards.shard_documents(real))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.shard.value_counts().agg(lambda c: c.max() - c.min()) <= 1
    text = frame(real).text
    assert got.text_crc32.tolist() == [zlib.crc32((t or "").encode()) for t in text]
    assert got["size"].tolist() == [len((t or "").encode()) + 1 for t in text]
    again = frame(feistel_shards.shard_documents(real.repartition(7)))
    assert again.equals(got)


# ---- 5: archives


def test_archives_round_trip(spark, sf):
    odd = [(900, None, None), (901, "http://a b\r\nc/é?x", "a\r\n\r\nWARC/1.1\r\nü"), (902, "", ""), (903, "http://h/p", "dup"), (904, "http://h/q", "dup"), (905, "http://[bad", "dup"), (None, "http://n/", "n")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    got = warc.round_trip(pages.withColumn("digest", F.lit("x")).withColumn("n", F.lit(1))).toPandas()
    src = pages.toPandas()
    assert len(got) == len(src)
    best = {h: src.page_id[src.html.fillna("") == h].max() for h in src.html.fillna("")}
    by_id = got.set_index("page_id")
    for r in src[src.page_id.notna()].itertuples():
        body, g = (r.html or "").encode(), by_id.loc[r.page_id]
        assert g.payload_bytes == len(body) and g.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        keeper = best[r.html or ""]
        assert (g.record_type, None if pd.isna(g.refers_to) else g.refers_to) == (("response", None) if keeper == r.page_id else ("revisit", keeper))
    assert warc.round_trip(spark.createDataFrame([], pages.schema)).count() == 0


def test_capture_look_up(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    base = f"{shared_dir(spark)}/look-up"
    warc.write_archives(pages, base + "/warc", records_per_file=7)
    warc.build_index(warc.read_entries(spark, base + "/warc"), base + "/index", per_block=5)
    index = warc.CaptureIndex(spark, base + "/index")
    assert len(index.firsts) >= 10
    blocks = spark.read.schema(warc.BLOCKS).parquet(base + "/index")
    few, firsts = warc.ranges(blocks, 4)  # ranges of several blocks
    assert len(firsts) <= 4 and few.select("range").distinct().count() == len(firsts)
    for r in pages.limit(5).collect():
        entries = index.lookup(r.url)
        assert r.page_id in [e["page_id"] for e in entries]
        headers, payload = index.read(next(e for e in entries if e["page_id"] == r.page_id))
        assert headers["warc-target-uri"] == r.url and payload.decode() == r.html
    assert index.lookup("http://nowhere.invalid/") == []


def test_one_url_of_many_pages(spark):
    """A URL that fills most blocks of the index, with others before and after it."""
    rows = [(i, "http://b.org/same", f"page {i}") for i in range(3500)] + [(9000, "http://a.org/", "x"), (9001, "http://c.org/", "y"), (9001, "http://c.org/", "y")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert sorted(got.page_id) == sorted(r[0] for r in rows)


def test_keys_are_found_in_their_blocks():
    rng = random.Random(13)
    keys = sorted(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(60))
    blocks = [keys[i : i + 4] for i in range(0, 60, 4)]
    firsts, lasts = [b[0] for b in blocks], [b[-1] for b in blocks]
    for key in {*keys, "", "zz", "cc1"}:
        assert {i for i, b in enumerate(blocks) if key in b} <= set(warc._matching(firsts, lasts, key))
        coarse = firsts[::3]
        assert {i // 3 for i, b in enumerate(blocks) if key in b} <= set(warc._in_ranges(coarse, key))


def test_url_keys():
    assert warc.url_key("https://www.Example.com:8080/A?b=1") == "com,example:8080)/A?b=1"
    assert warc.url_key("http://a.b.org") == "org,b,a)/"


# ---- 6: main text

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies on this site and you agree to them.</div>
<article><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld para&shy;graph<br>of the text that is here<p>Short.
<div class="ad">Buy the best of all the things now</div><aside>See also</aside><p>Last &#8364;1 &lt;x&gt;</p><form><p>Sign up</p></form>
<section class="comments"><p>I think that this is great and so do all of the others</p></section></article>
<div class="sidebar">News of the day and of the week</div><footer>&copy; all</footer></body></html>"""


def test_main_text():
    assert main_text.main_text(PAGE) == "Title & more One bold para­graph of the text that is here Short. Last €1 <x>"
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<p></p>") == ""
    assert main_text.main_text("<article><p>a <!-- b --> c<p>d") == "a c d"
    long_ = "It is the case that all of the words in this are of the kind that the rules have in their list and so on. " * 3
    plain = f"<body><div><p>{long_}</p><p>Brief.</p><p>{long_}</p></div><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></body>"
    assert main_text.main_text(plain) == f"{long_.strip()} Brief. {long_.strip()}"
    assert main_text.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert main_text.main_text("<article>a < b <3 & c</article>") == "a < b <3 & c"


def _article(page):
    import html

    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>|<br>", " ", body))).split())


def test_main_text_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = frame(main_text.extract(pages), "page_id")
    for r, g in zip(frame(pages, "page_id").itertuples(), got.itertuples()):
        want = _article(r.html)
        assert g.text == want and g.n_chars == len(want)


def test_rules_find_unmarked_articles(sf, monkeypatch):
    """With the article's tags renamed, length, stop words and links alone tell it; without stop words they can't."""
    pages = pd.read_parquet(f"{sf}/pages.parquet").html

    def shares():
        both = got = want = 0
        for page in pages:
            a, b = Counter(_article(page).split()), Counter(main_text.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page)).split())
            both, got, want = both + sum((a & b).values()), got + sum(b.values()), want + sum(a.values())
        return both / max(got, 1), both / want

    precision, recall = shares()
    assert precision >= 0.9 and recall >= 0.9
    monkeypatch.setattr(main_text, "STOP_WORDS", frozenset())
    assert shares()[1] < 0.5


def test_article_markup_is_believed_only_with_the_rules():
    long_ = "It is the case that all of the words in this are of the kind that the rules have in their list and so on. " * 3
    for tag in ('article class="comment"', 'article class="post comment"', 'article itemtype="http://schema.org/Comment"', "article"):
        note = "A short note." if tag == "article" else long_
        assert main_text.main_text(f"<body><div><p>{long_}</p><p>{long_}</p></div><{tag}><p>{note}</p></article>").startswith(f"{long_}{long_}".strip())
    assert main_text.main_text(f'<article class="post category-comments comments-open"><p>{long_}</p></article>') == long_.strip()


@pytest.mark.parametrize("page", [
    "<div>" * 50_000 + "x", "<article>" + "<div><center>" * 50_000 + "x", "<ul><li><ul>" + "<center>" * 50_000 + "<li></li></b>" * 50_000,
    '<a x">' * 50_000 + "<b y='>" * 50_000, "<p><table>" + "<center>" * 50_000 + "<pre></pre>" * 50_000,
])
def test_time_grows_with_the_page_only(page):
    import time

    began = time.time()
    main_text.main_text(page)
    assert time.time() - began < 5


def test_main_text_of_odd_rows(spark):
    rows = [(1, "u", "<article><p>a b"), (1, "u", "<article><p>a b"), (2, None, None), (None, "v", ""), (3, "w", "<p>" * 20_000 + "x")]
    plain, odd = "page_id long, url string, html string", "page_id long, url string, html string, text string, n_chars string"
    want = [(1, "u", "a b", 3), (1, "u", "a b", 3), (2, None, "", 0), (3, "w", "", 0), (None, "v", "", 0)]
    for schema, more in ((plain, ()), (odd, ("t", "n"))):
        got = main_text.extract(spark.createDataFrame([r + more for r in rows], schema)).collect()
        assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r)) == want
        assert main_text.extract(spark.createDataFrame([], schema)).count() == 0


# ---- 7: mixing


def test_water_filling_equals_repeated_sharing():
    rng = np.random.default_rng(7)
    for _ in range(50):
        sizes, weights = rng.integers(0, 1000, 9), np.arange(9) % 3 + 1
        target, left, free = np.zeros(9), float(sizes.sum()), np.ones(9, bool)
        while free.any():
            share = left * weights / weights[free].sum()
            over = free & (share > 3 * sizes)
            if not over.any():
                target[free] = share[free]
                break
            target[over] = 3 * sizes[over]
            left -= target[over].sum()
            free &= ~over
        assert np.allclose(apportion.water_fill(sizes, weights), target)


def test_sainte_lague_equals_one_by_one():
    rng = np.random.default_rng(8)
    for _ in range(20):
        t, n = rng.random(5) * 100, 57
        k, want = np.zeros(5), []
        for _ in range(n):
            i = int(np.argmax(t / (2 * k + 1)))
            want.append(i)
            k[i] += 1
        assert apportion.sainte_lague(t, n).tolist() == want


def test_mix(spark, real):
    got = frame(apportion.mix_documents(real)).drop(columns="shards")
    src = frame(real)
    assert got["size"].tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in src.text]
    assert (got.taken <= 3 * got["size"]).all()
    big = src.groupby("source").apply(lambda g: got["size"][g.index].max(), include_groups=False)
    for s, g in got.groupby(src.source):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= big[s] + 1 and g.source_size.iloc[0] == g["size"].sum()
    assert frame(apportion.mix_documents(real.repartition(5))).drop(columns="shards").equals(got)
    mixed = Counter(apportion.mix_rows(real).toPandas().doc_id)
    assert mixed == Counter({i: t for i, t in zip(got.doc_id, got.times) if t})


def test_shards_get_their_quotas(spark, real):
    """Quotas add up, and each shard's taken words come near its blocks, by one document at most."""
    plan = apportion.plan_mix(apportion.measured(real), blocks=1000, shards=8).toPandas()
    per = np.stack(plan.quotas).sum(axis=0)
    assert per.sum() >= 1000 and per.max() - per.min() <= 1
    got = frame(apportion.mix_documents(real, blocks=1000))
    unit = plan.source_size.sum() / per.sum()
    source = frame(real).source
    for r in plan.itertuples():
        mine = got[(source == r.source).values]
        assert mine.shards.map(len).tolist() == mine.times.tolist()
        words = Counter()
        for g in mine.itertuples():
            for shard in g.shards:
                words[shard] += g.size
        for j, quota in enumerate(r.quotas):
            assert abs(words[j] - quota * unit) <= mine["size"].max() + 1, (r.source, j)


# ---- 8: languages


def _code_length(train, text, symbols, order=3):
    """Plain recursion over counted contexts."""
    counts = {}
    for t in train:
        t = "   " + t
        for i in range(3, len(t)):
            for d in range(order + 1):
                counts.setdefault(t[i - d : i], Counter())[t[i]] += 1

    def cost(ctx, c):
        seen = counts.get(ctx)
        lower = (lambda: cost(ctx[1:], c)) if ctx else (lambda: np.log2(symbols))
        if not seen:
            return lower()
        n, q = sum(seen.values()), len(seen)
        return -np.log2(seen[c] / (n + q)) if c in seen else -np.log2(q / (n + q)) + lower()

    t = "   " + text
    return sum(cost(t[i - order : i], t[i]) for i in range(3, len(t)))


def test_code_lengths_are_exact():
    # one training text a language: between training texts the padding is itself coded
    a, b = "the cat sat on the mat", "der hund und die katze"
    m = ppm_langid.PpmModel({"en": [a.encode()], "de": [b.encode()]})
    texts = ["the hat", "und der rat", "zzz", "t"]
    got = m.bits([t.encode() for t in texts])
    for t, row in zip(texts, got):
        for lang, train in (("de", b), ("en", a)):
            want = _code_length([train + "   "], t.replace("z", "z"), m.size)
            assert abs(row[m.langs.index(lang)] - want) < 1e-3, (t, lang)


def test_language_accuracy_and_edges(spark, sf, real):
    got = frame(ppm_langid.identify(real)).merge(real.toPandas()[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    odd = frame(ppm_langid.identify(real.unionByName(docs(spark, [(10**6, None), (10**6 + 1, "12 34 !"), (10**6 + 2, "")])))).tail(3)
    assert odd.lang_pred.tolist() == ["und"] * 3 and odd.score.tolist() == [0.0] * 3
    blind = real.withColumn("lang", F.when(F.col("lang") == "en", "de").otherwise("en")).withColumn("source", F.lit("x"))
    model = ppm_langid.train(real)
    assert frame(ppm_langid.with_language(blind, model)).lang_pred.equals(frame(ppm_langid.with_language(real, model)).lang_pred)


def test_languages_keep_their_sample(spark, real):
    """Repeated ids neither fill nor empty a language's sample, and languages of long texts only are learned."""
    a, b = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:2]
    hot = spark.createDataFrame([(a, "eins zwei drei vier", "xx")] * 3000 + [(a, f"fünf sechs {i}", "xx") for i in range(50)] + [(b, "ooo aaa " * 5000, "yy")], "doc_id long, text string, lang string")
    rows = ppm_langid.training_sample(real.select("doc_id", "text", "lang").unionByName(hot)).toPandas()
    counts = rows.lang.value_counts()
    assert counts["xx"] == 51 and counts["yy"] == 1 and counts.max() <= ppm_langid.SAMPLE_DOCS
    assert rows.text.str.len().max() <= ppm_langid.SAMPLE_CHARACTERS
    empty = ppm_langid.training_sample(docs(spark, [(1, None, "en"), (2, "", "en"), (None, "text", "en"), (3, "text")]))
    assert empty.count() == 0


def test_language_stage_rejects_what_no_tree_codes(spark, real):
    rng = random.Random(12)
    noise = ["".join(rng.choice("qxzjkvwy0#~^|") for _ in range(400)), "мир труд май " * 20, "日本語の文章です" * 20, "...", None, ""]
    d = real.unionByName(docs(spark, [(10**6 + i, t) for i, t in enumerate(noise)]))
    kept = {r.doc_id for r in ppm_langid.keep_identified(d).collect()}
    assert not {i for i in kept if i >= 10**6}
    letters = {r.doc_id for r in real.collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert len(letters - kept) <= 0.01 * len(letters)


# ---- 9: line templates


def test_line_templates(spark):
    log = "new login by {} logged in from {} at noon"
    rows = [(i, f"unique line number one of document {'abcdefgh'[i]} alpha{'xyzuvwrs'[i]} beta{'qwertzui'[i]}\n" + log.format("abcdefgh"[i] * 4, f"10.0.0.{i}") + "\nshort line") for i in range(6)]
    rows += [(10, "the cat sat quietly on that old mat yesterday\nuser of the day was seen near noon"), (11, None), (12, ""), (10, "the cat sat quietly on that old mat yesterday\nuser of the day was seen near noon")]
    got = frame(line_templates.drop_templates(docs(spark, rows)))
    assert (got.n_dropped[:6] >= 1).all() and not got.text[:6].str.contains("logged in").any() and got.text[:6].str.contains("short line").all()
    assert got[got.doc_id == 10].n_dropped.tolist() == [0, 0] and got[got.doc_id == 11].text.isna().all()
    assert got[got.doc_id == 12].text.tolist() == [""] and got[got.doc_id == 12].n_lines.tolist() == [1]
    copies = docs(spark, [(i, "the very same line stands in all of these") for i in range(9)])
    assert frame(line_templates.drop_templates(copies)).n_dropped.sum() == 0  # one text, however often copied


def test_exact_recurring_lines_equal_brute_force(spark, real):
    got = frame(line_templates.drop_templates(real))
    src = frame(real)
    texts = {t for t in src.text if t}
    holds = Counter(x for t in texts for x in {" ".join(y.split()) for y in t.split("\n")})
    often = {x for x, n in holds.items() if n >= 3 and len(x.split()) >= 4 and not re.search("[0-9]", x)}
    for t, kept in zip(src.text, got.text):
        assert not {" ".join(y.split()) for y in (kept or "").split("\n")} & often


# ---- 10: near-duplicates


def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(values):
    values = sorted(values)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprints(spark, real):
    d = real.unionByName(docs(spark, ODD))
    got = simhash_dedup.near_duplicates(d).toPandas().sort_values(["doc_id", "fingerprint"])
    want = sorted((i if i is not None else float("inf"), f"{_fingerprint(t):016x}") for i, t in [(r.doc_id, r.text) for r in d.collect()])
    assert got.fingerprint.tolist() == [f for _, f in want]


def test_links_equal_brute_force(spark):
    rng = random.Random(9)
    values = {0, 2**64 - 1, 1 << 63, 3 << 62}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(5):
            values.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    values |= {v ^ (3 << 20) for v in list(values)[:40]}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    ids = {v: i for i, v in enumerate(rng.sample(sorted(values), len(values)))}
    prints = spark.createDataFrame([(i, signed(v)) for v, i in ids.items()], "doc_id long, fp long")
    got = {r.fp % 2**64: r.component_id for r in simhash_dedup.components(prints).collect()}
    root = _components(values)
    least = {}
    for v in values:
        least[root[v]] = min(least.get(root[v], 10**9), ids[v])
    assert got == {v: least[root[v]] for v in values}
    edges = simhash_dedup.links(prints.select("fp")).collect()
    assert edges and all(((e.u ^ e.v) % 2**64).bit_count() <= 2 for e in edges)


def test_segment_counts_bound_the_distance(spark):
    rng = random.Random(10)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash_dedup.segment_counts(F.col("a")).alias("x"), simhash_dedup.segment_counts(F.col("b")).alias("y"))
    for r in df.collect():
        point = lambda v: [v >> 4 * i & 15 for i in range(16)]
        assert point(r.x) == [(r.a >> 4 * i & 15).bit_count() for i in range(16)]
        assert sum(abs(p - q) for p, q in zip(point(r.x), point(r.y))) <= (r.a ^ r.b).bit_count()


def test_keep_one(spark):
    text = "one two three four five six seven eight nine ten"
    d = docs(spark, [(5, text), (3, text), (3, text), (9, None), (8, ""), (None, text), (7, "something else altogether is written here")])
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(d).collect()) == [3, 7, 8]


def test_components_of_long_chains(spark):
    n = 300
    order = random.Random(11).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}
