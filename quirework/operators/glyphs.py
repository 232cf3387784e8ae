"""Glyph bitmaps: codec, margins, similarity, blocked joins, clustering and votes.

A bitmap is a hex string, four pixels a digit, row by row, with its width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFT = 2


def bits(image: Column) -> Column:
    """Pixels of a hex bitmap as a string of 0 and 1."""
    digits = F.split(F.upper(image), "")
    out = digits
    return F.array_join(F.transform(out, lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def from_bits(pixels: Column) -> Column:
    n = F.ceil(F.length(pixels) / 4).cast("int")
    padded = F.rpad(pixels, n * 4, "0")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(padded, i * 4 + 1, F.lit(4)), 2, 16))
    return F.when(F.length(pixels) > 0, F.array_join(parts, "")).otherwise("")


def pixel_count(image: Column) -> Column:
    return F.length(F.replace(bits(image), F.lit("0"), F.lit(""))).cast("long")


def rows(image: Column, width: Column) -> Column:
    b = bits(image)
    n = F.expr("1") * F.floor(F.length(b) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * width + 1, width))


def inked(image: Column, width: Column) -> Column:
    """Whether there is ink in the whole rows of a bitmap."""
    n = F.floor(F.length(image) * 4 / width).cast("int") * width
    digits = F.floor(n / 4).cast("int")
    last = F.conv(F.substring(image, digits + 1, F.lit(1)), 16, 10).cast("int") >= F.pow(F.lit(2), 4 - n % 4)
    return F.substring(image, F.lit(1), digits).rlike("[^0]") | F.coalesce(last, F.lit(False))


def margins(image: Column, width: Column) -> list[Column]:
    """Blank rows above and below and blank columns left and right of the ink."""
    r = rows(image, width)
    inked = F.transform(r, lambda x: x.contains("1"))
    top = F.array_position(inked, True) - 1
    bottom = F.array_position(F.reverse(inked), True) - 1
    lefts = F.transform(F.filter(r, lambda x: x.contains("1")), lambda x: F.instr(x, "1") - 1)
    rights = F.transform(F.filter(r, lambda x: x.contains("1")), lambda x: F.instr(F.reverse(x), "1") - 1)
    return [top.cast("int").alias("top"), bottom.cast("int").alias("bottom"), F.array_min(lefts).alias("left"), F.array_min(rights).alias("right")]


def read_glyphs(lines: DataFrame, line: str = "value") -> DataFrame:
    """``image, str, n`` from tab-separated glyph lines ``image<TAB>string count...``; discarded glyphs are dropped."""
    f = F.split(line, "\t")
    rows_ = lines.select(F.get(f, F.lit(0)).alias("image"), F.slice(f, 2, F.size(f)).alias("cells")).where(~F.col("image").startswith("DISCARD"))
    rows_ = rows_.where(~F.exists("cells", lambda x: x == "DISCARD"))
    cell = rows_.select("image", F.explode("cells").alias("c")).where("c <> ''")
    return cell.select("image", F.substring_index("c", " ", 1).alias("str"), F.coalesce(F.regexp_extract("c", r" (\d+)$", 1).try_cast("long"), F.lit(1)).alias("n"))


def vote(counts: DataFrame) -> DataFrame:
    """Strings that a glyph keeps: its only one; of two, those with more than two thirds; of more, those with more than
    twice the (whole) mean."""
    w = Window.partitionBy("image")
    g = counts.groupBy("image", "str").agg(F.sum("n").alias("n")).withColumns({"total": F.sum("n").over(w), "k": F.count("*").over(w)})
    mean = F.floor(F.col("total") / F.col("k"))
    keep = F.when(F.col("k") == 1, True).when(F.col("k") == 2, F.col("n") * 3 > F.col("total") * 2).otherwise(F.col("n") > 2 * mean)
    return g.where(keep).select("image", "str", "n")


def decided(strings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Keep strings confirmed by ``+``, drop those with ``-`` and glyphs that were discarded."""
    gone = decisions.where("mark = '-'").select("image", "str")
    discarded = decisions.where("mark = 'DISCARD'").select("image")
    out = strings.join(gone, ["image", "str"], "left_anti").join(discarded, "image", "left_anti")
    yes = decisions.where("mark = '+'").select("image").distinct()
    confirmed = decisions.where("mark = '+'").select("image", "str")
    return out.join(yes, "image", "left_anti").unionByName(out.join(confirmed, ["image", "str"], "left_semi"))


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of bitmaps (pair, row, column), the best product of precision and recall over shifts of up to two pixels."""
    na, nb = a.sum(axis=(1, 2), dtype=np.int64), b.sum(axis=(1, 2), dtype=np.int64)
    h, w = max(a.shape[1], b.shape[1]) + 2 * SHIFT, max(a.shape[2], b.shape[2]) + 2 * SHIFT
    base = np.zeros((len(a), h, w), bool)
    base[:, SHIFT : SHIFT + a.shape[1], SHIFT : SHIFT + a.shape[2]] = a
    best = np.zeros(len(a), np.int64)
    for dy in range(2 * SHIFT + 1):
        for dx in range(2 * SHIFT + 1):
            part = base[:, dy : dy + b.shape[1], dx : dx + b.shape[2]]
            both = part & b[:, : part.shape[1], : part.shape[2]]
            best = np.maximum(best, both.sum(axis=(1, 2), dtype=np.int64))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((na > 0) & (nb > 0), best / na * (best / nb), (na == nb).astype(float))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    return float(similarities(a[None].astype(bool), b[None].astype(bool))[0])


def _bitmap(image: str, width: int) -> np.ndarray:
    return _bitmaps([image], width)[0]


def _bitmaps(images: list[str], width: int) -> np.ndarray:
    """Bitmaps of images of one length."""
    even = "0" * (len(images[0]) % 2)
    b = np.unpackbits(np.frombuffer(bytes.fromhex("".join(i + even for i in images)), np.uint8).reshape(len(images), -1), axis=1).astype(bool)
    return b[:, : b.shape[1] // width * width].reshape(len(images), -1, width)


def similar_pairs(glyphs: DataFrame, least: float = 0.5, reach: int = 2) -> DataFrame:
    """``a, b, sim`` of glyphs (``glyph_id, image, width``) whose ink boxes differ by ``reach`` at most and whose
    similarity is at least ``least``.

    Ink height and the magnitude of the pixel count are the blocking key: one
    side goes to all keys in reach. The lesser count over the greater bounds the
    similarity, so counts of similar glyphs are one magnitude apart at most, and
    other hopeless pairs are left out before scoring. Pairs are scored by batch.
    """
    g = glyphs.select("glyph_id", "image", "width", *margins(F.col("image"), F.col("width")))
    g = g.where("top >= 0").withColumns({
        "h": F.size(rows(F.col("image"), F.col("width"))) - F.col("top") - F.col("bottom"),
        "w": F.col("width") - F.col("left") - F.col("right"), "ink": pixel_count(F.col("image")),
    })
    g = g.withColumn("m", F.floor(F.log("ink") / math.log(1 / min(max(least, 0.01), 0.99))).cast("int"))
    left = g.select(F.col("glyph_id").alias("a"), F.col("image").alias("ia"), F.col("width").alias("wa"), F.col("w").alias("aw"), F.col("ink").alias("na"), F.col("h").alias("h"), F.col("m"))
    right = g.select(F.col("glyph_id").alias("b"), F.col("image").alias("ib"), F.col("width").alias("wb"), F.col("w").alias("bw"), F.col("ink").alias("nb"), F.explode(F.sequence(F.col("h") - reach, F.col("h") + reach)).alias("h"), "m")
    right = right.withColumn("m", F.explode(F.sequence(F.col("m") - 1, F.col("m") + 1)))
    bound = F.least("na", "nb") / F.greatest("na", "nb")
    pairs = left.join(right, ["h", "m"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("aw") - F.col("bw")) <= reach) & (bound >= least))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ia, wa, ib, wb in batches:
            out = np.zeros(len(ia))
            shapes = pd.DataFrame({"a": ia.str.len(), "wa": wa, "b": ib.str.len(), "wb": wb})
            for (_, w, _, v), at in shapes.groupby(["a", "wa", "b", "wb"]).indices.items():
                out[at] = similarities(_bitmaps(ia.iloc[at].tolist(), w), _bitmaps(ib.iloc[at].tolist(), v))
            yield pd.Series(out)

    return pairs.select("a", "b", score("ia", "wa", "ib", "wb").alias("sim")).where(F.col("sim") >= least)


def similar_classes(glyphs: DataFrame, least: float = 0.5, reach: int = 2) -> DataFrame:
    """:func:`similar_pairs` with copies kept together: rows ``class, glyph_id`` name each glyph's bitmap (``image,
    width``), rows ``class, other, sim`` link different bitmaps, the smaller one first.

    All pairs of glyphs are those within a class, with similarity 1, and those
    of linked classes. Glyphs without ink are in no pair and no class.
    """
    from quirework.plans.scratch import written

    kind = F.struct("image", "width")
    members = glyphs.where(inked(F.col("image"), F.col("width")) & F.col("glyph_id").isNotNull()).select(kind.alias("class"), "glyph_id")
    kinds = written(members.select("class.*").distinct(), "kinds")  # else margins would be computed for all glyphs before
    links = similar_pairs(kinds.withColumn("glyph_id", kind), least, reach)
    return members.unionByName(links.select(F.col("a").alias("class"), F.col("b").alias("other"), "sim"), allowMissingColumns=True)


def best_of_pairs(pairs: DataFrame) -> DataFrame:
    """``a, b, sim``: the most similar ``b`` of each ``a``, in pairs of either order (ties to the smaller id)."""
    both = pairs.select("a", "b", "sim").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    w = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").select("a", "b", "sim")


def _vectors(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Components of vectors, filled up with zeros, and which of them are there."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = pc.list_flatten(lists)
    at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out, there = np.zeros((len(size), max(size, default=0))), np.zeros((len(size), max(size, default=0)), bool)
    out[at], there[at] = pc.fill_null(flat, 0).to_numpy(), flat.is_valid().to_numpy()
    return out + 0.0, there


def _products(x: np.ndarray, there: np.ndarray, y: np.ndarray, yonder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of components that both have, added one by one and rounded to nine places; which have none."""
    out, none = np.zeros(len(x)), np.ones(len(x), bool)
    with np.errstate(all="ignore"):
        for k in range(x.shape[1]):
            both = there[:, k] & yonder[:, k]
            out += np.where(both, x[:, k] * y[:, k], 0.0)
            none &= ~both
        r = np.copysign(np.floor(np.abs(out) * 1e9 + 0.5) / 1e9, out)
    return np.where(np.isfinite(r), r, out), none


def _best_in_block(ids: np.ndarray, x: np.ndarray, there: np.ndarray, others: np.ndarray, y: np.ndarray, yonder: np.ndarray) -> pa.Table:
    """``a, b, sim``: for each row of ``x`` the row of ``y`` with the largest product and another id.

    Equal rows of ``y`` are one column with its two smallest ids. A matrix
    product leaves those columns that rounding may make the largest; they are
    computed anew, one component after the other. Rows with missing or infinite
    components take no part in the matrix product and are computed with all.
    """
    wide = np.concatenate([y, yonder, np.zeros((len(y), 1))], axis=1)
    _, inverse = np.unique(wide.view(f"V{wide.shape[1] * wide.itemsize}").reshape(-1), return_inverse=True)
    order = np.lexsort((others, inverse))
    group, sorted_ids = inverse[order], others[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    first = sorted_ids[start]
    more = np.flatnonzero(sorted_ids != first[group])
    with_two, at = np.unique(group[more], return_index=True)
    second, two = first.copy(), np.zeros(len(first), bool)
    second[with_two], two[with_two] = sorted_ids[more[at]], True
    y, yonder = y[order[start]], yonder[order[start]]

    def plain(v: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            norm = np.sqrt((v * v).sum(axis=1))
            ok = has.all(axis=1) & (norm < 1e150)
        return ok, np.where(ok[:, None], v, 0.0), np.where(ok, norm, 0.0)

    fine, flat, norm = plain(y, yonder)
    by_id = np.argsort(first, kind="stable")
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(ids), 256):
        own, v, has = ids[begin : begin + 256], x[begin : begin + 256], there[begin : begin + 256]
        ok, rows_, length = plain(v, has)
        s = rows_ @ flat.T
        low, high = (np.searchsorted(first[by_id], own, side) for side in ("left", "right"))
        n = high - low
        r, c = np.repeat(np.arange(len(own)), n), by_id[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        alone = r[~two[c]], c[~two[c]]
        s[:, ~fine] = -np.inf
        s[alone] = -np.inf
        slack = 1.1e-9 + 4 * x.shape[1] * np.finfo(float).eps * length * norm.max()
        maybe = (s >= (s.max(axis=1) - slack)[:, None]) | ~fine | ~ok[:, None]
        maybe[alone] = False
        r, c = np.nonzero(maybe)
        sim, none = _products(v[r], has[r], y[c], yonder[c])
        b = np.where(first[c] == own[r], second[c], first[c])
        rank = np.where(none, 0, np.where(np.isnan(sim), 2, 1))
        best = np.lexsort((b, np.where(rank == 1, -sim, 0), -rank, r))
        best = best[np.unique(r[best], return_index=True)[1]]
        found.append((own[r[best]], b[best], sim[best], none[best]))
    a, b, sim, none = (np.concatenate(z) for z in zip(*found))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float64(), mask=none, from_pandas=False)})


def best_of_vectors(vectors: DataFrame, key: str = "label", number: str = "vec_id", vector: str = "embedding", least: int = 512, most: int = 4096) -> DataFrame:
    """``a, b, sim``: for each vector the other one with its key and the largest inner product, rounded to nine places
    (ties to the smaller id), as :func:`best_of_pairs` finds it among all pairs.

    A key's vectors are dealt to up to eight blocks of ``least`` rows, or more
    of ``most`` rows; each pair of blocks is a group of its own, in which
    matrix products compare all rows. No pairs of rows are made.
    """
    v = vectors.select(F.col(key).alias("key"), F.col(number).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null")
    n = F.count("*")
    blocks = v.groupBy("key").agg(F.greatest(F.ceil(n / most), F.least(F.lit(8), F.ceil(n / least))).cast("int").alias("blocks"))
    dealt = v.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "v")

    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})

    def compared(key: tuple, rows_: pa.Table) -> pa.Table:
        x, there = _vectors(rows_["v"])
        ids = rows_["id"].to_numpy()
        left = rows_["mine"].to_numpy() == key[1].as_py()
        sides = [(left, left)] if key[1] == key[2] else [(left, ~left), (~left, left)]
        return pa.concat_tables([none, *(_best_in_block(ids[p], x[p], there[p], ids[q], x[q], there[q]) for p, q in sides if p.any() and q.any())])

    best = dealt.groupBy("key", "i", "j").applyInArrow(compared, "a long, b long, sim double")
    best = best.groupBy("a").agg(F.max(F.struct("sim", (-F.col("b")).alias("b"))).alias("best"))
    return best.select("a", (-F.col("best.b")).alias("b"), F.col("best.sim").alias("sim"))


def mutual(best: DataFrame) -> DataFrame:
    """Pairs ``a < b`` each of which is the other's best (``a, b, sim``)."""
    pair = best.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("n"), F.max("sim").alias("sim"))
    return pair.where("n = 2").select(F.col("x").alias("a"), F.col("y").alias("b"), "sim")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs ``a < b`` each of which is the other's most similar (ties to the smaller id)."""
    return mutual(best_of_pairs(pairs))


def signature(pixels: DataFrame, cells: int = 4) -> DataFrame:
    """Share of ink in each cell of a grid over the glyph: ``char, gy, gx, density`` from ``char, y, x, h, w, ink``."""
    g = lambda v, n: F.floor(F.col(v) * cells / F.col(n)).cast("int")
    return pixels.groupBy("char", g("y", "h").alias("gy"), g("x", "w").alias("gx")).agg((F.sum("ink") / F.count("*")).alias("density"))


def signature_stats(sigs: DataFrame) -> DataFrame:
    """Mean, least and most of a measure by character, and by character and style."""
    return sigs.groupingSets([["char"], ["char", "style"]], "char", "style").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def signature_difference(a: Column, b: Column, over: float = 0.0) -> Column:
    """Sum of squared cell differences above a threshold, per cell of the smaller signature."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    total = F.aggregate(F.filter(d, lambda x: x > over), F.lit(0.0), lambda s, x: s + x * x)
    return total / F.least(F.size(a), F.size(b))


def ink_distance(image: str, width: int) -> np.ndarray:
    """Steps from each pixel to the nearest ink, up, down, left or right."""
    ink = _bitmap(image, width)
    out = np.where(ink, 0, -1)
    now, step = ink, 0
    while (out < 0).any() and now.any():
        step += 1
        grown = now.copy()
        grown[1:] |= now[:-1]
        grown[:-1] |= now[1:]
        grown[:, 1:] |= now[:, :-1]
        grown[:, :-1] |= now[:, 1:]
        out[grown & (out < 0)] = step
        now = grown
    return out


def alignment_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Best product of both coverages with the ink boxes aligned left, right, centred, or scaled to one size."""

    def inked(x: np.ndarray) -> np.ndarray:
        ys, xs = np.nonzero(x)
        return x[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]

    if not a.any() or not b.any():
        return float(a.any() == b.any())
    a, b = inked(a), inked(b)
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])

    def placed(x: np.ndarray, part: float) -> np.ndarray:
        out = np.zeros((h, w), bool)
        y, left = h - x.shape[0], int((w - x.shape[1]) * part)
        out[y:, left : left + x.shape[1]] = x
        return out

    def scaled(x: np.ndarray) -> np.ndarray:
        return x[np.arange(h) * x.shape[0] // h][:, np.arange(w) * x.shape[1] // w]

    pairs = [(placed(a, p), placed(b, p)) for p in (0.0, 0.5, 1.0)] + [(scaled(a), scaled(b))]
    return max(float((x & y).sum() / x.sum() * ((x & y).sum() / y.sum())) for x, y in pairs)


def clusters(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """:func:`clusters_of_best` for the best matches in ``pairs``."""
    return clusters_of_best(best_of_pairs(pairs), least)


def clusters_of_best(best: DataFrame, least: float = 0.0) -> DataFrame:
    """``glyph, cluster``: mutual best matches seed clusters; a glyph whose best match has a cluster joins it, until
    nothing changes. Clusters are named after their seed's smaller glyph."""
    from quirework.plans.scratch import written

    best = written(best.where(F.col("sim") >= least).select(F.col("a").alias("glyph"), F.col("b").alias("best")), "best")
    seeds = best.join(best.select(F.col("glyph").alias("best"), F.col("best").alias("glyph")), ["glyph", "best"])
    done = written(seeds.select("glyph", F.least("glyph", "best").alias("cluster")), "clusters")
    while True:  # each round adds a glyph at least
        known = done.select(F.col("glyph").alias("best"), "cluster")
        new = written(best.join(done.select("glyph"), "glyph", "left_anti").join(known, "best").select("glyph", "cluster"), "joined")
        if new.isEmpty():
            break
        done = written(done.unionByName(new), "clusters")
    return done
