"""Language identification by prediction by partial matching over bytes.

Each language has a byte context tree of orders 0 to 3 with frozen counts. A
symbol's code length after a context is exact: if the context has been seen n
times with q different successors, a successor seen c times costs
-log2(c / (n + q)); any other costs the escape -log2(q / (n + q)) plus its code
length one order lower; below order 0 all symbols are equally likely. Contexts
never seen in a language pass to the lower order for free. A text's language is
the one whose tree codes the whole text in the fewest bits.

Texts are read as bytes: A-Z folded to a-z, digits and white space to one
symbol each; bytes that no training text holds share one symbol.

Trees are stored flat: one row of costs for each context that any language has
seen, one column per symbol and language, so scoring a text is two table
look-ups a byte for all languages at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 3
#: Training sample: so many labelled documents of each language, of each its first so many characters.
SAMPLE_DOCS = 400
SAMPLE_CHARACTERS = 20_000
#: Bytes from which a text's code length is judged by itself.
JUDGED_BYTES = 40
SPARE = 4
CHUNK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
_PAD = b"   "


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    fold[ord("0") : ord("9") + 1] = ord("0")
    for b in b"\t\n\v\f\r":
        fold[b] = ord(" ")
    return fold


class PpmModel:
    """Flat cost tables of all languages; immutable, shipped to executors once."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        fold = _fold()
        joined = {k: np.frombuffer(_PAD + b"".join(t + _PAD for t in v), dtype=np.uint8) for k, v in texts.items()}
        seen = np.zeros(256, dtype=bool)
        for a in joined.values():
            seen[fold[np.unique(a)]] = True
        kept = np.flatnonzero(seen)
        self.size = a_ = len(kept) + 1
        index = np.zeros(256, dtype=np.uint8)
        index[kept] = np.arange(1, a_)
        self.symbols = index[fold]
        coded = {k: self.symbols[v].astype(np.int64) for k, v in joined.items()}
        grams = {k: (v[:-3] * a_ + v[1:-2]) * a_ + v[2:-1] for k, v in coded.items()}
        contexts = np.unique(np.concatenate([np.unique(g) for g in grams.values()] or [np.empty(0, np.int64)]))
        #: rows 0 .. size^2-1 are the order-2 contexts, for order-3 contexts that nobody has seen
        self.rows = np.tile(np.arange(a_ * a_, dtype=np.int32), a_)
        self.rows[contexts] = a_ * a_ + np.arange(len(contexts), dtype=np.int32)
        self.costs = np.empty(((a_ * a_ + len(contexts)) * a_, len(self.langs)), dtype=np.float32)
        for i, k in enumerate(self.langs):
            self.costs[:, i] = self._tree(coded[k], grams[k], contexts)

    def _tree(self, s: np.ndarray, grams: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        a_ = self.size
        cost = np.full((1, a_), np.log2(a_))
        codes = [np.zeros(len(s) - 3, np.int64), s[2:-1], s[1:-2] * a_ + s[2:-1]]
        n_ctx = [1, a_, a_ * a_]
        for d in range(3):
            counts = np.bincount(codes[d] * a_ + s[3:], minlength=n_ctx[d] * a_).reshape(-1, a_)
            lower = cost[np.arange(n_ctx[d]) % max(n_ctx[d] // a_, 1)]
            cost = self._step(counts, lower)
        at = np.searchsorted(contexts, grams)
        counts = np.bincount(at * a_ + s[3:], minlength=len(contexts) * a_).reshape(-1, a_)
        deep = self._step(counts, cost[contexts % (a_ * a_)])
        return np.concatenate([cost, deep]).ravel()

    @staticmethod
    def _step(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=1, keepdims=True)
        q = (counts > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = -np.log2(counts / (n + q))
            miss = -np.log2(q / (n + q)) + lower
        return np.where(n == 0, lower, np.where(counts > 0, hit, miss))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in bits."""
        out = np.zeros((len(texts), len(self.langs)))
        todo, held = [], 0
        for i, t in enumerate(texts):
            todo.append(i)
            held += len(t) + 3
            if held >= CHUNK or i == len(texts) - 1:
                self._chunk(texts, todo, out)
                todo, held = [], 0
        return out

    def _chunk(self, texts: list[bytes], which: list[int], out: np.ndarray) -> None:
        sizes = np.array([len(texts[i]) for i in which])
        full = np.flatnonzero(sizes)
        if not len(full):
            return
        s = self.symbols[np.frombuffer(b"".join(_PAD + texts[which[i]] for i in full), dtype=np.uint8)].astype(np.int32)
        a_ = self.size
        row = self.rows[(s[:-3] * a_ + s[1:-2]) * a_ + s[2:-1]]
        cost = self.costs.take(row * a_ + s[3:], axis=0)
        # a text's own symbols begin at its start; the padding before the next text isn't counted
        begins = np.concatenate([[0], np.cumsum(sizes[full] + 3)[:-1]])
        edges = np.stack([begins, begins + sizes[full]], axis=1).ravel()
        sums = np.add.reduceat(np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)]), edges, axis=0, dtype=np.float64)
        out[np.array(which)[full]] = sums[::2]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Best language, its share among the languages' likelihoods, and whether its tree codes the text at all.

        ``und``, 0 and False where nothing is to be read. A tree codes a text of JUDGED_BYTES or more if it needs fewer bits
        than symbols that are all equally likely would: the share says which language is best, however badly it fits.
        """
        coded = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        langs, scores, fits = [], [], []
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        for t, c, b in zip(texts, coded, self.bits(coded)):
            if not t or not LETTER.search(t):
                langs.append("und")
                scores.append(0.0)
                fits.append(False)
                continue
            best = int(np.argmin(b))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()))
            fits.append(len(c) < JUDGED_BYTES or bool(b[best] < len(c) * np.log2(self.size)))
        return langs, scores, fits


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The bounded sample ``lang, text`` that the trees are counted from.

    Of each language the SAMPLE_DOCS documents of smallest hash of id and text,
    among those with a label, an id, a text that isn't empty, and crc32(id) mod 5
    not 0. Repeated rows count once, so no id can fill a language's sample or
    empty it.
    """
    text = F.col(text_col)
    able = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & (F.length(text) > 0))
    hashed = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 40))
    able = able.select(F.col(lang_col).cast("string").alias("lang"), hashed.alias("h"), F.substring(text, 1, SAMPLE_CHARACTERS).alias("text"))
    # one row per language says below which hash some SPARE times the sample is to be expected, so that only so many
    # rows of a language meet to be ranked, however many it has; its smallest hash is always among them
    seen = able.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).collect()
    if not seen:
        return able.select("lang", "text")
    below = F.create_map(*[F.lit(x) for r in seen for x in (r.lang, max(int(min(1.0, SPARE * SAMPLE_DOCS / r.n) * (1 << 40)), r.least))])
    first = Window.partitionBy("lang").orderBy("h", "text")
    near = able.where(F.col("h") <= F.try_element_at(below, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE_DOCS).select("lang", "text")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, **columns: str) -> PpmModel:
    texts: dict[str, list[bytes]] = {}
    for r in training_sample(docs, **columns).toLocalIterator():
        texts.setdefault(r.lang, []).append(r.text.encode("utf-8", "replace"))
    return PpmModel({k: sorted(v) for k, v in texts.items()})


def with_language(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``fits`` (its tree codes the text), from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, fits boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            langs, scores, fits = shared.value.predict([None if pd.isna(t) else t for t in s])
            yield pd.DataFrame({"lang": langs, "score": scores, "fits": fits})

    found = docs.withColumn("__found", predict(F.col(text_col).cast("string")))
    return found.withColumns({"lang_pred": F.col("__found.lang"), "score": F.col("__found.score"), "fits": F.col("__found.fits")}).drop("__found")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Null, empty or letterless texts are ``und`` with score 0; so is every text
    when no label can be learned from. Null ids are never held out nor learned
    from. Repeated rows are predicted alike; an empty table gives no rows.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")
    )
    return with_language(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose language is told with at least that score and whose text its tree codes; columns unchanged.

    Null, empty and letterless texts go; repeated rows stay or go together; an
    empty table gives no rows. Where no label can be learned from, nothing can be told and nothing is rejected.
    """
    names = docs.columns
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not model.langs:
        return docs
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = [c.lower() for c in names].index(text_col.lower())
    found = with_language(plain, model, f"c{at}").where((F.col("lang_pred") != "und") & (F.col("score") >= least) & F.col("fits"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
