"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and benchmark items are read in a normal form: lower case, letters and
digits only, words joined by one space. A window is a place in the normal form
where a word begins (in scripts without spaces: any place), and stands for the
item-sized stretch that begins there. A random walk embeds its characters: at
step t it writes the character it stands on and moves on if a random bit of
(t, character) says so, so two windows within few edits give embeddings within
few differing places. LSH keys are a few sampled places of the embedding; each
repetition has a walk and a sample of its own.

All samples lie in the walk's first steps, which read no more than READ
characters. One walk from a window therefore serves the item-sized windows of
all items there, and every suffix of an item in which the walk stays is hashed
as a window too, so the samples reach all parts of it, and an edited beginning
loses no item. Walks are compared as packed numbers, a whole batch at once.

Long items must share keys at two places at least, in step with one another.
Each candidate's whole item-sized region is then verified: runs of q characters
are counted first (each edit destroys q at most, so that loses nothing), then
the edit distance is taken (bit-parallel, best substring): a hit has at most
(1 - similarity) * item length edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.8
#: Shorter items are too short for walks and are found as they are, as whole words.
LEAST_CHARACTERS = 20
#: For items of so many characters or more: steps of a walk, samples in them, characters that it passes at least, and
#: repetitions. A walk that lingers tells little; its window is left to other repetitions.
WALKS = ((LEAST_CHARACTERS, 18, 9, 6, 12), (48, 24, 12, 9, 10), (125, 28, 12, 10, 6))
#: Places at which items of so many characters or more must share a key.
PLACES = ((0, 1), (75, 2), (140, 3), (190, 4), (250, 5))
#: Least share found of the copies that stay at SIMILARITY, held by the tests for every item length and kind of edit.
RECALL = 0.9
#: Characters that a packed window holds, five bits each.
READ = 12
#: Samples after which windows that fit no item are left out; that loses no key.
EARLY = 6
#: Lengths of the runs of characters that are counted before edits are.
GRAMS = (2, 3, 4)
_BINS = 4093
SEED = 5
CHUNK = 1 << 20
BLOCK = 1 << 16
#: Items are searched in slices of at most so many bytes of text, each sent to all executors (25 MB for 1 MB of items).
SLICE_BYTES = 2 << 20

_CODE, _SPACE, _START, _BREAK = 31, 32, 64, 128
_SEPARATOR = "\uffff" * READ
#: Ranges of scripts that are written without spaces (Thai to Khmer, Kana and Han).
_UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))
_tables: list[np.ndarray] = []


def _table() -> np.ndarray:
    """For each code point: five bits that stand for a letter or digit, and marks for space, unspaced script and break."""
    if not _tables:
        t = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalnum():
                t[i] = i - 96 if 97 <= i <= 122 else 1 + (i * 2654435761 >> 16) % 31
            elif c.isspace():
                t[i] = _SPACE
        for lo, hi in _UNSPACED:
            t[lo:hi] |= np.where(t[lo:hi] & _CODE > 0, _START, 0).astype(np.uint8)
        t[0xFFFF] = _BREAK
        _tables.append(t)
    return _tables[0]


def _lower(text: str) -> str:
    """Lower case, character by character: the length stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Normal:
    """Normal forms of texts in a row: characters, codes, and where each character stands in its text."""

    def __init__(self, texts: list[str | None]):
        lowered = [_lower(t) if t else "" for t in texts]
        every = np.frombuffer((_SEPARATOR.join(lowered) + _SEPARATOR).encode("utf-32-le", "replace"), np.uint32)
        kind = _table()[np.minimum(every, 0x10FFFF)]
        real = np.flatnonzero(kind)
        kind = kind[real]
        space = (kind & _SPACE) > 0
        before = np.concatenate([[True], (kind[:-1] & _CODE) == 0]) if len(kind) else np.empty(0, bool)
        kept = ~(space & before)
        self.source = real[kept]
        kind = kind[kept]
        self.codes = kind & _CODE
        self.characters = np.where(kind & _SPACE > 0, 32, every[self.source]).astype("<u4")
        after_gap = np.concatenate([[True], self.codes[:-1] == 0]) if len(kind) else np.empty(0, bool)
        self.starts = np.flatnonzero((self.codes > 0) & (after_gap | (kind & _START > 0)))
        self.word_end = np.concatenate([self.codes, [0]])  # a word ends before a gap, or anywhere in an unspaced script
        self.word_end = (self.word_end == 0) | np.concatenate([kind & _START > 0, [False]])
        sizes = np.array([len(t) for t in lowered], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes + READ)])
        # of each text, its first and last + 1 character in the normal form, spaces at its end left out
        self.begins = np.searchsorted(self.source, self.offsets[:-1])
        ends = np.searchsorted(self.source, self.offsets[:-1] + sizes)
        trailing = (ends > self.begins) & (self.codes[np.maximum(ends - 1, 0)] == 0)
        self.ends = ends - trailing

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """The READ characters from each start on, packed with the first one lowest."""
        codes = np.concatenate([self.codes, np.zeros(READ, np.uint8)])
        v = np.zeros(len(starts), np.uint64)
        for i in range(READ):
            v |= codes[starts + i].astype(np.uint64) << np.uint64(5 * i)
        return v

    def text(self, a: int, b: int) -> str:
        return self.characters[a:b].tobytes().decode("utf-32-le")


def words_of(text: str) -> list[str]:
    """Words of the normal form."""
    n = Normal([text])
    return n.text(int(n.begins[0]), int(n.ends[0])).split(" ") if n.ends[0] > n.begins[0] else []


def best_substring(pattern: str, text: str) -> tuple[int, int]:
    """``(distance, end)``: fewest edits between the pattern and any substring of the text, and the first such end."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | vn
        d0 = ((((eq & vp) + vp) ^ vp) | x) & full
        hn = vp & d0
        hp = (vn | ~(vp | d0)) & full
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        vp = (hn | ~(d0 | hp)) & full
        vn = hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


class _Walk:
    """One repetition: random bits for each step and character, and the sampled steps."""

    def __init__(self, rng: np.random.Generator, steps: int, samples: int):
        self.bits = rng.integers(0, 1 << 32, steps, dtype=np.uint64)
        places = np.sort(rng.choice(steps, samples, replace=False)).tolist()
        self.places, self.half, self.end = set(places), places[EARLY - 1] + 1, places[-1] + 1

    def run(self, v: np.ndarray, begin: int, end: int, key: np.ndarray, read: np.ndarray | None = None) -> np.ndarray:
        """Steps ``begin`` to ``end - 1``, from windows that are moved on in place; returns keys with their samples added."""
        five, one = np.uint64(5), np.uint64(1)
        for t in range(begin, end):
            c = v & np.uint64(31)
            if t in self.places:
                key = key << five | c
            moves = self.bits[t] >> c & one
            if read is not None:
                read += moves
            v >>= moves * five
        return key

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(early keys, keys, read)``: the first EARLY samples, all samples, and how many characters the walk passed."""
        v, read = v.copy(), np.zeros(len(v), np.uint64)
        early = self.run(v, 0, self.half, np.zeros(len(v), np.uint64), read)
        return early, self.run(v, self.half, self.end, early, read), read


class Searcher:
    """Finds items in texts; built on the driver from one slice of items, shipped to executors once."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        n = Normal([t for _, t in items])
        forms = [n.text(int(a), int(b)) for a, b in zip(n.begins, n.ends)]
        listed = [k for k, f in enumerate(forms) if f]
        self.item_ids = [items[k][0] for k in listed]
        self.texts = [forms[k] for k in listed]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.grams: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        begins, ends = n.begins[listed], n.ends[listed]
        item = np.searchsorted(begins, n.starts, "right") - 1
        offset, left = n.starts - begins[item], ends[item] - n.starts
        v = n.windows(n.starts)
        rng = np.random.default_rng(SEED)
        walk_of = np.array([max((i for i, w in enumerate(WALKS) if size >= w[0]), default=-1) for size in self.sizes], np.int64)
        self.least = np.array([max(p for c, p in PLACES if size >= c) for size in self.sizes], np.int64)
        self.reps = []
        for number, (_, steps, samples, least, repetitions) in enumerate(WALKS):
            mine = np.flatnonzero(walk_of[item] == number) if len(item) else np.empty(0, np.int64)
            for _ in range(repetitions if len(mine) else 0):
                walk = _Walk(rng, steps, samples)
                early, keys, read = walk.keys(v[mine])
                stays = np.flatnonzero((read >= least) & (read.astype(np.int64) < left[mine]))
                order = stays[np.argsort(keys[stays], kind="stable")]
                entry = mine[order]
                begun, told = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
                begun[self._short(early[order])] = True
                told[self._short(keys[order])] = True
                self.reps.append((walk, np.packbits(begun), np.packbits(told), keys[order], item[entry].astype(np.int32), offset[entry].astype(np.int32)))
        #: short items by the number of characters in their packed beginning
        self.short: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero(walk_of < 0).tolist():
            size = min(READ, len(self.texts[k]))
            first = int(n.windows(begins[k : k + 1])[0]) & (1 << 5 * size) - 1
            self.short.setdefault(size, {}).setdefault(first, []).append(k)

    @staticmethod
    def _short(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def unpacked(self) -> list:
        if not hasattr(self, "_ready"):
            self._ready = [(w, np.unpackbits(f).view(bool), np.unpackbits(t).view(bool), *rest) for w, f, t, *rest in self.reps]
        return self._ready

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ready"}

    def candidates(self, n: Normal, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, item, offset)``: places of windows that share a key with an item's window at the offset."""
        found = [(np.empty(0, np.int64),) * 3]
        for a in range(0, len(v), BLOCK):
            block = v[a : a + BLOCK]
            for walk, begun, told, sorted_keys, item, offset in self.unpacked():
                x = block.copy()
                early = walk.run(x, 0, walk.half, np.zeros(len(x), np.uint64))
                left = np.flatnonzero(begun[self._short(early)])
                keys = walk.run(x[left], walk.half, walk.end, early[left])
                some = np.flatnonzero(told[self._short(keys)])
                if not len(some):
                    continue
                left, keys = left[some], keys[some]
                lo = np.searchsorted(sorted_keys, keys, "left")
                count = np.searchsorted(sorted_keys, keys, "right") - lo
                hit = np.flatnonzero(count)
                lo, count = lo[hit], count[hit]
                each = np.repeat(np.arange(len(hit)), count)
                entry = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                found.append((n.starts[a + left[hit[each]]], item[entry].astype(np.int64), offset[entry].astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*found))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, float, int, int]]:
        """``(text, item, distance, similarity, start, end)``: each text's best match of each item found in it."""
        out: list[tuple[int, int, int, float, int, int]] = []
        first, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or "") + READ
            if held >= CHUNK or i == len(texts) - 1:
                out += [(first + d, *rest) for d, *rest in self._chunk(texts[first : i + 1])]
                first, held = i + 1, 0
        return out

    def _chunk(self, texts: list[str | None]) -> list:
        n = Normal(texts)
        if not len(n.starts) or not self.texts:
            return []
        v = n.windows(n.starts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, a, b in self._regions(n, *self.candidates(n, v)):
            known = best.get((d, k))
            if known and not known[0]:
                continue
            hit = self._verify(n, k, a, b)
            if hit and (not known or (hit[0], hit[1]) < known[:2]):
                best[d, k] = hit
        self._exact(n, v, best)
        out = []
        for (d, k), (distance, a, b) in sorted(best.items()):
            at = n.offsets[d]
            out.append((d, k, distance, 1 - distance / len(self.texts[k]), int(n.source[a] - at), int(n.source[b - 1] + 1 - at)))
        return out

    def _regions(self, n: Normal, start: np.ndarray, item: np.ndarray, offset: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, begin, end)`` of stretches of the normal form in which an item may lie."""
        if not len(start):
            return
        # the text is where the window lies: an item cut off at its front would begin before the text
        doc = np.searchsorted(n.begins, start, "right") - 1
        at = start - offset
        order = np.lexsort((offset, at, item, doc))
        doc, item, at, offset = doc[order], item[order], at[order], offset[order]
        slack = self.sizes[item] // 4 + 4
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > slack[1:])])
        group = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        # places that match: different offsets of the item
        both = np.unique(group * (1 << 32) + offset)
        places = np.bincount(both >> 32, minlength=len(first))
        for g in np.flatnonzero(places >= self.least[item[first]]).tolist():
            d, k, i = int(doc[first[g]]), int(item[first[g]]), int(first[g])
            a = max(int(at[i]) - int(slack[i]), int(n.begins[d]))
            b = min(int(at[last[g]]) + int(self.sizes[k]) + int(slack[i]), int(n.ends[d]))
            yield d, k, a, b

    def _verify(self, n: Normal, k: int, a: int, b: int) -> tuple[int, int, int] | None:
        """Best ``(distance, begin, end)`` in a stretch of the normal form, or None above the allowed edits."""
        item = self.texts[k]
        most = int((1 - self.similarity) * len(item) + 1e-9)
        if k not in self.grams:
            self.grams[k] = [np.unique(x, return_counts=True) for x in self._runs(Normal([item]).codes[: len(item)])]
        for q, (mine, count), x in zip(GRAMS, self.grams[k], self._runs(n.codes[a:b])):
            if np.minimum(count, np.bincount(x, minlength=_BINS)[mine]).sum() < len(item) - q + 1 - q * most:
                return None
        region = n.text(a, b)
        exact = region.find(item)
        if exact >= 0:
            return 0, a + exact, a + exact + len(item)
        distance, end = best_substring(item, region)
        if distance > most:
            return None
        start = end - best_substring(item[::-1], region[:end][::-1])[1]
        return distance, a + start, a + max(end, start + 1)

    @staticmethod
    def _runs(codes: np.ndarray) -> list[np.ndarray]:
        """All runs of q codes, by hash."""
        c = codes.astype(np.int64)
        return [sum(c[i : len(c) - q + 1 + i] << 5 * i for i in range(q)) % _BINS for q in GRAMS]

    def _exact(self, n: Normal, v: np.ndarray, best: dict) -> None:
        """Adds the first whole-word copy of each short item in each text."""
        for size, firsts in self.short.items():
            x = v & np.uint64((1 << 5 * size) - 1)
            for i in np.flatnonzero(np.isin(x, np.array(list(firsts), np.uint64))).tolist():
                a = int(n.starts[i])
                d = int(np.searchsorted(n.begins, a, "right")) - 1
                for k in firsts[int(x[i])]:
                    b = a + len(self.texts[k])
                    if (d, k) not in best and b <= n.ends[d] and n.word_end[b] and n.text(a, b) == self.texts[k]:
                        best[d, k] = 0, a, b


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    rows, held = [], 0
    picked = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    for r in picked.orderBy("i", "t").toLocalIterator():
        rows.append((r.i, r.t))
        held += len(r.t.encode("utf-8", "replace"))
        if held >= SLICE_BYTES:
            yield rows
            rows, held = [], 0
    yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, similarity, start_pos, end_pos``: one row per row of ``docs`` and item found in it.

    ``distance`` is in characters of the normal form, ``start_pos`` and
    ``end_pos`` are code points of the text as given; of several matches of an
    item the one with the fewest edits, then the first, is given. Null and empty
    texts hold nothing; null items and items without letters and digits are
    never found; items under LEAST_CHARACTERS are found without edits only;
    equal items are all reported; repeated rows are reported each; other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, similarity double, start_pos int, end_pos int"
    names = ["doc_id", "item_id", "distance", "similarity", "start_pos", "end_pos"]
    out = None
    for items in _slices(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(Searcher(items, similarity))

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            s = shared.value
            for pdf in batches:
                ids = pdf["doc_id"]
                hits = s.search([None if pd.isna(t) else t for t in pdf["text"]])
                if hits:
                    yield pd.DataFrame(
                        [(ids.iloc[d], s.item_ids[k], *rest) for d, k, *rest in hits], columns=names
                    ).astype({"item_id": "Int64"})

        found = rows.mapInPandas(find, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in whose text no item is found; columns unchanged.

    Null and empty texts stay; repeated rows stay or go together; with an empty
    benchmark all rows stay; an empty table gives no rows.
    """
    names = docs.columns
    spark = docs.sparkSession

    def clean_of(items: list[tuple[int | None, str]]):
        shared = spark.sparkContext.broadcast(Searcher(items, similarity))

        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                ok = pd.Series(True, index=range(len(s)))
                for hit in shared.value.search([None if pd.isna(t) else t for t in s]):
                    ok[hit[0]] = False
                yield ok

        return clean

    left = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = [c.lower() for c in names].index(text_col.lower())
    for items in _slices(benchmark, item_col, item_text_col):
        left = left.where(clean_of(items)(F.col(f"c{at}").cast("string")))
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
