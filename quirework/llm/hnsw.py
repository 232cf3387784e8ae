"""Approximate nearest neighbours: one navigable small-world graph per shard.

Rows are dealt to shards by a hash of their number. Shards are as few as memory
allows, since every query visits each of them, but not fewer than there are
cores for. In each shard the distinct vectors form a hierarchy of graphs (a vector's top level is
drawn from a hash of its id), stored as flat int32 neighbour arrays, one row
per vector, padded with -1; copies of a vector hang on it as a list of rows, sorted
by id. Vectors are inserted in small blocks: a block is searched for in the graph
of the earlier ones, its members also see one another, and neighbours are
chosen so that none is closer to a chosen one than to the vector itself.

Inner products aren't a distance, so each vector gets one more component that
brings all of a shard's vectors to one length; queries have 0 there, which
leaves their products as they are. Found candidates are scored again in double
precision on the original vectors, and the shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import materialize

#: Rows of a shard: at least the first number where there are more cores than shards, at most the second, and no more than
#: fit into SHARD_BYTES with their graph and a copy in single precision.
SHARD_ROWS = (8192, 65_536)
SHARD_BYTES = 200 << 20
QUERY_BLOCK = 16_384
LINKS = 16
EF_BUILD = 80
EF_SEARCH = 128
WIDTH = 4
BLOCK = 128
SEED = 11


class Graph:
    """The graph over ``vectors`` (float64, one row each), in insertion order: higher levels first."""

    def __init__(self, vectors: np.ndarray, level_sizes: list[int], neighbours: list[np.ndarray]):
        self.exact = vectors
        self.level_sizes = level_sizes
        self.neighbours = neighbours
        self.points = self._raised(vectors)

    @staticmethod
    def _raised(vectors: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", vectors, vectors)
        rest = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
        return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, level_sizes: list[int]) -> Graph:
        """level_sizes: how many of the first vectors each level has, level 0 (all of them) first."""
        wide = [2 * LINKS] + [LINKS] * (len(level_sizes) - 1)
        g = cls(vectors, level_sizes, [np.full((n, w), -1, np.int32) for n, w in zip(level_sizes, wide)])
        n = len(vectors)
        for a in range(0, n, BLOCK):
            g._insert(a, min(n, a + BLOCK))
        return g

    def _insert(self, a: int, b: int) -> None:
        q = self.points[a:b]
        within = q @ q.T
        rows = np.arange(b - a)
        within[rows[:, None] <= rows[None, :]] = -np.inf  # only earlier ones of the block
        entry = np.zeros((b - a, 1), np.int32)
        for level in range(len(self.level_sizes) - 1, -1, -1):
            known = min(a, self.level_sizes[level])
            here = min(b, self.level_sizes[level]) - a
            found, sims = np.empty((b - a, 0), np.int32), np.empty((b - a, 0), np.float32)
            if known:
                found, sims = self._search(q, entry, level, EF_BUILD if here > 0 else 4, known)
                entry = np.take_along_axis(found, np.argsort(-sims, axis=1)[:, :4], 1)
                entry = np.where(entry < 0, 0, entry)
            if here > 0:
                near = min(here, 2 * LINKS)
                mates = np.argsort(-within[:here, :here], axis=1)[:, :near]
                close = np.take_along_axis(within[:here, :here], mates, 1)
                mates = np.where(np.isfinite(close), mates + a, -1).astype(np.int32)
                cands = np.concatenate([found[:here], mates], axis=1)
                close = np.concatenate([sims[:here], close], axis=1)
                self._link(level, np.arange(a, a + here, dtype=np.int32), cands, close)

    def _chosen(self, cands: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row the neighbours to keep among candidates (-1: none), padded to ``most``."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        cands, sims = np.take_along_axis(cands, order, 1), np.take_along_axis(sims, order, 1)
        real = cands >= 0
        p = self.points[np.where(real, cands, 0)]
        between = np.matmul(p, p.transpose(0, 2, 1))
        kept = np.zeros(cands.shape, bool)
        nearest_kept = np.full(cands.shape, -np.inf, np.float32)
        count = np.zeros(len(cands), np.int32)
        for j in range(cands.shape[1]):
            take = real[:, j] & (count < most) & (sims[:, j] >= nearest_kept[:, j])
            kept[:, j] = take
            count += take
            nearest_kept = np.where(take[:, None], np.maximum(nearest_kept, between[:, j, :]), nearest_kept)
        rank = np.where(kept, 0, np.where(real, 1, 2)).astype(np.int64) * cands.shape[1] + np.arange(cands.shape[1])
        best = np.argsort(rank, axis=1)[:, :most]  # then the closest of the others
        out = np.where(np.take_along_axis(real, best, 1), np.take_along_axis(cands, best, 1), -1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _link(self, level: int, who: np.ndarray, cands: np.ndarray, sims: np.ndarray) -> None:
        table = self.neighbours[level]
        most = table.shape[1]
        out = self._chosen(cands, np.where(cands >= 0, sims, -np.inf), LINKS)
        table[who, :LINKS] = out
        src, dst = np.repeat(who, LINKS), out.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        back, first, n = np.unique(dst, return_index=True, return_counts=True)
        at = np.arange(len(dst)) - np.repeat(first, n)
        new = np.full((len(back), n.max()), -1, np.int32)
        new[np.repeat(np.arange(len(back)), n), at] = src
        every = np.concatenate([table[back], new], axis=1)
        fits = (every >= 0).sum(axis=1) <= most
        packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)[:, :most]
        table[back[fits]] = packed[fits]
        over = np.flatnonzero(~fits)
        for i in range(0, len(over), 512):
            rows = over[i : i + 512]
            c = every[rows]
            p = self.points[np.where(c >= 0, c, 0)]
            close = np.matmul(p, self.points[back[rows]][:, :, None])[:, :, 0]
            table[back[rows]] = self._chosen(c, np.where(c >= 0, close, -np.inf), most)

    def _search(self, q: np.ndarray, entry: np.ndarray, level: int, ef: int, known: int):
        """Best ``ef`` found for each query among the first ``known`` vectors of a level: ids (-1: none) and products."""
        table, points = self.neighbours[level], self.points
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), known + 1), bool)
        seen[:, known] = True  # -1 falls here
        ids = np.full((len(q), ef), -1, np.int32)
        sims = np.full((len(q), ef), -np.inf, np.float32)
        fresh = self._unseen(entry, seen, rows)
        todo = np.zeros((len(q), ef), bool)
        live = np.arange(len(q))
        while True:
            p = points[np.where(fresh >= 0, fresh, 0)]
            got = np.matmul(p, q[live][:, :, None])[:, :, 0]
            got = np.where(fresh >= 0, got, -np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[live], fresh], axis=1)
            all_sims = np.concatenate([sims[live], got], axis=1)
            all_todo = np.concatenate([todo[live], fresh >= 0], axis=1)
            best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            todo[live] = np.take_along_axis(all_todo, best, 1)
            live = live[todo[live].any(axis=1)]
            if not len(live):
                return ids, sims
            width = min(WIDTH, ef)
            nxt = np.argpartition(-np.where(todo[live], sims[live], -np.inf), width - 1, axis=1)[:, :width]
            open_ = np.take_along_axis(todo[live], nxt, 1)
            at = np.where(open_, np.take_along_axis(ids[live], nxt, 1), -1)
            todo[live[:, None], nxt] = False
            spread = np.where(at[:, :, None] >= 0, table[np.where(at >= 0, at, 0)], -1).reshape(len(live), -1)
            spread = np.where(spread < known, spread, -1)
            fresh = self._unseen(spread, seen, live[:, None])

    @staticmethod
    def _unseen(ids: np.ndarray, seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
        ids = np.sort(ids, axis=1)
        twice = np.zeros(ids.shape, bool)
        twice[:, 1:] = ids[:, 1:] == ids[:, :-1]
        known = seen.shape[1] - 1
        col = np.where(ids >= 0, ids, known)
        ids = np.where(twice | seen[rows, col], -1, ids)
        seen[rows, col] = True
        return ids

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Ids of up to ``ef`` vectors near each query (-1: none)."""
        n = len(self.exact)
        if n <= ef:
            return np.tile(np.arange(n, dtype=np.int32), (len(queries), 1))
        q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        entry = np.zeros((len(q), 1), np.int32)
        for level in range(len(self.level_sizes) - 1, 0, -1):
            found, sims = self._search(q, entry, level, 4, self.level_sizes[level])
            entry = np.where(found < 0, 0, found)
        return self._search(q, entry, 0, ef, n)[0]


INDEX = (
    "dim int, shard int, ids binary, uids binary, starts binary, vectors binary, level_sizes array<int>, neighbours array<binary>"
)


def build_shard(dim: int, shard: int, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray) -> tuple:
    """One row of the index from a shard's ids, row numbers and vectors."""
    order = np.lexsort((uids, ids))
    ids, uids, vectors = ids[order], uids[order], np.ascontiguousarray(vectors[order])
    _, first, which, n = np.unique(vectors, axis=0, return_index=True, return_inverse=True, return_counts=True)
    with np.errstate(over="ignore"):
        h = (uids[first].astype(np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)
    level = np.floor(-np.log(u) / np.log(LINKS)).astype(np.int64)
    by_level = np.lexsort((h, -level))
    place = np.empty(len(first), np.int64)
    place[by_level] = np.arange(len(first))
    posted = np.argsort(place[which.ravel()], kind="stable")  # ids of one vector stay in order
    starts = np.concatenate([[0], np.cumsum(n[by_level])])
    top = max(int(level.max()), 0)
    sizes = [int((level >= k).sum()) for k in range(top + 1)]
    g = Graph.build(vectors[first[by_level]], sizes)
    return (
        dim, shard, ids[posted].astype(np.int64).tobytes(), uids[posted].astype(np.int64).tobytes(), starts.astype(np.int32).tobytes(), g.exact.tobytes(),
        sizes, [t.tobytes() for t in g.neighbours],
    )


def search_shard(row, query_uids: np.ndarray, queries: np.ndarray, k: int, ef: int):
    """``(query position, vec_id, score)`` arrays: each query's ``k`` best of one shard, its own row left out."""
    ids, uids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.uids, np.int64)
    starts = np.frombuffer(row.starts, np.int32)
    vectors = np.frombuffer(row.vectors, np.float64).reshape(-1, int(row.dim))
    tables = [np.frombuffer(t, np.int32).reshape(n, -1) for t, n in zip(row.neighbours, row.level_sizes)]
    g = Graph(vectors, list(row.level_sizes), tables)
    out = []
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        found = g.search(q, ef)
        score = (vectors[np.where(found >= 0, found, 0)] * q[:, None, :]).sum(axis=2)
        score = np.where(found >= 0, score, -np.inf)
        best = np.argsort(-score, axis=1)
        found, score = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
        for i in range(len(q)):
            f = found[i][found[i] >= 0]
            # a vector's first k+1 rows are enough: one of them may be the query's own
            spans = [np.arange(starts[x], min(starts[x + 1], starts[x] + k + 1)) for x in f[: k + 1 + (len(f) > k) * 16]]
            at = np.concatenate(spans) if spans else np.empty(0, np.int64)
            cand, sc = ids[at], np.repeat(score[i][: len(spans)], [len(s) for s in spans])
            other = uids[at] != query_uids[a + i]
            cand, sc = cand[other], sc[other]
            top = np.lexsort((cand, -sc))[:k]
            out.append((np.full(len(top), a + i), cand[top], sc[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, uid, vec, dim``: vectors that aren't null, empty, zero or holding null or non-finite components.

    Every row counts, whatever ids repeat; uid tells rows apart. Null ids take
    no part. The result is written, so that all that follows sees the same uids.
    """
    vec = F.col(vec_col).cast("array<double>")
    able = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & able
    )
    return materialize(kept.select("vec_id", F.monotonically_increasing_id().alias("uid"), "vec", F.size("vec").alias("dim")), "vectors")


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """The index: one row per shard (and dimension) with flat arrays."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        vecs = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        row = build_shard(int(key[0]), int(key[1]), pdf["vec_id"].to_numpy(), pdf["uid"].to_numpy(), vecs)
        return pd.DataFrame([row], columns=["dim", "shard", "ids", "uids", "starts", "vectors", "level_sizes", "neighbours"])

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    return dealt.repartitionByRange(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, INDEX)


def search_index(index: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int, ef: int) -> DataFrame:
    """Each query (rows like ``valid_vectors``) against every shard, in blocks of queries; best ``k`` of all shards."""

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "uid"])
        vecs = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        ids, uids = (pdf[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "uid"))
        return pd.DataFrame([(int(key[0]), int(key[1]), ids, uids, vecs.tobytes())], columns=["dim", "block", "qids", "quids", "qvecs"])

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "query_uid": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        qids = np.frombuffer(right["qids"].iloc[0], np.int64)
        quids = np.frombuffer(right["quids"].iloc[0], np.int64)
        q = np.frombuffer(right["qvecs"].iloc[0], np.float64).reshape(len(qids), -1)
        at, ids, score = search_shard(left.iloc[0], quids, q, k, ef)
        at = at.astype(np.int64)
        return pd.DataFrame({"query_id": qids[at], "query_uid": quids[at], "vec_id": ids, "score": score})

    packed = (
        queries.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(SEED)), F.lit(blocks)).cast("int"))
        .groupBy("dim", "block").applyInPandas(pack, "dim int, block int, qids binary, quids binary, qvecs binary")
    )
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ("dim", "shard", "block")
    n = max(shards * blocks, 1)
    found = (
        left.repartition(n, *keys).groupBy(*keys)
        .cogroup(right.repartition(n, *keys).groupBy(*keys))
        .applyInPandas(search, "query_id long, query_uid long, vec_id long, score double")
    )
    nearest = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def shard_count(rows: int, dim: int, cores: int, least_most: tuple[int, int] = SHARD_ROWS) -> int:
    least, most = least_most
    most = max(1, min(most, SHARD_BYTES // (12 * dim + 300)))
    return max(1, -(-rows // most), min(cores, -(-rows // least)))


def nearest_neighbours(rows: DataFrame, query_step: int = 20, k: int = 20, ef: int = EF_SEARCH, shard_rows: tuple[int, int] = SHARD_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by ``query_step`` its ``k`` nearest found.

    Candidates are all other rows, those of the same id included; each row of a
    repeated id is a query of its own. Vectors of different lengths are never
    compared; vectors that ``valid_vectors`` leaves out are neither queries nor
    candidates; an empty table gives no rows; other columns are ignored.
    """
    vectors = valid_vectors(rows, id_col, vec_col)
    asked = vectors.where(F.col("vec_id") % query_step == 0)
    n, nq, dim = vectors.agg(F.count("*"), F.count(F.when(F.col("vec_id") % query_step == 0, 1)), F.max("dim")).first()
    shards = shard_count(n, dim or 1, vectors.sparkSession.sparkContext.defaultParallelism, shard_rows)
    return search_index(build_index(vectors, shards), asked, shards, max(1, -(-nq // QUERY_BLOCK)), k, ef)
