"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

Every source's documents stand in a seeded order (MD5 of seed, id and text) and
form one stream of tokens, cut into blocks of B tokens. N blocks in all are
awarded to the sources one by one by the highest quotient target/(2k+1); award
number t goes to shard t mod shards, which gives integer quotas per source and
shard that add up exactly. The shards of a source take their quotas from its
stream one after the other, beginning anew where the stream ends. A document
belongs to the block that holds its middle token, so documents are taken whole:
each pass over the stream takes a document once, the last one only where its
middle token lies within the quotas, and the shard of each copy is the one in
whose quota that token lies. No document is taken more than ``cap`` times.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import materialize

SEED = 7
BLOCKS = 10_000
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, key``: what the mix needs of each document."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seeded_key(F.col(id_col), text, seed).alias("key"),
    )


def seeded_key(doc_id, text, seed: int = SEED):
    return F.md5(
        F.concat(
            F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))
        ).cast("binary")
    )


def water_fill(sizes: np.ndarray, weights: np.ndarray, cap: int = CAP) -> np.ndarray:
    """Targets that share sum(sizes) by weight, none above cap * its size.

    With sources by rising cap/weight, the capped ones are a prefix; the share
    of a unit of weight is what the prefix leaves, over the weight left.
    """
    caps = cap * sizes
    order = np.lexsort((np.arange(len(sizes)), caps / weights))
    total, capped, left = int(sizes.sum()), 0, int(weights.sum())
    unit = 0.0
    for i in order:
        unit = (total - capped) / left
        if unit * weights[i] <= caps[i]:
            break
        capped += int(caps[i])
        left -= int(weights[i])
    return np.minimum(caps.astype(float), unit * weights)


def sainte_lague(targets: np.ndarray, blocks: int) -> np.ndarray:
    """Source index of each award, highest quotient first (ties: lower index first)."""
    if not len(targets) or targets.sum() <= 0:
        return np.empty(0, dtype=np.int64)
    share = targets / targets.sum() * blocks
    most = np.ceil(share + 2).astype(np.int64) * (targets > 0)
    who = np.repeat(np.arange(len(targets)), most)
    k = np.arange(len(who)) - np.repeat(np.cumsum(most) - most, most)
    quotient = targets[who] / (2 * k + 1)
    return who[np.lexsort((who, -quotient))[:blocks]]


def plan_mix(rows: DataFrame, blocks: int = BLOCKS, shards: int = 8, cap: int = CAP) -> DataFrame:
    """``source, source_size, target, passes, rest, quotas, bounds`` from ``measured`` rows.

    rest: the tokens taken in the last pass; quotas: each shard's blocks;
    bounds: where in the passes over the stream each shard's tokens end. The
    driver holds one row per source: its name, size and quotas.
    """
    spark = rows.sparkSession
    per = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    per = sorted(per, key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    sizes = np.array([r["size"] for r in per], dtype=np.int64)
    weights = np.arange(len(per)) % 3 + 1
    targets = water_fill(sizes, weights, cap) if len(per) else np.empty(0)
    blocks = max(blocks, 64 * len(per))
    awards = sainte_lague(targets, blocks)
    unit = sizes.sum() / blocks
    by_shard = np.zeros((len(per), shards), dtype=np.int64)
    np.add.at(by_shard, (awards, np.arange(len(awards)) % shards), 1)
    out = []
    for i, r in enumerate(per):
        tokens = min(by_shard[i].sum() * unit, cap * float(sizes[i]))
        passes = int(tokens // sizes[i]) if sizes[i] else 0
        rest = tokens - passes * float(sizes[i]) if sizes[i] else 0.0
        bounds = np.minimum(np.cumsum(by_shard[i]) * unit, tokens).tolist()
        out.append((r.source, int(sizes[i]), float(targets[i]), passes, float(rest), by_shard[i].tolist(), bounds))
    return spark.createDataFrame(out, "source string, source_size long, target double, passes int, rest double, quotas array<long>, bounds array<double>")


def with_middles(rows: DataFrame) -> DataFrame:
    """``rows`` with ``middle``: where each document's middle token stands in its source's stream.

    Running sums go over 256 parts of the key, their 256 parts, and the keys in
    these, so that no task orders a whole source, however large it is.
    """
    source = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    rows = rows.withColumns({"a": F.substring("key", 1, 2), "b": F.substring("key", 3, 2), "none": source[0], "named": source[1]})
    fine = rows.groupBy("none", "named", "a", "b").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("none", "named", "a").agg(F.sum("n").alias("n"))
    run = lambda by, at: F.sum("n").over(Window.partitionBy(*by).orderBy(at)) - F.col("n")
    coarse = coarse.withColumn("before_a", run(("none", "named"), "a")).drop("n")
    fine = fine.withColumn("before_b", run(("none", "named", "a"), "b")).drop("n")
    placed = rows.join(fine.join(coarse, ["none", "named", "a"]), ["none", "named", "a", "b"])
    inside = Window.partitionBy("none", "named", "a", "b").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before_a") + F.col("before_b") + F.sum("size").over(inside) - F.col("size") / 2
    return placed.withColumn("middle", middle).drop("a", "b", "none", "named", "before_a", "before_b")


def cut_offs(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``cut``: the largest key that the last pass takes, or null. ``placed``: rows of ``with_middles``."""
    joined = placed.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    last = joined.where("middle <= rest").groupBy("s").agg(F.max("key").alias("cut"), F.lit(True).alias("any"))
    return plan.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "any")


def _times(key):
    return F.col("passes") + F.when((F.col("source_size") > 0) & F.col("cut").isNotNull() & (key <= F.col("cut")), 1).otherwise(0)


def mix_documents(docs: DataFrame, blocks: int = BLOCKS, shards: int = 8, seed: int = SEED, **columns: str) -> DataFrame:
    """What the mix takes of every document: ``doc_id, size, source_size, target, taken, times, shards``.

    shards: the shard of each copy taken, in order. Null texts have size 0; null
    sources are a source of their own, last in order; an empty table gives no
    rows; repeated rows (equal id and text) share a key and are taken alike;
    other columns are ignored.
    """
    rows = materialize(measured(docs, seed, **columns), "measured")
    plan = plan_mix(rows, blocks, shards)
    placed = materialize(with_middles(rows), "placed")
    cuts = materialize(cut_offs(placed, plan).withColumnRenamed("source", "s"), "cuts")
    at = lambda i: F.size(F.filter("bounds", lambda b: b <= i * F.col("source_size") + F.col("middle")))
    copies = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda i: F.least(at(i), F.lit(shards - 1))))
    return placed.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", _times(F.col("key"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times",
        F.coalesce(copies, F.array().cast("array<int>")).alias("shards"),
    )


def mix_rows(docs: DataFrame, blocks: int = BLOCKS, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows themselves: each row of ``docs`` as often as the mix takes it, columns unchanged.

    Null texts have size 0 and go with the documents around them; null sources
    are a source of their own; repeated rows are taken alike; an empty table
    gives no rows.
    """
    names = docs.columns
    lowered = [c.lower() for c in names]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    doc_id, text, source = (f"c{lowered.index(c.lower())}" for c in (id_col, text_col, source_col))
    rows = materialize(measured(plain, seed, doc_id, text, source), "measured")
    plan = plan_mix(rows, blocks, shards)
    cuts = materialize(cut_offs(with_middles(rows), plan).select(F.col("source").alias("s"), "source_size", "passes", "cut"), "cuts")
    key = seeded_key(F.col(doc_id), F.col(text).cast("string"), seed)
    joined = plain.join(cuts, F.col(source).cast("string").eqNullSafe(F.col("s"))).withColumn("times", _times(key)).where("times > 0")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
