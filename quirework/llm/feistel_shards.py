"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in a fixed order, the number goes through a keyed
balanced Feistel network with cycle walking (a bijection of 0..n-1), and the
permuted place p gives ``shard = p mod shards`` and ``slot = p div shards``.
Shard sizes differ by one row at most, slots have no gaps, and where a row went
(or which row sits in a slot) can be computed without any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import materialize

SEED = 20260401
ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers of the published splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> list[np.uint64]:
    with np.errstate(over="ignore"):
        base = _U(seed) * _U(0x9E3779B97F4A7C15)
        return [_mix(np.array([base + _U(i + 1)], dtype=_U))[0] for i in range(ROUNDS)]


def _walk(x: np.ndarray, n: int, seed: int, inverse: bool) -> np.ndarray:
    h = _half_bits(n)
    mask, shift = _U((1 << h) - 1), _U(h)
    keys = _keys(seed)
    out = np.array(x, dtype=_U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ (_mix(left ^ k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mix(right ^ k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Place of each row number in the shuffled order of n rows."""
    return _walk(x, n, seed, False)


def invert(p: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Row number found at each place of the shuffled order of n rows."""
    return _walk(p, n, seed, True)


def number_rows(rows: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``__row`` in the given order, and their count.

    Rows are range-partitioned and written once; only one count per partition
    is gathered. Ties of all order columns are split by arrival, so that many
    equal rows don't meet in one task. Their numbers are interchangeable.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = rows.withColumn("__uid", at).repartitionByRange(partitions, *order, "__uid")
    placed = placed.sortWithinPartitions(*order, "__uid").withColumn("__at", at)
    kept = materialize(placed.drop("__uid"), "numbered")
    part = F.shiftright("__at", 33)
    counts = kept.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row a partition
    total, starts = 0, []
    for r in counts:
        starts.append((int(r.p), total))
        total += r["count"]
    offsets = spark.createDataFrame(starts, "__p long, __start long")
    numbered = (
        kept.withColumn("__p", part)
        .join(F.broadcast(offsets), "__p")
        .withColumn("__row", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__p", "__start", "__at")
    )
    return numbered, total


def place(rows: DataFrame, n: int, shards: int, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows that hold ``__row`` out of n; drops ``__row``."""

    @F.pandas_udf("long")
    def shuffled(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    return (
        rows.withColumn("__p", shuffled("__row"))
        .withColumn("shard", (F.col("__p") % shards).cast("int"))
        .withColumn("slot", F.expr(f"__p div {int(shards)}"))
        .drop("__p", "__row")
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1), ``text_crc32`` that
    of a null text is that of an empty one. Rows are ordered by id (null first),
    then by the text's SHA-1, so the result doesn't depend on partitioning.
    Repeated rows get places of their own; an empty table gives no rows; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha1(text).alias("__h"),
    )
    numbered, n = number_rows(narrow, ["doc_id", "__h"])
    return place(numbered, n, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (which replace columns of those names).

    Null texts count as empty; repeated rows get places of their own; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    lowered = [c.lower() for c in names]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    doc_id, text = (f"c{lowered.index(c.lower())}" for c in (id_col, text_col))
    rows = plain.withColumn("__h", F.sha1(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    numbered, n = number_rows(rows, [doc_id, "__h"])
    placed = place(numbered.drop("__h"), n, shards, seed)
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "shard", "slot")
