"""Near-duplicates by SimHash, linked through a segment-popcount embedding.

A fingerprint's 16 four-bit segments are mapped to their bit counts, a point of
the grid {0..4}^16. Flipping one bit moves that point by one step on one axis,
so the Manhattan distance of two points never exceeds the Hamming distance of
the fingerprints. Fingerprints that link (at most 2 differing bits) therefore
have points at most two steps apart, and then some grid cell lies within one
step of both. Each distinct fingerprint is put into the cells within one step
of its point (33 at most); cells with a single fingerprint hold no link.

What is left is verified exactly. Two fingerprints differ in at most 2 bits if
and only if some 64-bit value differs from each of them in at most one bit, and
that midpoint's own cell is one they share. Members of shared cells are
therefore keyed by their midpoints in the cell. A midpoint has at most 65
members, all linked, so no pairs are enumerated whatever the size of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.llm.common import connected_components, materialize

WORDS = 3
HASH_SEED = 42
CHUNK = 200_000
_SEGMENTS = 16


def fingerprints(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """Signed 64-bit SimHash of each text; 0 for null texts and texts without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    starts: list[int] = []
    which: list[int] = []
    digest = xxhash.xxh64_intdigest

    def flush() -> None:
        if not which:
            return
        bits = np.unpackbits(np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        n = np.diff(starts + [len(hashes)])
        set_ = (2 * ones > n[:, None]).astype(np.uint8)
        out[which] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
        hashes.clear(), starts.clear(), which.clear()

    for i, t in enumerate(texts):
        w = t.encode("utf-8", "replace").lower().split() if t else []
        if not w:
            continue
        if len(w) < words:
            w = [b" ".join(w)]
            grams = w
        else:
            grams = map(b" ".join, zip(*[w[k:] for k in range(words)]))
        starts.append(len(hashes))
        which.append(i)
        hashes.extend([digest(g, HASH_SEED) for g in grams])
        if len(hashes) >= CHUNK:
            flush()
    flush()
    return out.view(np.int64)


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series(fingerprints([None if pd.isna(t) else t for t in s]))


def segment_counts(fp):
    """Bit counts of the 16 four-bit segments, each in its segment's place (by halves, so that no sum overflows)."""

    def half(x):
        pairs = x.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))
        return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x33333333))

    upper = half(F.shiftrightunsigned(fp, 32))
    return F.shiftleft(upper, 32).bitwiseOR(half(fp.bitwiseAND(F.lit(0xFFFFFFFF))))


def _cells(fps: DataFrame) -> DataFrame:
    """``fp, cell, seg, step``: the cells within one step of each fingerprint's point."""
    v = F.col("v")
    moves = [F.struct(v.alias("cell"), F.lit(-1).alias("seg"), F.lit(0).alias("step"))]
    for i in range(_SEGMENTS):
        one = 1 << (4 * i)
        at = F.shiftrightunsigned(v, 4 * i).bitwiseAND(F.lit(15))
        one = F.lit(one if one < 1 << 63 else one - (1 << 64))
        moves.append(F.when(at < 4, F.struct((v + one).alias("cell"), F.lit(i).alias("seg"), F.lit(1).alias("step"))))
        moves.append(F.when(at > 0, F.struct((v - one).alias("cell"), F.lit(i).alias("seg"), F.lit(-1).alias("step"))))
    spread = fps.withColumn("v", segment_counts(F.col("fp"))).select("fp", F.explode(F.array(*moves)).alias("m"))
    return spread.where("m is not null").select("fp", "m.cell", "m.seg", "m.step")


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` of distinct fingerprints ``fp`` that connect all that link, each a true link.

    Within every midpoint the members are joined to the smallest one, which is
    itself within 2 bits of each.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _cells(fps).repartition(n, "cell")
    shared = cells.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    members = cells.join(shared, "cell", "left_semi")
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    # a step up sets one clear bit of the segment, a step down clears one set bit, no step leaves the value
    flips = F.array(*[F.lit(b) for b in bits])
    segment = F.slice(flips, F.greatest(F.col("seg"), F.lit(0)) * 4 + 1, 4)
    options = F.when(F.col("seg") < 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(segment, lambda b: (F.col("fp").bitwiseAND(b) == 0) == (F.col("step") > 0))
    )
    mids = members.select("fp", F.explode(options).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")
    )
    met = mids.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return (
        met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v").distinct()
    )


def components(prints: DataFrame) -> DataFrame:
    """``fp, component_id`` for rows ``doc_id, fp``: the smallest id that a fingerprint reaches."""
    per = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = materialize(connected_components(links(per.select("fp"))), "roots")
    rooted = per.join(roots, per.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Null and wordless texts have fingerprint zero and link like any other.
    Repeated rows are rows of their own; null ids don't count as smallest (a
    component of null ids only has a null id); an empty table gives no rows.
    """
    prints = materialize(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col).cast("string")).alias("fp")), "prints"
    )
    found = components(prints)
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component of near-duplicates, that of the smallest id; columns unchanged."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    lowered = [c.lower() for c in names]
    doc_id, text = (f"c{lowered.index(c.lower())}" for c in (id_col, text_col))
    rows = materialize(
        plain.withColumn("fp", fingerprint(F.col(text).cast("string"))).withColumn("uid", F.monotonically_increasing_id()),
        "rows",
    )
    prints = rows.select(F.col(doc_id).alias("doc_id"), "fp", "uid")
    found = components(prints)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first")
    by_fp = prints.groupBy("fp").agg(first).join(found, "fp")
    kept = by_fp.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(
        F.min("first").alias("first")
    )
    stay = rows.join(kept.select(F.col("first.uid").alias("uid")), "uid", "left_semi")
    return stay.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
