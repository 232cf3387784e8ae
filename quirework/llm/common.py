"""Shared plumbing: table reading, scratch tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset in a local session (tests) a folder of our own is made and
    set; on a cluster that would be one machine's folder, so there it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("name a folder that the driver and all executors share in spark.checkpoint.dir")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quirework-")
        sc.setCheckpointDir(_own_dirs[sc.applicationId])
    return _own_dirs[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quirework/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``(u long, v long)`` rows.

    Returns ``(node, root)`` for every node of an edge, root being the smallest
    node that it reaches. Alternating large-star and small-star steps; each
    round is cut by a written table, and only two numbers reach the driver.
    Null end points and self loops are ignored; repeated rows do no harm.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        linked = both.join(low, "u")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        nxt = materialize(stars(stars(now, True), False), "stars")
        row = nxt.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        now = nxt
        if (row.n, row.s) == mark:
            break
        mark = (row.n, row.s)
    else:
        raise RuntimeError("components did not settle")
    leaves = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
