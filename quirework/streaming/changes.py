"""Change streams: documents' change events kept as state, and event-time windows.

Events are rows ``seq, ts, doc_id, kind, object_id, attr, old, new``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "seq long, ts timestamp, doc_id long, kind string, object_id string, attr string, old string, new string"
STATE = "doc_id long, object_id string, attr string, value string, changes long, seq long"


def latest(events: DataFrame) -> DataFrame:
    """State of every attribute after all events of a batch: ``doc_id, object_id, attr, value, changes``; removed objects are gone."""
    key = ["doc_id", "object_id", "attr"]
    g = events.groupBy(*key).agg(F.max_by(F.struct("kind", "new"), "seq").alias("x"), F.count("*").alias("changes"))
    return g.where("x.kind <> 'remove'").select(*key, F.col("x.new").alias("value"), "changes")


def stateful(events: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """Streaming form of ``latest``: emits an attribute's state after each batch that changes it."""

    def fold(key, batches, state: GroupState):
        value, n, seq = state.get if state.exists else (None, 0, -1)
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples(index=False):
                n += 1
                if r.seq > seq:
                    value, seq = (None if r.kind == "remove" else r.new), r.seq
        state.update((value, n, seq))
        yield pd.DataFrame([(*key, value, n, seq)], columns=["doc_id", "object_id", "attr", "value", "changes", "seq"])

    return events.groupBy("doc_id", "object_id", "attr").applyInPandasWithState(
        fold, STATE, "value string, changes long, seq long", "update", GroupStateTimeout.NoTimeout if timeout == "NoTimeout" else timeout
    )


def listen(events: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str):
    """Call a listener with each micro-batch; it is detached by stopping the returned query."""
    return events.writeStream.foreachBatch(listener).option("checkpointLocation", checkpoint).start()


def touched_documents(events: DataFrame, words: DataFrame) -> DataFrame:
    """Words of documents whose text an event changes, with the changes applied: what token views are recomputed from.

    Changes of a word's string or relation replace the value; the streams
    concerned are rebuilt as a whole, which equals any sequence of repairs.
    """
    now = latest(events.where("attr in ('str', 'rel')"))
    wide = now.groupBy("doc_id", F.col("object_id").cast("long").alias("pos")).pivot("attr", ["str", "rel"]).agg(F.first("value"))
    wide = wide.withColumnsRenamed({"str": "new_str", "rel": "new_rel"})
    hit = words.join(now.select("doc_id").distinct(), "doc_id", "left_semi").join(wide, ["doc_id", "pos"], "left")
    return hit.withColumns({"str": F.coalesce("new_str", "str"), "rel": F.coalesce("new_rel", "rel")}).drop("new_str", "new_rel")


def tumbling(events: DataFrame, width: str, watermark: str | None = None, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    e = events if watermark is None else events.withWatermark("ts", watermark)
    g = e.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, gap_seconds: int, key: str = "user_id") -> DataFrame:
    """Sessions of a key: a new one begins after more than the gap without events (batch form)."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    apart = F.col("ts").cast("double") - F.lag("ts").over(w).cast("double") > gap_seconds
    e = events.withColumn("session", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(w))
    return e.groupBy(key, "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
