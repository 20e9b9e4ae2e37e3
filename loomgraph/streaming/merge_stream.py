"""Incremental ingestion: each micro-batch of edges is merged into a versioned graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, complete
from loomgraph.operators.merge import Versions, merge


def merge_stream(edges: DataFrame, base: Graph, folder: str, checkpoint: str):
    """Start a query that merges batches of streamed edges (edge_id, source, rel, target, ..) and saves a version for each batch, once."""
    store = Versions(folder)

    def step(batch: DataFrame, number: int) -> None:
        notes = [v["note"] for v in store.list(batch.sparkSession)]
        if f"batch {number}" in notes:  # a batch that was saved before a failure
            return
        now = store.load(batch.sparkSession, len(notes)) if notes else base
        e = complete(batch)
        ends = e.select(F.col("source").alias("node_id")).union(e.select("target")).distinct()
        new = ends.select("node_id", F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("confidence"))
        store.save(merge(now, Graph(new, e, base.members.limit(0))), f"batch {number}")

    return edges.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events (ts, event_type) by tumbling window, batch or stream; late ones are dropped by watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
