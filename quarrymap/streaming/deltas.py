"""Applying deltas as they arrive: each micro-batch of removed unit ids and added rows makes the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarrymap.operators.delta import EDGES, apply_delta
from quarrymap.sources import store


def follow(spark: SparkSession, removed_units: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """A query that removes the units (column ``id``) of a stream from the store at ``root``, once a batch."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            now, old = store.manifest(spark, root) or {}, store.load_facts(spark, root)
            ids = batch.select("id").distinct()
            # Symbols go with their unit and edges with their symbols, so where no symbol goes these tables are taken over.
            idle = old["symbols"].join(ids.withColumnRenamed("id", "unit_id"), "unit_id", "left_semi").isEmpty()
            same = ("symbols", *EDGES) if idle else ()
            store.write_snapshot(spark, root, apply_delta(old, removed={"units": ids}), now.get("commit", "unknown"), fingerprint=now.get("fingerprint"), same=same)

    return removed_units.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
