"""Continuous indexing: new files of a directory go into the store as they come. An addition; deletions need a batch update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsift.plans.engine import Engine
from docsift.sources.files import below, usable


def watch(engine: Engine, collection: str, path: str, checkpoint: str, pattern: str = "*.md", once: bool = False) -> StreamingQuery:
    """Start the stream; with ``once`` it ends when what is there has been taken in. A batch that is repeated changes nothing."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = engine.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)

    def take(batch: DataFrame, _: int) -> None:
        came = batch.select(F.lit(collection).alias("collection"), below(engine.spark, path).alias("path"), usable("content").alias("body"))
        known = engine.store.table("documents").where(F.col("active") & (F.col("collection") == collection))
        # What isn't in the batch stays: it is handed on without text, which counts as present.
        rest = known.join(came.select("path"), "path", "left_anti").select("collection", "path", F.lit(None).cast("string").alias("body"))
        engine.ingest(came.unionByName(rest), [collection])

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
