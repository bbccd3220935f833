"""An exactly-once sink: every micro-batch is one commit under a key made of the stream's name and its batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fernlake.sources.write import append, part_key


def sink(lake, table: str, name: str, shard: str = "0"):
    """For foreachBatch: a batch that is given again, after a restart, is a duplicate and adds nothing."""
    qualified = lake.qualify(table)

    def put(batch: DataFrame, batch_id: int) -> None:
        append(lake.spark, lake.log, qualified, batch, key=part_key(f"stream:{name}", batch_id), shard=shard)

    return put


def write_stream(lake, stream: DataFrame, table: str, name: str, checkpoint: str, *, trigger: dict | None = None, shard: str = "0") -> StreamingQuery:
    """Start the ingestion of a stream.  Late rows are never dropped: they go into files of their own."""
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(sink(lake, table, name, shard))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
