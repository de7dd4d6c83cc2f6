"""Structured Streaming into a runtime: each micro-batch is inserted and polled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cinderlog.functions.scratch import stored
from cinderlog.runtime import Runtime


def feed(runtime: Runtime, relation: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Facts are sets, so late and repeated rows need no care; a replayed batch changes nothing."""

    def take(batch: DataFrame, _id: int) -> None:
        runtime.insert_df(relation, stored(batch, "batch"))
        runtime.poll()  # only what is new in the batch is kept

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
