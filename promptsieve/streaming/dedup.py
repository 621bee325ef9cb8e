"""Online exact deduplication by lower-cased text: within a watermark, or for all time with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptsieve.functions.text import exact_key


def deduplicated(prompts: DataFrame, time_column: str, text_column: str = "text", delay: str = "1 hour") -> DataFrame:
    """First arrival of every text; a copy within ``delay`` of it is dropped. For streams only; a table has ``operators.dedup``.

    State holds one 64-character key per text seen within the delay, not the text.
    """
    return (prompts.withWatermark(time_column, delay).withColumn("text_key", exact_key(F.col(text_column)))
            .dropDuplicatesWithinWatermark(["text_key"]))


def start_deduplication(prompts: DataFrame, sink: str, checkpoint: str, text_column: str = "text", ttl: str = "1 hour",
                        available_now: bool = True, trigger: str = "10 seconds") -> StreamingQuery:
    """First arrival of every text of a stream, with ``text_key``, into ``sink/batch_id=<n>``.

    State answers for the time-to-live: it holds the keys that arrived within ``ttl``, counted by arrival, so no row is too
    late for it. What the state lets pass is compared with the keys that earlier batches stored in the sink, so no copy
    survives at any distance. A batch writes its own folder and overwrites it on replay, and reads only folders of earlier batches.
    NULL texts are copies of each other. The columns ``text_key`` and ``_arrival`` must not be in the stream.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.drop("_arrival")
        if batch_id > 0:
            stored = (batch.sparkSession.read.schema("text_key string, batch_id bigint").parquet(sink)
                      .where(F.col("batch_id") < batch_id).select(F.col("text_key").alias("_stored")))
            fresh = fresh.join(stored, F.col("text_key").eqNullSafe(F.col("_stored")), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    keyed = (prompts.withColumns({"_arrival": F.current_timestamp(), "text_key": exact_key(F.col(text_column))})
             .withWatermark("_arrival", ttl).dropDuplicatesWithinWatermark(["text_key"]))
    writer = keyed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
