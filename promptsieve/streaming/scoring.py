"""Online pre-filter: prompts arrive, labels leave.

Features regroup the terms of a prompt, which inside a streaming plan would need state; in ``foreachBatch`` each
micro-batch is a plain DataFrame and the batch features apply unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptsieve.functions.text import normalize
from promptsieve.plans.experiment import Classifier


def start_scoring(prompts: DataFrame, clf: Classifier, sink: str, checkpoint: str,
                  available_now: bool = True, trigger: str = "10 seconds") -> StreamingQuery:
    """Score a stream of (row_id, text) into ``sink/batch_id=<n>``.

    A batch writes its own folder and overwrites it on replay, so a restart neither loses nor repeats rows.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        clean = batch.select("row_id", normalize(F.col("text")).alias("text"))
        (clf.score(clean).select("row_id", "y_pred", (F.col("y_pred") > 0).alias("blocked"),
                                 F.array_max("probability").alias("confidence"))
         .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}"))

    writer = prompts.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
