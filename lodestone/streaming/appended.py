"""New items as a stream: each micro-batch is indexed, checked and appended, to the rows that one batch would give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.search import keyword_index


def index_stream(items: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the keyword index of newly arrived items to a table, a folder for each batch; ids that a batch repeats are taken
    once. A batch that is run again, as after a failure, writes its folder anew, so that its items stand there once."""
    def add(batch: DataFrame, number: int) -> None:
        keyword_index(batch.dropDuplicates(["id"])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
