"""Matching a stream of rosters against a standing registry, batch by batch.

Resolution looks at all records of a batch at once (a contested id is a property of the batch), so it runs per
micro-batch; each batch's parts are appended with its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterloom.operators.match import match_npi


def match_stream(rosters: DataFrame, registry: DataFrame, sink: str, checkpoint: str, *, id: str, trigger: dict | None = None, on_batch: Callable[[int], None] | None = None, **mapping) -> StreamingQuery:
    """Writes every roster row with npi, reason and disposition to ``sink`` (Parquet); a repeated batch overwrites itself."""

    def run(batch: DataFrame, number: int) -> None:
        found = match_npi(batch, registry, id=id, **mapping)
        out = found.assigned.withColumnRenamed("__disposition", "disposition").withColumn("batch_id", F.lit(number))
        out.write.mode("overwrite").parquet(f"{sink}/batch_id={number}")
        if on_batch:
            on_batch(number)

    return rosters.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
