"""Fronts that grow with arriving candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import costs
from ..operators.skyline import distinct_skyline


def maintain(candidates: DataFrame, path: str, checkpoint: str, keys: list[str], m: int) -> StreamingQuery:
    """Fold a stream of candidates into fronts: after batch n, ``path/n`` holds the skyline of all so far.

    A batch that is run again writes the same folder again, so the result doesn't depend on restarts.
    """
    names = [*keys, *costs(m)]

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*names)
        if n:
            rows = rows.unionByName(spark.read.parquet(f"{path}/{n - 1}"))
        distinct_skyline(rows, keys, m).write.mode("overwrite").parquet(f"{path}/{n}")

    return candidates.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
