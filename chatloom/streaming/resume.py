"""An extension: model calls over a stream of new conversations, each key answered once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chatloom.sources import slices


def answer_stream(rows: DataFrame, key: str, out: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Answers to each key of a stream, once: read them by :func:`chatloom.sources.slices.read` with ``form="parquet"``.

    Keys that were met before are known to the stream's own state. A micro-batch is written under its number and committed
    after that: one that is repeated after a crash is skipped if it was committed, and overwritten if not. Output is never read.
    """

    def batch(df: DataFrame, number: int) -> None:
        name = f"batch-{number:012}"
        if slices.is_committed(df.sparkSession, out, name):
            df.write.format("noop").mode("overwrite").save()  # for the state of keys that the batch updates
            return
        answer(df).write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
        slices.commit(df.sparkSession, out, name, {"data": name})

    once = rows.where(rows[key].isNotNull()).dropDuplicates([key])
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
