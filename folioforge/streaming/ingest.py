"""A stream of manifest entries worked through exactly once: each micro-batch is a run of the work ledger.

Structured Streaming repeats a micro-batch with the same number after a failure. The ledger then finds the units that were
done and leases the others again, so that no record is skipped and none is processed twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.incremental import WorkLedger


def process_stream(stream: DataFrame, ledger: WorkLedger, key: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, units: int = 8) -> StreamingQuery:
    """Start working through the stream; results lie under the ledger's output paths."""

    def batch(df: DataFrame, number: int) -> None:
        ledger.process(number, df, key, work, units)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
