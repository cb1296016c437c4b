"""Compare each micro-batch of a stream with a static table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..operators.diff import Comparison


def compare_stream(stream: DataFrame, reference: DataFrame, keys: Sequence[str], sink: Callable[[DataFrame, int], None], tolerance: float = 0.01, **options):
    """A stream writer whose batches go, as differing cells against ``reference``, to ``sink(cells, batch_id)``.

    Start it with ``.option("checkpointLocation", ...).start()``; a batch that is
    run again gets the same id, so an idempotent sink gives exactly-once results.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(Comparison(batch, reference, keys=keys, tolerance=tolerance, **options).cells(tolerance), batch_id)

    return stream.writeStream.foreachBatch(each)
