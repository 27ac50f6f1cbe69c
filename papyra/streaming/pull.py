"""Pull iteration over a DataFrame, one partition in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row


def pull(df: DataFrame, batch_size: int = 64, check: Callable[[], None] | None = None) -> Iterator[Row]:
    """Rows in partition order.  The next partition is fetched only when it is reached; stopping early is fine."""
    size = max(1, batch_size)
    for i, row in enumerate(df.toLocalIterator(prefetchPartitions=False)):
        if check is not None and i % size == 0:
            check()
        yield row
