"""Extension: a collection's new documents as a Structured Streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame

from papyra.errors import UnsupportedOperation
from papyra.sources.collection import Collection
from papyra.sources.snapshot import DATA


def changes(collection: Collection, max_files: int = 1000) -> DataFrame:
    """Documents as they are inserted or replaced, in commit order, with _seq.  Deletions don't show.

    Rewrites by compact() come again as documents; downstream deduplicates by id and _seq.
    """
    if collection._secret is not None:
        raise UnsupportedOperation("a stream over encrypted segments")
    reader = collection.spark.readStream.schema(collection._stored()).option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(collection._files.at(f"{collection.name}/{DATA}"))
    keep = [*(collection.schema.names if collection.schema is not None else ["doc"]), "_seq"]
    return rows.select(*(f"`{c}`" for c in keep))
