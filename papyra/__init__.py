"""Document collections on Spark: fluent queries, validated atomic writes, Parquet underneath."""

from papyra.operators.predicates import Predicate
from papyra.operators.query import Query
from papyra.options import AutoSync, CollectionOptions, Compression, DatabaseOptions, Format, Protection
from papyra.sources.collection import Collection, FrameCollection, WriteBatch
from papyra.sources.database import Database

__all__ = [
    "AutoSync", "Collection", "CollectionOptions", "Compression", "Database", "DatabaseOptions", "Format", "FrameCollection", "Predicate", "Protection",
    "Query", "WriteBatch",
]
