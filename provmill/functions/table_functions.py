"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from provmill.operators.dag import _closed


@udtf(returnType="path_id string, step_id string")
class Ancestors:
    """(path_id, step_id): what the heads of a path descend from, themselves included.

    ``SELECT * FROM ancestors(TABLE(t) PARTITION BY path_id ORDER BY pos)``; ``t``
    has path_id, step_id, parents and head, on each row of a path or on some.  A
    path's ids are held in a task's memory; larger paths are for
    ``dag.ancestor_ids``.  Of steps with equal ids the last one counts, a head or
    parent that is no step is part of the result, cycles end, a path without a
    head or an empty table gives no row.
    """

    def __init__(self) -> None:
        self.path: str | None = None
        self.last: dict = {}
        self.heads: set = set()

    def eval(self, row: Row) -> None:
        self.path = row["path_id"]
        self.last[row["step_id"]] = row["parents"]
        if row["head"] is not None:
            self.heads.add(row["head"])

    def terminate(self) -> Iterator[tuple[str | None, str]]:
        for step in _closed(self.last, list(self.heads)):
            yield self.path, step


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("ancestors", Ancestors)
