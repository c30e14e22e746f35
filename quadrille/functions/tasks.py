"""How many tasks share a step."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files for each task of a step that sorts or groups all rows: rows in memory take many times their bytes in files.
TASK_BYTES = 4_000_000


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads; 0 if there are none, or tables that are no files, whose size nobody knows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.nodeName() == "LocalRelation":
            continue
        if leaf.nodeName() != "LogicalRelation" and not leaf.nodeName().startswith("Relation"):
            return 0
        total += int(str(leaf.stats().sizeInBytes()))
    return total


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for the rows of a plan, so that a task's share doesn't grow with the input; 0: few enough for adaptive execution to choose."""
    n = -(-file_bytes(df) // task_bytes)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """The rows by hash of the keys over so many tasks, which adaptive execution leaves alone."""
    return df.repartition(tasks, *keys) if tasks else df
