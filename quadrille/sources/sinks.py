"""Sinks for generated metrics: write requests, built in batches and sent from the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wire

#: Samples of a request.
BATCH = 2000


def write_requests(samples: DataFrame, batch: int = BATCH) -> DataFrame:
    """(body, samples): snappy write requests of rows (name, labels, ts, v), at most ``batch`` samples each; a series' samples stay in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                rows = [(dict(labels) | {"__name__": name}, ts, v) for name, labels, ts, v in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([wire.encode_remote_write(rows)], pa.binary()), pa.array([len(rows)], pa.int32())], ["body", "samples"])

    ordered = samples.select("name", "labels", "ts", "v").repartition(F.xxhash64("name", F.array_sort(F.map_entries("labels")))).sortWithinPartitions("ts")
    return ordered.mapInArrow(run, "body binary, samples int")


def send(requests: DataFrame, post: Callable[[bytes], None], attempts: int = 3) -> None:
    """Hand each body to ``post`` on the executors; a request that keeps failing fails the task, which Spark runs again: receivers see
    samples once or more."""

    def run(rows: Iterator) -> None:
        for row in rows:
            for attempt in range(attempts):
                try:
                    post(bytes(row.body))
                    break
                except OSError:
                    if attempt == attempts - 1:
                        raise

    requests.select("body").foreachPartition(run)
