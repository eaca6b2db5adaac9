"""Work on bounded rows in one task, away from the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def in_one_task(rows: DataFrame, work: Callable[[pa.Table | None], object]) -> object:
    """``work`` on all ``rows``, whose number is bounded by a parameter of the caller, in one task; its result comes back. Without rows it gets None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(pa.Table.from_batches(parts) if parts else None))], pa.binary())], ["out"])

    got = rows.repartition(1).mapInArrow(run, "out binary").collect()
    return pickle.loads(bytes(got[0]["out"])) if got else work(None)
