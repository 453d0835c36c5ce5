"""Work shared out by rows, not by bytes, and groups of rows handed to Python one after the other.

A few megabytes can mean hours of work on their rows, so neither the splits of a file nor the merging
of small shuffle partitions may decide how many tasks take part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

ROWS_A_BATCH = 5000


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df hashed by keys over as many tasks as a shuffle has, and no fewer than there are cores; no task is merged away."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of each group of a partition sorted by keys; one batch and one group are held at a time."""
    held: list[dict] = []
    own = None
    for batch in batches:
        names = batch.schema.names
        columns = [[None] * len(c) if c.null_count == len(c) else c.to_pylist() for c in batch.columns]
        for values in zip(*columns, strict=True):
            row = dict(zip(names, values, strict=True))
            key = tuple(row[k] for k in keys)
            if held and key != own:
                yield held
                held = []
            own = key
            held.append(row)
    if held:
        yield held


def in_batches(groups: Iterable[list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Lists of rows as record batches of about ROWS_A_BATCH rows."""
    rows: list[dict] = []
    for group in groups:
        rows += group
        if len(rows) >= ROWS_A_BATCH:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
