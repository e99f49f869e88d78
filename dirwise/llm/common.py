"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows handed to a Python step at once are cut into slices of this many rows, so that its own memory follows the slice.
SLICE = 512
#: ... and of this many bytes of texts.
SLICE_BYTES = 4 << 20


def text_or_empty(name: str = "text") -> Column:
    """The column as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``rows`` rows and ``size`` bytes of texts; a single longer row is a part by itself."""
    for batch in batches:
        weight = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        before = np.r_[0, weight.cumsum()]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(before, before[start] + size, "right")) - 1
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``, whatever the optimizer does with projections."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reachable(spark) -> None:
    """Let Python workers find this library where the cluster holds it at the same place as the driver; with --py-files it is not needed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
