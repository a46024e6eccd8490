"""Arrow plumbing that the Python-backed operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Rows that a kernel works on at once: Spark's own Arrow batches hold 10,000 rows or 64 MB.
ROWS_PER_STEP = 400
#: Characters that a kernel works on at once, so that a run of very long texts stays small in memory.
CHARS_PER_STEP = 4_000_000

def portable(name: str) -> None:
    """Ship a module's functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches as the session makes them, at most 64 MB unless it says otherwise."""
    return df.mapInArrow(kernel, schema)


def text_steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHARS_PER_STEP) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of at most ``most`` characters (one text at least) and ROWS_PER_STEP rows, with their texts."""
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS_PER_STEP):
            batch = whole.slice(first, ROWS_PER_STEP)
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            begin = chars = 0
            for at, value in enumerate(texts):
                size = len(value or "")
                if at > begin and chars + size > most:
                    yield batch.slice(begin, at - begin), texts[begin:at]
                    begin, chars = at, 0
                chars += size
            yield batch.slice(begin), texts[begin:]


def byte_steps(batches: Iterator[pa.RecordBatch], column: str, most: int = CHARS_PER_STEP) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of a binary column (one value at least) and ROWS_PER_STEP rows."""
    for whole in row_steps(batches):
        begin = held = 0
        for at, size in enumerate(pc.binary_length(whole.column(whole.schema.get_field_index(column))).to_pylist()):
            if at > begin and held + (size or 0) > most:
                yield whole.slice(begin, at - begin)
                begin, held = at, 0
            held += size or 0
        yield whole.slice(begin)


def row_steps(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_STEP) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


portable(__name__)
