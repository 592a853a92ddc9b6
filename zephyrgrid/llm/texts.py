"""New columns from whole texts, in Arrow batches; all other columns pass unchanged."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from zephyrgrid.llm.ship import ship

ROWS, CHARS = 512, 2_000_000  # of one call; a longer text is a call of its own


def pieces(batch: pa.RecordBatch, column: str | int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of rows and bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=float)
    low, before = 0, 0.0
    while low < batch.num_rows:
        high = min(low + ROWS, max(low + 1, int(np.searchsorted(ends, before + CHARS))))
        high = min(high, batch.num_rows)
        yield batch.slice(low, high - low)
        low, before = high, ends[high - 1]


BATCH_ROWS, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_held: dict = {}
_claimed: list[bool] = [False]


def small_batches(spark) -> None:
    """Rows of whole texts go to workers as many at a time as a call takes, unless the session asks for another number."""
    if spark.conf.get(BATCH_ROWS, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH_ROWS, str(ROWS))


def let_go(all_kept: bool = False) -> None:
    """Return freed memory of this worker to the system; with ``all_kept`` also drop what is held for later tasks."""
    if all_kept:
        _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def held(key, make: Callable):
    """What ``make`` gives, kept in this worker for later tasks until a task of another operator starts."""
    _claimed[0] = True
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def map_texts(df: DataFrame, keep: list[str], added: str, start: Callable[[], Callable], text: str = "text") -> DataFrame:
    """The columns ``keep`` and those of the schema ``added``.

    ``start`` runs once per task and returns a function from a list of texts to a list of columns, each a
    list or an Arrow array with a value per text.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    # a text that is kept is sent once
    at = keep.index(text) if text in keep else len(keep)
    source = df.select(*keep) if at < len(keep) else df.select(*keep, df[text].alias("_llm_text"))
    fields = StructType.fromDDL(added)
    schema = StructType(source.schema.fields[:len(keep)] + fields.fields)
    arrow = to_arrow_schema(fields)

    def run(batches):
        _claimed[0] = False
        call = start()
        if not _claimed[0]:
            let_go(all_kept=True)
        for batch in batches:
            for part in pieces(batch, at):
                made = [c if isinstance(c, pa.Array) else pa.array(c, f.type)
                        for c, f in zip(call(part.column(at).to_pylist()), arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *made], names=schema.names)
        del call
        let_go()

    return source.mapInArrow(run, schema)
