"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.sources.tables import read_table

TEXT_ROWS = 2_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the two columns an operator reads, under fixed names; other columns
    of the caller can't clash with the operator's own. Batches of texts that go to Python
    hold ``TEXT_ROWS`` rows from then on, unless the session says fewer: they are buffers
    outside the heap, on both sides."""
    conf = docs.sparkSession.conf
    if int(conf.get(_BATCH_ROWS)) > TEXT_ROWS:
        conf.set(_BATCH_ROWS, TEXT_ROWS)
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    )


def sampled(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """Up to ``rows`` rows of ``df``, which has ``total``: those of least hash of ``key``.

    Only about twice as many are looked at, so what tasks send to the last one doesn't
    grow with their number.
    """
    at = F.xxhash64(F.lit(11), key)
    share = 2 * rows / max(total, 1)
    some = df if share >= 1 else df.where(at < int((2 * share - 1) * 2**63))
    return some.orderBy(at, key).limit(rows)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(run):
    """``run``, a function for ``mapInArrow``, that gives memory back when a task ends: the
    worker may wait for its next task while the executor needs the room."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)
    return task


def groups_in_order(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Consecutive rows of sorted batches as whole groups, several groups a table.

    The last group of a batch may go on in the next one, so it is held back.
    What is held is one batch and one group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        starts = group_starts(batch, keys)
        cut = int(starts[-1])
        if cut == 0 and held and _same(held[-1], held[-1].num_rows - 1, batch, last, keys):
            held.append(batch)
            continue
        if held and not _same(held[-1], held[-1].num_rows - 1, batch, 0, keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``limit`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def group_starts(rows, keys: list[str]) -> np.ndarray:
    """Positions at which a new group of equal, non-null integer keys begins."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        values = rows.column(key).to_numpy(zero_copy_only=False) if isinstance(
            rows, pa.RecordBatch) else rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int, keys: list[str]) -> bool:
    return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c
         for c, f in zip(columns, schema, strict=True)], schema=schema)
