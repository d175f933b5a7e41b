"""Shared by the operators of this folder."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from medloom.runtime import checkpoint_dir, ship, table

#: Rows and bytes of one Arrow batch: what bounds a Python worker's memory besides one text.
BATCH_ROWS = 1500
BATCH_BYTES = 6 << 20
#: Bytes of texts that a function is given at a time; a longer text comes alone.
SLICE_BYTES = 2 << 20
#: Bits of a map of hashes: its size is fixed (8 MB), more bits leave more out.
BITS = 1 << 26
#: Values of a total that one row carries from task to task.
PIECE = 1 << 15


def prepare(spark: SparkSession) -> None:
    """Ship the package, name the checkpoint folder and bound the Arrow batches."""
    ship(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(spark: SparkSession) -> None:
    """Prepare for an operator that follows others: shuffle files, checkpoints and broadcasts of what
    ran before go when the driver's garbage is collected, so that is asked for."""
    prepare(spark)
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "documents")


def slices(batch: pa.RecordBatch):
    """The batch in stretches of at most SLICE_BYTES of strings, or of one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += np.asarray(pc.fill_null(pc.binary_length(column), 0))
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over df, where function takes a RecordBatch with rows and returns a dict of columns
    or None. It gets bounded stretches of Spark's batches, so a worker's memory is bounded too."""
    prepare(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = function(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def bit_map(hashes: DataFrame, column: str) -> np.ndarray:
    """A map of BITS bits, those of the column's values set, in words of 64: of fixed size, however
    many rows there are. The driver gets its words; it is what a broadcast holds."""
    bit = F.pmod(F.col(column), F.lit(BITS))
    words = hashes.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, {BITS}) & 63 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(np.uint64)
    return out


def in_map(shown: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be among those of the map: all that are, and few others."""
    bit = values.view(np.int64) & (BITS - 1)
    return (shown[bit >> 6] >> (bit & 63).view(np.uint64) & np.uint64(1)).astype(bool)


def totals(df: DataFrame, add, width: int, kind: type) -> dict[int, np.ndarray]:
    """Totals over all rows of df: add(batch, out) adds to the arrays out[key], each of `width` values
    of that kind. A task sends what isn't zero of its arrays in pieces; other tasks add up those of
    equal place, in the order of the tasks, so the result doesn't depend on which comes first. The
    driver gets one array for each key, whatever the number of rows."""

    def run(batches):
        out: dict = defaultdict(lambda: np.zeros(width, kind))
        for batch in batches:
            for part in slices(batch):
                add(part, out)
            pa.default_memory_pool().release_unused()
        task = TaskContext.get().partitionId()
        for key in sorted(out):
            for start in range(0, width, PIECE):
                piece = out[key][start : start + PIECE]
                if piece.any():
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "start": pa.array([start], pa.int64()), "task": pa.array([task], pa.int64()), "own": pa.array([piece.tobytes()], pa.binary())})

    def merge(batches):
        row = lambda: pa.RecordBatch.from_pydict({"key": pa.array([place[0]], pa.int64()), "start": pa.array([place[1]], pa.int64()), "own": pa.array([total.tobytes()], pa.binary())})
        place, total = None, None
        for batch in batches:
            for key, start, own in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (key, start) != place:
                    if place:
                        yield row()
                    place, total = (key, start), np.zeros(len(own) // np.dtype(kind).itemsize, kind)
                total += np.frombuffer(own, kind)
        if place:
            yield row()

    prepare(df.sparkSession)
    pieces = df.mapInArrow(run, "key bigint, start bigint, task bigint, own binary").repartition("key", "start").sortWithinPartitions("key", "start", "task")
    found = pieces.mapInArrow(merge, "key bigint, start bigint, own binary").toArrow()
    out: dict = defaultdict(lambda: np.zeros(width, kind))
    for key, start, own in zip(*(found.column(c) for c in range(3))):
        piece = np.frombuffer(own.as_buffer(), kind)
        out[key.as_py()][start.as_py() : start.as_py() + len(piece)] = piece
    return out
