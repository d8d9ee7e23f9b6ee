"""Shared helpers: bounded Arrow blocks, byte views of text columns, tables in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text handled by one numpy pass, so that a worker's arrays stay near a hundred megabytes.
BLOCK_BYTES = 2 << 20


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system: workers live on from stage to stage, several on a machine."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each (one row may exceed it alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = offsets(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            give_back()
            start = stop


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = column.buffers()[1]
    if raw is None or not len(column):
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(raw, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: none) and the row bounds in them."""
    if column.null_count:
        column = column.fill_null("")
    off = offsets(column)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def field(name: str, kind: str | T.DataType) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind)


def extend(df: DataFrame, keep: Sequence[str], fields: Sequence[T.StructField]) -> T.StructType:
    """Schema of the kept columns and new ones; a new column replaces a kept one of its name."""
    names = {f.name for f in fields}
    return T.StructType([df.schema[c] for c in keep if c not in names] + list(fields))


def with_columns(batch: pa.RecordBatch, keep: Sequence[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [c for c in keep if c not in new]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + list(new.values()), names=kept + list(new))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all is on one machine."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not jsc.getCheckpointDir().isDefined():
        if not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return jsc.getCheckpointDir().get()


#: Tables that this session has written and not discarded.
_written: list[str] = []


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    # what is not discarded before goes when the driver ends
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_written", None)
    if path:
        _delete(df.sparkSession, path)


def let_go(spark: SparkSession) -> None:
    """Has the shuffle files deleted that no plan needs: they go when the driver's garbage collector finds so."""
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def written() -> list[str]:
    """The tables that are there now, for ``sweep``."""
    return list(_written)


def sweep(spark: SparkSession, before: list[str], keep: DataFrame) -> None:
    """Deletes the tables written since ``before`` was taken, but for ``keep``, whose rows no longer come from them."""
    for path in set(_written) - set(before) - {getattr(keep, "_written", None)}:
        _delete(spark, path)


#: Bits of a membership filter: at most this many (32 MB), so that it can go everywhere; one chunk of it is one row.
FILTER_BITS, CHUNK_BITS = 28, 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Members:
    """A filter of whole numbers: it knows all that it was made of, and few others while they are few for its size.

    With more numbers than bits it lets nearly all pass; what passes must be joined in any case.
    """

    def __init__(self, df: DataFrame, column: str):
        """Tasks send each number to its chunk; the driver gets the chunks, which are bounded whatever the table."""
        bits = 16
        many = df.count()
        while bits < FILTER_BITS and 1 << bits < 16 * many:
            bits += 1
        self.bits = bits
        chunk = min(bits, CHUNK_BITS)

        def place(batches):
            for batch in batches:
                at = _slots(batch.column(0).to_numpy(zero_copy_only=False), bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> chunk).astype(np.int32)), pa.array((at & (1 << chunk) - 1).astype(np.int32))], names=["chunk", "at"])

        def fill(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                of, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for k in np.unique(of).tolist():
                    held.setdefault(k, np.zeros(1 << chunk, bool))[at[of == k]] = True
            for k, x in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], names=["chunk", "bits"])

        self.words = np.zeros(1 << (bits - 3), np.uint8)
        size = 1 << (chunk - 3)
        placed = df.select(column).filter(f"{column} IS NOT NULL").mapInArrow(place, "chunk int, at int").repartition("chunk")
        for r in placed.mapInArrow(fill, "chunk int, bits binary").toLocalIterator():
            self.words[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def maybe(self, values: np.ndarray) -> np.ndarray:
        at = _slots(values, self.bits)
        return (self.words[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (values.astype(np.int64).view(np.uint64) * _ODD >> np.uint64(64 - bits)).astype(np.int64)
