"""Session helpers shared by the corpus operators: shared-folder staging, Arrow batches, lookup by key blocks."""

from __future__ import annotations

import atexit
import functools
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import attach, shared_dir

#: Arrow rows a batch; texts can be long, so batches are kept short.
ARROW_ROWS = 1000
#: Bytes of text that one chunk of documents holds (a single longer document is a chunk of its own).
CHUNK_BYTES = 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    attach(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def parts(spark: SparkSession) -> int:
    """Number of partitions that exchanges deal to; it follows the cluster's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and returns it read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop(*staged: DataFrame) -> None:
    """Removes staged tables that nothing reads any more; those that a result still reads go at exit."""
    for df in staged:
        _remove(df.sparkSession, df._stage_path)


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the n+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, ends - ends[0]


def blocks(buf: np.ndarray, off: np.ndarray, size: int = 1 << 20):
    """(first, last) rows of runs of documents of about size bytes; a longer document is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Chunks:
    """Cuts a stream of Arrow batches into chunks of whole documents, alike on every reading of the same partition."""

    def __init__(self, columns: list[str], limit: int = CHUNK_BYTES):
        self.columns, self.limit = columns, limit

    def __call__(self, batches):
        """Yields (chunk id, table)."""
        from pyspark import TaskContext

        context = TaskContext.get()
        part, k, held, size = context.partitionId() if context else 0, 0, [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(self.columns)
            lengths = texts_of(table.column("text"))[1]
            begin = 0
            while begin < table.num_rows:
                room = self.limit - size
                end = int(np.searchsorted(lengths, lengths[begin] + room, side="right")) - 1
                end = max(end, begin + (not held))
                end = min(end, table.num_rows)
                if end > begin:
                    held.append(table.slice(begin, end - begin))
                    size += int(lengths[end] - lengths[begin])
                if end < table.num_rows or size >= self.limit:
                    yield (part << 24) | k, pa.concat_tables(held).combine_chunks()
                    k, held, size = k + 1, [], 0
                    trim()
                begin = end
        if held:
            yield (part << 24) | k, pa.concat_tables(held).combine_chunks()


def slices(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n value ranges in sorted 64-bit keys."""
    at = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, at, side="left"), [len(keys)]])


@functools.lru_cache(1)
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives memory that a chunk has freed back to the system: workers live on and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


_kept: list = []


def kept(function):
    """What the function returns stays in this worker from task to task, until an operator without use for it calls free."""
    out = functools.lru_cache(2)(function)
    _kept.append(out)
    return out


def free() -> None:
    """Forgets what earlier operators kept in this worker, which lives on beside other stages, and gives the memory back."""
    if any(f.cache_info().currsize for f in _kept):
        for f in _kept:
            f.cache_clear()
        trim()


def table_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def key_bytes(*values) -> bytes:
    return struct.pack(f"<{len(values)}q", *values)
