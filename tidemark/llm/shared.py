"""What every operator of this subpackage needs: shared storage and Arrow batches of texts.

Nothing here is written to a machine-local folder on a cluster: intermediate tables go to the
folder in ``spark.checkpoint.dir``. Only where that setting is unset and Spark runs in one process, as in tests, a temporary
folder is made and set for the session; on a cluster it is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
PASS_BYTES = (1 << 19) - 1
#: Bytes of an Arrow batch between Spark and Python, where the session has not another limit than Spark's own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep what a task holds of texts to a few megabytes."""
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: F.Column, folds: int = 5) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def passes(offsets: np.ndarray, size: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a row is never cut."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def handed_back() -> None:
    """Give free memory back to the system: Spark keeps a Python worker for the stages to come, and with it what it holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than those with this library do it on their own
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(df: DataFrame, text: str, keep: list[str], schema: str, work: Callable, after: Callable[[], None] | None = None) -> DataFrame:
    """Run ``work(bytes, offsets)`` over passes of the text column, and ``after`` when a task has ended.

    ``work`` gets the bytes of some rows with offsets that start at 0 and returns a dict of Arrow
    arrays, one value a row. ``keep`` columns go along. Memory follows PASS_BYTES and the longest text.
    """

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            for a, b in passes(offsets):
                made = work(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cols = [batch.column(k).slice(a, b - a) for k in keep] + list(made.values())
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *made])
        if after:
            after()
        handed_back()

    return df.select(*keep, text).mapInArrow(run, schema)


def as_list(values: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values, kind))
