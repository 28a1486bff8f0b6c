"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one numpy or model pass takes at most (a longer row goes alone).
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset and Spark runs inside this process, as in tests, a
    temporary folder is made; on a cluster that would be a disk of its own on
    each machine, so there an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lumicell-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    own = f"{shared_dir(spark)}/lumicell/{spark.sparkContext.applicationId}"
    fs, where = _hadoop(spark, own)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{own}/{uuid.uuid4().hex}"


#: Bytes of a row group of saved tables: a writer holds one for each task.
ROW_GROUP = 16 << 20
#: Rows of an Arrow batch between Spark and Python while a table is saved: long texts and sets come in small batches.
BATCH_ROWS = 1024


_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> int:
    """Bound the rows of Arrow batches in this session from now on; gives the setting before."""
    before = int(spark.conf.get(_BATCH_KEY))
    spark.conf.set(_BATCH_KEY, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the rows of Arrow batches for what runs inside."""
    before = bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, str(before))


_BYTES_KEY, _VECTOR_KEY = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


def bound_bytes(spark: SparkSession, size: int) -> None:
    """Bound the bytes of Arrow batches (beyond their last row) in this session from now on."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    spark.conf.set(_BYTES_KEY, str(min(now, size) if now > 0 else size))


@contextmanager
def small_reads(spark: SparkSession, size: int, rows: int) -> Iterator[None]:
    """Bound the bytes of Arrow batches, and the rows of a Parquet reader's column vectors, for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in (_BYTES_KEY, _VECTOR_KEY)}
    bound_bytes(spark, size)
    spark.conf.set(_VECTOR_KEY, str(min(int(spark.conf.get(_VECTOR_KEY)), rows)))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def saved(df: DataFrame, **options: int) -> DataFrame:
    """Write to the shared folder as Parquet and read back: cuts the lineage,
    survives lost executors and is columnar, unlike checkpoint().

    The table goes when discard() is called or the application ends.
    `options` are the writer's, beyond its row groups' size or in place of it.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    with small_batches(spark):
        df.write.options(**{"parquet.block.size": ROW_GROUP} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumicell_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing still to be run reads."""
    for df in tables:
        path = getattr(df, "_lumicell_path", None)
        if path:
            fs, where = _hadoop(df.sparkSession, path)
            fs.delete(where, True)


#: Tasks that a small table is worked on in, at least.
LEAST_TASKS = 12


def fewer(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """df in no more tasks than `rows` rows are worth, but LEAST_TASKS: neighbouring partitions go together without a shuffle."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // per_task)))


def ascii_lower(col):
    """Lower-case A-Z only.  A text without multi-byte characters takes the
    fast built-in; only others pay for the character map."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def crc_mod(col, m: int):
    """crc32 of the id as text, modulo m: the fold of a row."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(m))


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its tasks, and others need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds bounded rows and bytes of a column."""
    yield from _sliced(batches, column, rows, size)
    give_back()


def _sliced(batches: Iterator[pa.RecordBatch], column: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, a = batch.num_rows, 0
        if n == 0:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        while a < n:
            b, held = a, 0
            while b < n and b - a < rows and (held == 0 or held + lengths[b] <= size):
                held += int(lengths[b])
                b += 1
            yield batch.slice(a, b - a)
            a = b


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys up to which a list of rows to drop is broadcast: about 64 MB.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of docs whose key columns (those of `dropped`) are not in `dropped`; null keys are equal to each other.

    Rows that share their keys go or stay together.  The keys are broadcast
    only if they are few; else both sides shuffle.
    """
    dropped = saved(dropped.distinct())
    small = dropped.count() <= BROADCAST_KEYS
    dropped = dropped.select([F.col(c).alias(f"_drop_{c}") for c in dropped.columns])
    on = reduce(Column.__and__, [docs[c.removeprefix("_drop_")].eqNullSafe(dropped[c]) for c in dropped.columns])
    return docs.join(F.broadcast(dropped) if small else dropped.hint("merge"), on, "left_anti")


#: The threshold on a hash is taken out of 63 bits, so it stays above 0 for any number of rows.
_HASH_RANGE = 1 << 63


def sample_threshold(rows: int, n: int) -> int:
    """Hash values (0 to 2**63 - 1) below this make a sample of about `rows` of n rows."""
    return _HASH_RANGE - 1 if n <= rows else max(1, rows * _HASH_RANGE // n)


def bounded_sample(rows: DataFrame, limit: int, *key: str, known: int | None = None) -> DataFrame:
    """About `limit` rows, or all if there are no more, written once.

    Drawn by a hash of the key columns, so that the same rows come on any
    cluster.  `known` is the number of rows where it is known already.  Whole
    rows that repeat very often could bring more than twice the limit; then the
    sample is cut there.  A non-empty frame never gives an empty sample: that is
    an error.
    """
    n = rows.count() if known is None else known
    if n > limit:
        rows = rows.where(F.xxhash64(*key).bitwiseAND(F.lit(_HASH_RANGE - 1)) < F.lit(sample_threshold(limit, n)))
    out = saved(rows)
    if n > limit:
        got = out.count()
        if got == 0:
            raise RuntimeError(f"a sample of {limit} of {n} rows came out empty")
        if got > 2 * limit:
            return saved(out.limit(2 * limit))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, fold, rows: int) -> DataFrame:
    """About `rows` rows of (doc_id, text, label) with a label, in the fold, written once.

    The sample is drawn from the narrow labels and then broadcast: its size is
    bounded by `rows`, texts don't shuffle, and the documents are read once.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & fold).select("doc_id", F.col(column).alias("label"))
    known = bounded_sample(known, rows, "doc_id")
    return saved(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
