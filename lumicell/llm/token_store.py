"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

Format.  A store is a folder of three Parquet tables, from which alone it can
be decoded:

    ranks   rank, id            the vocabulary by corpus frequency (ties: smaller id first)
    files   file, start         ids before each file's first document
    blocks  file, block, start, docs, ids, data

Files are in ascending order of doc_id, blocks in order within a file, and
`start` of a block counts the ids before it in its file.  `data` is

    magic "TIDS" | documents u32 | ids u32 | doc_id i64 x documents
    | null mark u8 x documents | length u32 x documents
    | control bytes, ceil(ids / 4) | data bytes

An id is written as its rank in as few of one to four little-endian bytes as
hold it.  The byte counts, two bits an id, stand apart in the control bytes, so
that decoding is a table lookup (256 x 4 lengths), a cumulative sum and a
gather, all in numpy.

Scale.  Texts are tokenized once and never shuffle.  Their ids (two bytes each
where the vocabulary allows) are written, counted, and dealt once by range of
(doc_id, length, hash, row number): ranges come from samples, and since no two
rows share that key, a doc_id that very many rows share is split like any
other.  Driver and broadcast see the vocabulary's counts and one total a file
(at most MAX_FILES).

Memory.  Between Spark and Python go batches of BATCH_BYTES and one row more,
vectors of a Parquet reader hold VECTOR_ROWS rows, and row groups and pages that
are written here are small: batches don't grow with a table's splits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_bytes, discard, give_back, saved, slices, small_batches, small_reads
from .encode import encoder, forget

#: Ids of a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 16
#: Rows of a file aimed at, and the most files.
FILE_ROWS, MAX_FILES = 6144, 200_000
#: Bytes of an Arrow batch, and of texts that are encoded in one pass; rows of a Parquet reader's vectors.
BATCH_BYTES, VECTOR_ROWS = 1 << 20, 256
#: Bytes of a row group of the saved ids and of the blocks, and of a page (larger pages are huge objects to an
#: executor of 2 GB); both are looked at after so few rows, else a page would hold 100 blocks.
WRITTEN = {"parquet.block.size": 4 << 20, "parquet.page.size": 256 << 10, "parquet.page.size.row.check.min": 2}

_MAGIC = b"TIDS"
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack_ids(values: np.ndarray) -> bytes:
    """Control bytes, then data bytes."""
    v = np.asarray(values, np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        longer = size > k
        data[at[longer] + k] = (v[longer] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes() + data.tobytes()


def unpack_ids(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    control = raw[: -(-n // 4)]
    data = np.concatenate([raw[len(control) :], np.zeros(3, np.uint8)]).astype(np.uint32)
    size = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size) - size
    out = data[at] if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        out[longer] |= data[at[longer] + k] << np.uint32(8 * k)
    return out


def write_block(doc_ids: list, lengths: list[int], ranks: np.ndarray) -> bytes:
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = _MAGIC + struct.pack("<II", len(doc_ids), len(ranks))
    return head + ids.tobytes() + nulls.tobytes() + np.array(lengths, "<u4").tobytes() + pack_ids(ranks)


def read_block(block) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids (None where null), lengths and ranks."""
    block = memoryview(block)
    if bytes(block[:4]) != _MAGIC:
        raise ValueError("not a block of token ids")
    docs, n = struct.unpack_from("<II", block, 4)
    ids = np.frombuffer(block, "<i8", docs, 12)
    nulls = np.frombuffer(block, np.uint8, docs, 12 + 8 * docs)
    lengths = np.frombuffer(block, "<u4", docs, 12 + 9 * docs).astype(np.int64)
    return [None if z else int(i) for i, z in zip(ids, nulls)], lengths, unpack_ids(block[12 + 13 * docs :], n)


def _cells(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    """All ids of a column of binary cells, in order."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(dtype) if data is not None and off[-1] > off[0] else np.zeros(0, dtype)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, keep_space: bool, end_id: int) -> None:
    """Write the store of (doc_id, text) to the folder `path`, which must not hold one.

    Rows go in ascending doc_id order, null doc_ids first; rows that share a
    doc_id follow each other, shorter ones first, and stay documents of their
    own, also if they are equal.  A null or empty text has the end id alone; a
    very long one is a block of its own.  Of an empty table the store has no
    blocks.  Other columns are ignored, whatever their names.
    """
    with small_reads(docs.sparkSession, BATCH_BYTES, VECTOR_ROWS):
        _write(docs, path, tokenizer, keep_space, end_id)


def _write(docs: DataFrame, path: str, tokenizer: str, keep_space: bool, end_id: int) -> None:
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    dtype = encoder(tokenizer, keep_space).dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keep_space)
        for b in slices(batches, "text", size=BATCH_BYTES):
            ids, off = enc.encode(b.column("text"))
            ids = np.insert(ids, off[1:], end_id)
            n = np.diff(off) + 1
            at = np.r_[0, np.cumsum(n)] * dtype.itemsize
            cells = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), cells], ["doc_id", "n", "ids"])

    encoded = docs.mapInArrow(encode, "doc_id bigint, n bigint, ids binary")
    encoded = saved(encoded.select("*", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row")), **WRITTEN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(1, np.int64)
        for b in batches:
            c = np.bincount(_cells(b.column("ids"), dtype))
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_rank = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    spark = docs.sparkSession
    # as an Arrow table: from Python rows, executors would start further workers to convert them
    ranks = pa.table({"rank": pa.array(np.arange(len(by_rank))), "id": pa.array(by_rank, pa.int64())})
    spark.createDataFrame(ranks, "rank bigint, id bigint").coalesce(1).write.parquet(f"{path}/ranks")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        file, block, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        lengths: list[int] = []
        ranks: list[np.ndarray] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal keys, lengths, ranks, held, block, start
            data = write_block(keys, lengths, np.concatenate(ranks))
            row = [file, block, start, len(keys), held, data]
            block, start = block + 1, start + held
            keys, lengths, ranks, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES)], _BLOCK_NAMES)

        for b in batches:
            ids, n = rank[_cells(b.column("ids"), dtype)], b.column("n").to_pylist()
            at = 0
            for doc, size in zip(b.column("doc_id").to_pylist(), n):
                if keys and held + size > BLOCK_IDS:
                    yield emit()
                keys.append(doc)
                lengths.append(size)
                ranks.append(ids[at : at + size])
                at += size
                held += size
        if keys:
            yield emit()
        give_back()

    files = min(MAX_FILES, max(1, -(-encoded.count() // FILE_ROWS)))
    order = [F.col("doc_id").asc_nulls_first(), "n", "h", "row"]
    dealt = encoded.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    with small_batches(spark):
        dealt.mapInArrow(blocks, "file int, block int, start bigint, docs int, ids bigint, data binary").write.options(**WRITTEN).parquet(f"{path}/blocks")
    discard(encoded)
    # one row a file: at most MAX_FILES
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = spark.read.parquet(f"{path}/blocks").groupBy("file").agg(F.sum("ids").alias("n"))
    totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("start")).coalesce(1).write.parquet(f"{path}/files")


_BLOCK_NAMES = ["file", "block", "start", "docs", "ids", "data"]
_BLOCK_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of each document, decoded from the store alone.

    Rows are decoded when the frame is used, so from now on Arrow batches of
    this session have BATCH_BYTES and one row more at most: a split of blocks
    is not one batch.
    """
    bound_bytes(spark, BATCH_BYTES)
    ids_of = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy().astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for file, start, data in zip(*(b.column(c) for c in ("file", "start", "data"))):
                keys, lengths, ranks = read_block(data.as_buffer())
                ids = ids_of[ranks]
                end = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), lengths.tolist())]
                cols = [pa.array(np.full(len(keys), file.as_py(), np.int32)), pa.array(keys, pa.int64()), pa.array(end - lengths + start.as_py()), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, end], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, _DOC_NAMES[: len(cols)])
        give_back()

    blocks = spark.read.parquet(f"{path}/blocks").select("file", "start", "data")
    decoded = blocks.mapInArrow(run, "file int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
    files = spark.read.parquet(f"{path}/files").withColumnRenamed("start", "base")
    return decoded.join(F.broadcast(files), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


_DOC_NAMES = ["file", "doc_id", "at", "n_tokens", "ids_crc32", "ids"]
