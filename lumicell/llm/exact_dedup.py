"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every text and counts the Bloom fingerprints of the hashes.  A
fingerprint is a word of a register-blocked Bloom filter plus four bits in it;
the ones hit at least twice make up the filter (their bits are or-ed by word).
Eight bytes a row are exchanged for this, combined map-side.

Pass 2 probes the filter with every row.  Rows that miss it are certainly
unique and pass straight through; only the rest shuffle and are grouped by
their full SHA-256.

Scale.  The filter has a row for each word with a repeated fingerprint; it is
broadcast if it has at most FILTER_WORDS rows (a 16-byte row each).  Beyond
that the hashed rows (never texts) meet their words of the filter in a join by
word, and again only those that hit go on to be grouped.  A hash with more than a thousandth
of the rows is hot; there are fewer than a thousand, so their groups are
broadcast and their rows never meet in one task.  Other groups join by hash.
Texts are read once: what both passes need is the hashed table in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, ascii_lower, discard, saved, unused, without

#: Rows of the filter up to which it is broadcast: 64 MB.
FILTER_WORDS = 4_000_000
#: A group of copies with over 1/HOT_SHARE of all rows is hot.
HOT_SHARE = 1000
#: Groups below this size are never hot.
HOT_LEAST = 256


def _fingerprint(sha, words: int):
    """Word number (high part) and four 6-bit positions (low 24 bits)."""
    h = F.xxhash64(sha)
    return F.shiftleft(h.bitwiseAND(F.lit(words - 1)), 24).bitwiseOR(F.shiftrightunsigned(h, 40))


def _bits(fp):
    """The four bits of a fingerprint as a mask."""
    mask = None
    for i in range(4):
        at = F.shiftright(fp, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def text_hash(text):
    """SHA-256 of the text, A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Equal texts are those equal after lower-casing A-Z; null counts as empty.
    Of a group the row with the largest key stays.  Repeated keys are rows of
    their own: each counts in group_size, and of rows that share key and text
    all have kept true if that key is the largest.  Null keys count as the
    smallest: their rows stay only in groups without other keys.  Very long
    texts are hashed whole.  An empty table gives an empty result.  Other
    columns of the input are ignored, whatever their names.
    """
    hashed = saved(docs.select(F.col(key).alias("doc_id"), text_hash(F.col(text)).alias("text_sha256")))
    n = hashed.count()
    words = 1 << max(10, (max(n, 1) - 1).bit_length())
    fp = _fingerprint(F.col("text_sha256"), words)

    bloom = saved(
        hashed.select(fp.alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
        .groupBy(F.shiftright("fp", 24).alias("word")).agg(F.bit_or(_bits(F.col("fp"))).alias("bits"))
    )
    near = F.broadcast(bloom) if bloom.count() <= filter_words else bloom.hint("merge")
    probed = (
        hashed.withColumn("_fp", fp)
        .withColumn("word", F.shiftright("_fp", 24))
        .join(near, "word", "left")
        .select("doc_id", "text_sha256", F.coalesce(F.col("bits").bitwiseAND(_bits(F.col("_fp"))) == _bits(F.col("_fp")), F.lit(False)).alias("_maybe"))
    )
    unique, maybe = probed.where("not _maybe").drop("_maybe"), probed.where("_maybe").drop("_maybe")

    groups = saved(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    hot_size = max(HOT_LEAST, n // HOT_SHARE)
    hot = groups.where(F.col("group_size") > hot_size)
    cold = groups.where(F.col("group_size") <= hot_size)
    tried = maybe.join(F.broadcast(hot), "text_sha256", "left")
    out = tried.where("keep_id is not null")
    out = out.unionByName(tried.where("keep_id is null").select("doc_id", "text_sha256").join(cold, "text_sha256", "left").select(out.columns))
    out = out.unionByName(unique, allowMissingColumns=True)
    return out.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id, with all its columns.

    Of rows that share that doc_id (or have none, in a group without any) one
    stays; which one is not defined if their other columns differ.  Null and
    empty texts are one group.  An empty table stays empty.  Only rows whose
    doc_id and text repeat shuffle.
    """
    found = saved(exact_dedup(docs))
    sha = unused(docs, "_text_sha256")
    hashed = docs.withColumn(sha, text_hash(F.col("text")))
    out = without(hashed, found.where("not kept").select("doc_id", F.col("text_sha256").alias(sha)))
    again = saved(found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256"))
    discard(found)
    n = again.count()
    if n:  # rows that share key and text
        key = again.select(F.col("doc_id").alias("_again_id"), F.col("text_sha256").alias("_again_sha"))
        on = out["doc_id"].eqNullSafe(key["_again_id"]) & (out[sha] == key["_again_sha"])
        key = F.broadcast(key) if n <= BROADCAST_KEYS else key.hint("merge")
        out = out.join(key, on, "left_anti").unionByName(out.join(key, on, "left_semi").dropDuplicates(["doc_id", sha]))
    return out.drop(sha)
