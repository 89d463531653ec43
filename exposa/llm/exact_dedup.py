"""Exact dedup by an extendible-hash index on shared files (op 5), DataFrame functions only.

1. *Keys.* Rows are grouped by (hash, normalised text). Spark combines copies on the map side, so a
   text that holds a third of all rows leaves each map task as one row; grouping compares the texts'
   bytes, so texts whose 64-bit hashes collide stay apart.
2. *Directory.* A histogram of the distinct keys over the hash's leading ``max_depth`` bits gives,
   for each slot, the smallest depth at which its bucket holds at most ``capacity`` keys: what
   doubling the directory until no bucket is overfull ends with.
3. *Index files.* Owner tasks take ranges of buckets (range partitions), chain the keys of one hash
   by SHA-256, and write the index as Parquet in the shared folder.
4. *Look-up.* Each row's hash gives its slot, the directory its bucket; in the bucket's part of the
   index it follows the chain of its hash to the entry of its SHA-256. Large entries' rows are split by
   adaptive execution (only 60-byte rows take part).

Defined results: a null text is the empty text; of rows with equal text the largest doc_id stays, a
null doc_id only if there is no other; rows that repeat a doc_id and its text form one group and share
the kept flag; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposa.llm.common import materialize, text_of

#: Keys of a bucket beyond which it splits.
CAPACITY = 100_000
#: The directory has 2**MAX_DEPTH slots at most.
MAX_DEPTH = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` has a fast path for ASCII texts and equals it there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def slot(max_depth: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), 64 - max_depth)


def bucket(max_depth: int) -> Column:
    """A bucket is named by the first slot that points to it."""
    return F.expr(f"shiftleft(shiftright(slot, {max_depth} - depth), {max_depth} - depth)")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, depth): the local depth of each occupied slot's bucket. At most 2**max_depth rows."""
    slots = keys.groupBy(slot(max_depth).alias("slot")).agg(F.count("*").alias("n"))
    levels = (slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
              .withColumn("bucket", bucket(max_depth)))
    fits = (levels.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
            .where((F.col("held") <= capacity) | (F.col("depth") == max_depth)).select("depth", "bucket"))
    # at most 2**(max_depth + 1) nodes
    return levels.join(F.broadcast(fits), ["depth", "bucket"]).groupBy("slot").agg(F.min("depth").alias("depth"))


def in_bucket(rows: DataFrame, buckets: DataFrame, max_depth: int) -> DataFrame:
    """``rows`` with the slot of their hash ``h``, and the depth and bucket that the directory has for it."""
    return (rows.withColumn("slot", slot(max_depth)).join(F.broadcast(buckets), "slot")
            .withColumn("bucket", bucket(max_depth)))


def build(documents: DataFrame, capacity: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The directory, and the index: bucket, depth, h, chain (place among the keys of one h), sha, keep_id,
    group_size."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_of()).alias("norm"))
    keys = materialize(
        rows.select("doc_id", "norm", F.xxhash64("norm").alias("h"))
        .groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"))
    buckets = materialize(directory(keys, capacity, max_depth))
    owned = in_bucket(keys, buckets, max_depth).repartitionByRange("bucket", "h")
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha"))
    return buckets, materialize(owned.select("bucket", "depth", "h", chain.alias("chain"), "sha", "keep_id", "group_size"))


def build_index(documents: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index alone."""
    return build(documents, capacity, max_depth)[1]


def exact_dedup(documents: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    buckets, index = build(documents, capacity, max_depth)
    norm = normalised(text_of())
    members = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(norm).alias("h"),
                               F.unhex(F.sha2(norm, 256)).alias("sha"))
    return (in_bucket(members, buckets, max_depth)
            .join(index.select("bucket", "h", "sha", "keep_id", "group_size"), ["bucket", "h", "sha"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def keep_last(documents: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The kept document of each text, with all its columns. Rows that repeat a kept doc_id and its text
    all stay, as they share the kept flag."""
    buckets, index = build(documents, capacity, max_depth)
    kept = index.select("bucket", "h", "sha", "keep_id")
    norm = normalised(F.coalesce(documents["text"], F.lit("")))
    # the row's own columns may bear any name, so what the look-up needs lies in one struct
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.xxhash64(norm).alias("h"),
                            F.unhex(F.sha2(norm, 256)).alias("sha"))
    rows = in_bucket(rows, buckets, max_depth)
    own = [rows[c] == kept[c] for c in ("bucket", "h", "sha")]
    return rows.join(kept, [*own, rows["row"]["doc_id"].eqNullSafe(kept["keep_id"])], "left_semi").select("row.*")
