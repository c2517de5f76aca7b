"""Folders, written tables and Arrow batches that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: the white space of the word patterns, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the one that all machines share.

    A session on one machine that names none gets a temporary folder; any
    other session without ``spark.checkpoint.dir`` is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="llm-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` read back from a table at ``path``: lineage ends here."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row.

    A lambda that reads another expression computes it for every element of
    its array; a lambda variable is a plain read.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Array of the white-space separated words; empty for null and blank text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.filter(F.split(trimmed, f"{SPACE}+"), lambda w: w != "")


BUCKET_BITS = 22


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << BUCKET_BITS))


def _word(column: str) -> Column:
    return F.shiftright(_bucket(column), 6)


def _bit(column: str) -> Column:
    return _bucket(column).bitwiseAND(63).cast("int")


def _bit_map(keys: DataFrame, key: str) -> DataFrame:
    """Bit map of hash buckets: 2 ** 22 bits in 65,536 rows at most, about 1 MB,
    whatever the data. That bound is why it may be broadcast."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(key))
    return keys.select(_word(key).alias("word_"), one.alias("bit_")).groupBy("word_").agg(F.bit_or("bit_").alias("bits_"))


def _marked(rows: DataFrame, key: str, keys: DataFrame, other: str) -> DataFrame:
    hit = F.call_function("shiftrightunsigned", F.col("bits_"), _bit(key)).bitwiseAND(1) == 1
    joined = rows.join(F.broadcast(_bit_map(keys, other)), _word(key) == F.col("word_"), "left")
    return joined.withColumn("hit_", F.coalesce(hit, F.lit(False))).drop("word_", "bits_")


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, other: str) -> DataFrame:
    """Rows whose ``key`` may be in column ``other`` of ``keys``; none that is is lost.

    A filter ahead of a join, so that a few keys do not move many rows.
    """
    return _marked(rows, key, keys, other).where("hit_").drop("hit_")


def split_by(rows: DataFrame, key: str, keys: DataFrame, other: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be in ``keys``, and those where it surely is not."""
    marked = _marked(rows, key, keys, other)
    return marked.where("hit_").drop("hit_"), marked.where("NOT hit_").drop("hit_")
