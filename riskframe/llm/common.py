"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import ensure_checkpoint_dir

#: Characters of text that one step inside a task handles at once (a longer single text goes alone).
CHUNK_CHARS = 2_000_000


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back: computed once, and kept when executors are lost."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(names: Sequence[str]) -> list[Column]:
    """Columns by their exact names, dots and back quotes included."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: A key with more rows than this, and than a thousandth of all rows, is split in joins.
HOT_ROWS = 1_000


def spread_join(left: DataFrame, right: DataFrame, key: str, n: int, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``key``, unique in ``right``, with the frequent keys of ``left`` (``n`` rows) split over several tasks.

    At most 1,000 keys can be frequent, so their broadcast is bounded; rows of such a key are dealt by a hash of the columns ``by``,
    and its one row of ``right`` goes to every share.
    """
    least = max(HOT_ROWS, n // 1_000)
    hot = F.broadcast(left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > least)
                      .select(F.col(key), F.ceil(F.col("__n") / least).cast("int").alias("__shares")))
    shares = F.coalesce("__shares", F.lit(1))
    salted = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), shares).cast("int")).drop("__shares")
    copies = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def carried(docs: DataFrame, keys: Sequence[str], text: str) -> tuple[DataFrame, str]:
    """The key columns and the text for a task, and the text's name there.

    A text inside a key column (``row.text``) is not sent twice; columns that are not keys stay behind, so they cannot clash.
    """
    if text.split(".")[0] in keys:
        return docs.select(*keys), text
    return docs.select(*keys, F.col(text).cast("string").alias("__text")), "__text"


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or a field of a struct column."""
    first, *rest = name.split(".")
    column = batch.column(first)
    for part in rest:
        column = pc.struct_field(column, part)
    return column


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of an Arrow batch with at most ``limit`` characters of text each; a null text reads as ''."""
    texts = ["" if t is None else t for t in column_of(batch, column).to_pylist()]
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield batch.slice(start), texts[start:]
