"""An append-only table whose batches are transactions.

    data/batch=<batch id>/attempt=<id>/...   Parquet files of one attempt to write a batch
    commits/<number>.json                    one small record per committed batch, numbered from 0

``stage`` writes an attempt's rows in one job; nobody sees them yet.  ``commit`` adds the
record that names the attempt.  Records are put in place by an exclusive rename, so of
two writers one gets a number and the other looks again; a batch id that has a record
is not added twice.  An attempt without a record (a job that failed, a second
try, the loser of two writers) is never read.

Readers join the files' partition columns with the records, so they see whole
batches only, and every row has ``log_seq``: 0, 1, 2, ... without gaps, in the order of
commits and, inside a batch, of ``order_by``.  A row's place inside its batch
comes from its task and its count there; the record holds the rows of each task, so
numbering costs no second pass and no single-task window.

Records are one a batch; ``read`` handles them as a table.  A file system must rename
exclusively (HDFS, local); that is what Spark's own streaming checkpoints need too.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("number long, batch string, attempt string, n_rows long, first_seq long, "
          "parts array<struct<part: long, before: long>>")
#: Columns that the table adds to each row's files.
PLACE = "__place"


@dataclass
class TransactionLog:
    """A table at ``path`` with rows of ``schema`` (fixed by the first batch if not given)."""

    spark: SparkSession
    path: str
    partition_by: tuple[str, ...] = ()

    # ---- files of records

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, folder, folder.getFileSystem(conf)

    def _numbers(self) -> list[int]:
        jvm, folder, fs = self._files()
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _publish(self, number: int, record: dict) -> bool:
        """Put the record in its place unless there is one already."""
        jvm, folder, fs = self._files()
        fs.mkdirs(folder)
        new = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}.tmp")
        out = fs.create(new, False)
        out.write(bytearray((json.dumps(record) + "\n").encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(new, jvm.org.apache.hadoop.fs.Path(folder, f"{number:020d}.json"), plain)
            return True
        except Exception as exc:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(exc):
                return False
            raise

    def commits(self) -> DataFrame:
        """One row per committed batch, numbered from 0."""
        if not self._numbers():
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).json(f"{self.path}/commits/*.json")

    # ---- writing

    def stage(self, rows: DataFrame, batch: str, order_by: str | None = None) -> str:
        """Write an attempt of a batch; its id."""
        attempt = uuid.uuid4().hex
        if order_by is not None:
            rows = rows.repartitionByRange(order_by).sortWithinPartitions(order_by)
        placed = rows.withColumn(PLACE, F.monotonically_increasing_id())
        writer = placed.write.mode("error")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/data/batch={batch}/attempt={attempt}")
        return attempt

    def commit(self, batch: str, attempt: str, schema: T.StructType) -> bool:
        """Make a staged attempt the batch; false if the batch is there already."""
        staged = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(PLACE, T.LongType())])).parquet(
            f"{self.path}/data/batch={batch}/attempt={attempt}")
        sizes = staged.groupBy(F.shiftright(PLACE, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        parts, total = [], 0
        for r in sizes:  # one a writing task
            parts.append({"part": r["part"], "before": total})
            total += r["n"]
        while True:
            known = self.commits()
            if not known.where(F.col("batch") == batch).isEmpty():
                return False
            last = known.orderBy(F.desc("number")).first()
            number, first = (last["number"] + 1, last["first_seq"] + last["n_rows"]) if last else (0, 0)
            if self._publish(number, {"number": number, "batch": batch, "attempt": attempt, "n_rows": total, "first_seq": first, "parts": parts}):
                return True

    def append(self, rows: DataFrame, batch: str, order_by: str | None = None) -> bool:
        """Add a batch once; false, with nothing written, if its id is committed already."""
        if not batch or any(c in batch for c in "/=%:{}*?"):
            raise ValueError(f"{batch!r} cannot name a folder")
        if not self.commits().where(F.col("batch") == batch).isEmpty():
            return False
        return self.commit(batch, self.stage(rows, batch, order_by), rows.schema)

    # ---- reading

    def read(self, schema: T.StructType) -> DataFrame:
        """The rows of all committed batches, with ``log_seq`` and ``batch``."""
        seq = [T.StructField("log_seq", T.LongType()), T.StructField("batch", T.StringType())]
        if not self._numbers():
            return self.spark.createDataFrame([], T.StructType([*seq, *schema.fields]))
        wide = T.StructType([*schema.fields, T.StructField(PLACE, T.LongType()), T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])
        rows = self.spark.read.schema(wide).parquet(f"{self.path}/data").withColumn("part", F.shiftright(PLACE, 33))
        starts = self.commits().select("batch", "attempt", "first_seq", F.inline("parts"))
        inside = F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
        return rows.join(starts, ["batch", "attempt", "part"]).select(
            (F.col("first_seq") + F.col("before") + inside).alias("log_seq"), "batch", *[F.col(f"`{f.name}`") for f in schema.fields])
