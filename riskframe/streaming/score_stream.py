"""STR1: online scoring re-aimed as a stream.

Compact requests arrive as files (JSON lines: ``request_id``, ``ts``, ``row_index``,
``features`` object).  A request that arrives again within ``delay`` of event time is
dropped by a watermarked state.  One query then handles each micro-batch once:
align, validate and score with the expressions of the batch path, and add the rejected
and the accepted rows to their logs as transactions whose batch id is that of the
micro-batch.  A query that stops between or after the two commits
repeats the micro-batch when it starts again, and the logs take each batch once, so
neither loses nor repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskframe.operators.align import FeatureSpec, RequestedRule, align_rows
from riskframe.operators.score import LinearModel
from riskframe.plans.scoring import prediction_log_rows, score_aligned
from riskframe.sources.predlog import append_predictions
from riskframe.sources.tables import compact_rows_from_json
from riskframe.sources.transactions import TransactionLog

# the features object is kept as raw JSON text and parsed as VARIANT, so JSON
# numbers and JSON strings stay distinguishable (see compact_rows_from_json)
REQUEST = "request_id string, ts timestamp, row_index long, features string"
REJECTED = T.StructType([T.StructField("row_index", T.LongType()), T.StructField("reject_reason", T.StringType()),
                         T.StructField("reject_detail", T.StringType()), T.StructField("ts_utc", T.TimestampType())])


def request_stream(spark: SparkSession, source_dir: str, fmt: str = "json", max_files_per_trigger: int | None = None,
                   delay: str = "1 hour") -> DataFrame:
    """The requests, each id once within ``delay``.  State holds the ids of that span; a later request than the watermark allows is dropped."""
    reader = spark.readStream.schema(REQUEST).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.load(source_dir).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def rejects_log(spark: SparkSession, path: str) -> TransactionLog:
    return TransactionLog(spark, path)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return rejects_log(spark, path).read(REJECTED)


def score_batch(requests: DataFrame, batch: str, log_dir: str, rejects_dir: str, spec: FeatureSpec, model: LinearModel,
                rule: RequestedRule | None = None, strict: bool = True) -> None:
    """Add one micro-batch of requests to both logs; a repeated batch id changes nothing."""
    spark = requests.sparkSession
    aligned = align_rows(compact_rows_from_json(requests, "features", "row_index"), spec, strict=strict, rule=rule).persist()
    try:
        bad = aligned.filter(F.col("reject_reason").isNotNull()).select(
            "row_index", "reject_reason", "reject_detail", F.current_timestamp().alias("ts_utc"))
        rejects_log(spark, rejects_dir).append(bad.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REJECTED.fields]), batch, "row_index")
        ok = aligned.filter(F.col("reject_reason").isNull())
        append_predictions(prediction_log_rows(score_aligned(ok, model), model), log_dir, batch)
    finally:
        aligned.unpersist()


def start_scoring(spark: SparkSession, source_dir: str, log_dir: str, rejects_dir: str, checkpoint_dir: str,
                  spec: FeatureSpec, model: LinearModel, rule: RequestedRule | None = None, strict: bool = True,
                  available_now: bool = False, max_files_per_trigger: int | None = None, delay: str = "1 hour") -> StreamingQuery:
    """Start the query; batches are named by the query (which its checkpoint keeps) and their number."""
    def handle(requests: DataFrame, number: int) -> None:
        session = requests.sparkSession
        batch = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        score_batch(requests, batch, log_dir, rejects_dir, spec, model, rule, strict)

    writer = request_stream(spark, source_dir, "json", max_files_per_trigger, delay).writeStream.foreachBatch(handle)
    writer = writer.option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()
