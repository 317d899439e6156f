"""Prediction log: writer (SNK2, SNK3, SNK6) and reader (SRC4, TOP1).

The log is an append-only Parquet table of committed batches (see
``transactions``) partitioned by ``model_version`` and ``ds`` (the UTC day); those
partition columns replace the store's indexes, so a scan for one model or one
day prunes files.  Schema (FIXTURES F1):
log_seq, ts_utc, request_id, model_version, proba_default, threshold,
decision, latency_ms, input_json.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import clean_double, q
from riskframe.sources.transactions import TransactionLog

LOG_COLUMNS = ["log_seq", "ts_utc", "request_id", "model_version", "proba_default", "threshold",
               "decision", "latency_ms", "input_json"]


def json_safe_payload(features: list[str]) -> F.Column:
    """SNK6: JSON object of the aligned features; NaN/+-Inf become null and
    nulls are kept as explicit keys.  One map over an array of the values, so
    the expression does not deepen with the number of features."""
    values = F.expr("array(" + ", ".join(f"cast({q(f)} as double)" for f in features) + ")")
    names = F.from_json(F.lit(json.dumps(features)), "array<string>")
    return F.to_json(F.map_from_arrays(names, F.transform(values, clean_double)), {"ignoreNullFields": "false"})


#: A log row as stored: ``log_seq`` is given by the commit, ``row_index`` is the request's own number.
STORED = T.StructType([T.StructField(n, t) for n, t in (
    ("row_index", T.LongType()), ("ts_utc", T.TimestampType()), ("request_id", T.StringType()), ("model_version", T.StringType()),
    ("proba_default", T.DoubleType()), ("threshold", T.DoubleType()), ("decision", T.IntegerType()), ("latency_ms", T.DoubleType()),
    ("input_json", T.StringType()), ("ds", T.DateType()))])


def prediction_log(spark: SparkSession, path: str) -> TransactionLog:
    """The log at ``path``: batches are transactions, files are partitioned by model version and day."""
    return TransactionLog(spark, path, ("model_version", "ds"))


def append_predictions(log_rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """SNK2/SNK3: one transaction for a whole batch (a one-row batch is SNK2), in the order of the requests.

    A batch id that is in the log already adds nothing (false), so a retry after a commit is harmless; without an id
    every call is a batch of its own."""
    rows = log_rows.withColumnRenamed("log_seq", "row_index").withColumn("ds", F.to_date("ts_utc"))
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED.fields])
    return prediction_log(log_rows.sparkSession, path).append(rows, batch or uuid.uuid4().hex, "row_index")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows with their gapless ``log_seq``."""
    return prediction_log(spark, path).read(STORED)


def latest(log: DataFrame, limit: int | None = 2000, order_cols=("ts_utc", "log_seq")) -> DataFrame:
    """TOP1: the latest ``limit`` rows (TakeOrderedAndProject: each task keeps
    its own top ``limit``, the final merge sees ``limit`` x tasks rows)."""
    if limit is None:
        return log
    return log.orderBy(*[F.desc(c) for c in order_cols]).limit(int(limit))


def parse_payload(log: DataFrame, json_col: str = "input_json", keep=("log_seq",)) -> DataFrame:
    """SRC4: payload text -> map<string,string>; malformed text and JSON that
    is not an object (arrays, scalars) give NULL and are skipped, after the
    limit, as the reference does."""
    obj = F.when(F.trim(F.col(q(json_col))).startswith("{"),
                 F.from_json(F.col(q(json_col)), "map<string,string>", {"mode": "PERMISSIVE"}))
    return log.select(*[q(c) for c in keep], obj.alias("payload")).filter(F.col("payload").isNotNull())


def payload_long(parsed: DataFrame, id_col: str = "log_seq") -> DataFrame:
    """(id, feature, value) cells of the parsed payloads."""
    return parsed.select(q(id_col), F.explode("payload").alias("feature", "value"))


def payload_wide(parsed: DataFrame, keys: list[str] | None = None, max_keys: int | None = None) -> DataFrame:
    """Union of keys as columns (text).  The key list is found with one distinct job unless given; it becomes the
    result's columns.  With ``max_keys``, a log with more keys is refused by name, never cut."""
    if keys is None:
        found = parsed.select(F.explode(F.map_keys("payload"))).distinct()
        found = (found if max_keys is None else found.limit(max_keys + 1)).collect()
        if max_keys is not None and len(found) > max_keys:
            raise ValueError(f"the payloads hold more than {max_keys} different keys: name the wanted ones")
        keys = sorted(r[0] for r in found)
    return parsed.select(*[F.try_element_at(F.col("payload"), F.lit(k)).alias(k) for k in keys])


def load_prod_features(log: DataFrame, limit: int | None = 2000, order_cols=("ts_utc", "log_seq"),
                       json_col: str = "input_json") -> DataFrame:
    """SRC4: latest N log rows -> one text column per payload key."""
    top = latest(log, limit, order_cols)
    return payload_wide(parse_payload(top, json_col, keep=()))
