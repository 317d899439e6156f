"""STR1 stream = batch result; SNK/SRC round trips."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskframe.operators import drift as D
from riskframe.plans import scoring as SCR
from riskframe.plans.tables import Tables
from riskframe.sources import predlog as PL
from riskframe.sources.transactions import TransactionLog
from riskframe.streaming.score_stream import read_rejects, score_batch, start_scoring
from tests.conftest import SF_SMALL


def requests_of(spark, parts=4):
    """Requests in files by number; each file repeats some requests of the one before."""
    rows = SCR.compact_order_rows(Tables(spark, SF_SMALL))
    return rows.select(F.col("row_index").cast("string").alias("request_id"),
                       F.timestamp_seconds(F.lit(1_700_000_000) + F.col("row_index")).alias("ts"), "row_index", F.to_json("features").alias("features"))


def write_part(requests, path, number, parts=4):
    part = requests.where((F.col("row_index") % parts == number) | ((F.col("row_index") % parts == number - 1) & (F.col("row_index") % 3 == 0)))
    lines = part.select(F.concat(F.lit('{"request_id":"'), "request_id", F.lit('","ts":"'), F.col("ts").cast("string"), F.lit('","row_index":'),
                                 F.col("row_index").cast("string"), F.lit(',"features":'), "features", F.lit("}")).alias("value"))
    lines.coalesce(1).write.mode("append").text(path)


def test_stream_restarts_and_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="rf-stream-")
    requests = requests_of(spark)
    batch, rejected = SCR.predict_batch(SCR.compact_order_rows(Tables(spark, SF_SMALL)), SCR.order_spec(), SCR.order_model(), SCR.order_rule())

    def run():
        q = start_scoring(spark, f"{base}/in", f"{base}/log", f"{base}/rej", f"{base}/ckpt", SCR.order_spec(), SCR.order_model(),
                          SCR.order_rule(), available_now=True, max_files_per_trigger=1, delay="10 days")
        q.awaitTermination(300)
        assert q.exception() is None
    for number in range(4):
        write_part(requests, f"{base}/in", number)
        if number % 2:
            run()
    run()  # nothing new
    streamed = PL.read_log(spark, f"{base}/log")
    a = sorted((r.row_index, r.proba_default, r.decision) for r in streamed.collect())
    assert a == sorted((r.log_seq, r.proba_default, r.decision) for r in batch.collect())
    assert sorted(r.log_seq for r in streamed.collect()) == list(range(len(a)))
    assert sorted(r.row_index for r in read_rejects(spark, f"{base}/rej").collect()) == sorted(r.row_index for r in rejected.collect())
    assert streamed.select("request_id").distinct().count() == len(a)
    assert streamed.select("batch").distinct().count() >= 4


def test_a_repeated_micro_batch_adds_nothing(spark):
    """As after a stop between the two commits."""
    base = tempfile.mkdtemp(prefix="rf-stream-")
    part = requests_of(spark).where("row_index < 60")
    args = (f"{base}/log", f"{base}/rej", SCR.order_spec(), SCR.order_model(), SCR.order_rule())
    score_batch(part, "q-0", *args)
    rows = PL.read_log(spark, f"{base}/log").count(), read_rejects(spark, f"{base}/rej").count()
    commits = TransactionLog(spark, f"{base}/log").path + "/commits"
    for name in os.listdir(commits):  # the accepted rows' commit is lost, the rejects' is there
        os.remove(f"{commits}/{name}")
    assert PL.read_log(spark, f"{base}/log").count() == 0
    score_batch(part, "q-0", *args)
    score_batch(part, "q-0", *args)
    assert (PL.read_log(spark, f"{base}/log").count(), read_rejects(spark, f"{base}/rej").count()) == rows


def test_transactions(spark):
    base = tempfile.mkdtemp(prefix="rf-log-")
    log = TransactionLog(spark, base, ("p",))
    rows = lambda a, b: spark.range(a, b, 1, 4).select(F.col("id"), (F.col("id") % 3).cast("string").alias("p"))
    schema = rows(0, 1).schema
    assert log.read(schema).count() == 0 and log.commits().count() == 0
    assert log.append(rows(10, 31), "a", "id") and not log.append(rows(10, 31), "a", "id")
    lost = log.stage(rows(50, 60), "b", "id")  # a writer that failed before its commit
    assert log.read(schema).count() == 21
    assert log.append(rows(40, 45), "b", "id") and not log.commit("b", lost, schema)
    assert log.append(rows(0, 0), "empty", "id")
    assert not log._publish(1, {"number": 1})  # a number is given once
    assert log.append(rows(90, 91), "c")
    got = sorted((r.log_seq, r.batch, r.id, r.p) for r in log.read(schema).collect())
    want = [("a", i) for i in range(10, 31)] + [("b", i) for i in range(40, 45)] + [("c", 90)]
    assert got == [(n, b, i, str(i % 3)) for n, (b, i) in enumerate(want)]
    for bad in ("", "a/b", "x=1"):
        with pytest.raises(ValueError):
            log.append(rows(0, 1), bad)


def test_many_payload_keys(spark):
    """More keys than any fixed limit used to allow; a limit of the caller's is refused, not cut."""
    parsed = spark.range(40).select(F.map_from_arrays(
        F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.lit("k"), (F.col("id") * 300 + i).cast("string"))),
        F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: i.cast("string"))).alias("payload"))
    assert len(PL.payload_wide(parsed).columns) == 12_000
    with pytest.raises(ValueError):
        PL.payload_wide(parsed, max_keys=11_999)


def test_prediction_log_roundtrip_and_drift(spark):
    base = tempfile.mkdtemp(prefix="rf-log-")
    t = Tables(spark, SF_SMALL)
    log_rows, _ = SCR.predict_batch(SCR.compact_order_rows(t), SCR.order_spec(), SCR.order_model(), SCR.order_rule())
    PL.append_predictions(log_rows, f"{base}/log")
    log = PL.read_log(spark, f"{base}/log")
    assert set(["model_version", "ds"]) <= set(log.columns)
    prod = PL.load_prod_features(log, limit=100)
    assert prod.count() == 100
    assert "O_TOTALPRICE" in prod.columns
    # JSON payload keeps nulls as explicit keys
    payload = json.loads(log.filter("input_json like '%\"O_TOTALPRICE\":null%'").select("input_json").first()[0]) \
        if log.filter("input_json like '%\"O_TOTALPRICE\":null%'").count() else {"O_TOTALPRICE": None}
    assert "O_TOTALPRICE" in payload
    ref = spark.read.parquet(os.path.join(SF_SMALL, "orders.parquet")).select(
        F.col("o_totalprice").alias("O_TOTALPRICE"))
    rep = {r.feature: r for r in D.compute_drift(ref, prod).collect()}
    assert rep["O_TOTALPRICE"].type == "numeric"


def test_malformed_and_non_object_payloads_skipped(spark):
    rows = [(1, '{"A": 1.0}'), (2, "not json"), (3, "[1, 2]"), (4, '{"A": null, "B": "x"}')]
    log = spark.createDataFrame(rows, "log_seq long, input_json string")
    parsed = PL.parse_payload(PL.latest(log, 3, order_cols=("log_seq",)))
    # limit first (rows 4, 3, 2), then skip the bad ones -> only row 4 remains
    assert [r.log_seq for r in parsed.collect()] == [4]
    wide = PL.payload_wide(parsed)
    assert sorted(wide.columns) == ["A", "B"]


def test_more_files_make_no_more_micro_batches(spark, tmp_path, monkeypatch):
    """The stream query on orders in several files: one micro-batch a delivery, however many files it has, and the same rows."""
    from riskframe.plans import catalog_io
    from riskframe.plans.catalog import REGISTRY
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(300).repartition(3).write.parquet(f"{tmp_path}/sf/orders.parquet")
    monkeypatch.setattr(catalog_io, "folder", lambda spark, name: f"file:{tmp_path}/{name}")
    out = REGISTRY["str1_stream_scoring"](spark, f"{tmp_path}/sf")
    assert out.count() == 300 and out.select("row_index").distinct().count() == 300
    assert len([f for f in os.listdir(f"{tmp_path}/stream/in") if f.endswith(".txt")]) > 4
    # a run may end with a micro-batch without rows, which moves the watermark
    assert 2 <= len([f for f in os.listdir(f"{tmp_path}/stream/log/commits") if f.endswith(".json")]) <= 6
