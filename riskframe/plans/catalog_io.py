"""Registered queries of sources and sinks: each renders, writes, streams or saves what it derives from the given tables
and reads it back.  Files go to the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskframe.operators.align import align_rows
from riskframe.plans import features as feat
from riskframe.plans import scoring as SCR
from riskframe.plans.catalog import register
from riskframe.plans.tables import Tables
from riskframe.session import ensure_checkpoint_dir
from riskframe.sources import predlog as PL
from riskframe.sources import text as TX
from riskframe.sources.tables import compact_rows_from_columns
from riskframe.streaming import score_stream as ST

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def customer_lines(spark, sf):
    """Every customer as a CSV line, names with commas and quotes, some without a balance; of each 40 keys one line has a field
    too many and one a field too few."""
    c = Tables(spark, sf).customer
    c = c.withColumn("c_name", F.concat("c_name", F.lit(', "the '), (F.col("c_custkey") % 3).cast("string"), F.lit('"')))
    c = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 != 4, F.col("c_acctbal")))
    lines = TX.render_lines(c, "c_custkey", CUSTOMER)
    kind = F.col("line_no") % 40
    return lines.withColumn("line", F.when(kind == 7, F.concat("line", F.lit(",more"))).when(kind == 11, F.regexp_replace("line", ",[^,]*$", "")).otherwise(F.col("line")))


@register("src1_csv_rows")
def q_csv_rows(spark, sf):
    """Types inferred over all lines, malformed lines apart."""
    read = TX.read_csv_lines(customer_lines(spark, sf), CUSTOMER)
    types = F.lit(",".join(f.dataType.simpleString() for f in read.schema.fields))
    return feat.snap_doubles(read.rows.select("line_no", *CUSTOMER, types.alias("types")))


@register("src1_csv_malformed")
def q_csv_malformed(spark, sf):
    """With a given schema: fields too many or too few, and numbers that are none."""
    lines = customer_lines(spark, sf)
    lines = lines.withColumn("line", F.when(F.col("line_no") % 40 == 13, F.regexp_replace("line", "^[0-9]+", "n/a")).otherwise(F.col("line")))
    schema = TX.infer_schema(customer_lines(spark, sf), CUSTOMER)
    return TX.read_csv_lines(lines, CUSTOMER, schema).malformed.select("line_no", "reason")


@register("src2_row_limited_scan")
def q_row_limited(spark, sf):
    """The first 500 lines (the limit is the feature), then parsed."""
    lines = customer_lines(spark, sf).orderBy("line_no").limit(500)
    return feat.snap_doubles(TX.read_csv_lines(lines, CUSTOMER).rows)


@register("src3_sc5_csv_scoring")
def q_csv_scoring(spark, sf):
    """Every order as a CSV line of a scoring file: aligned, scored, or refused with its reason; malformed lines among them."""
    keys = ["O_TOTALPRICE", "O_CUSTKEY", "FLAG_URGENT", "O_ORDERPRIORITY", "O_ORDERSTATUS"]
    rows = SCR.compact_order_rows(Tables(spark, sf))
    wide = rows.select("row_index", *[F.try_element_at("features", F.lit(k)).alias(k) for k in keys])
    lines = TX.render_lines(wide, "row_index", keys)
    lines = lines.withColumn("line", F.when(F.col("line_no") % 50 == 3, F.concat("line", F.lit(",x"))).otherwise(F.col("line")))
    read = TX.scoring_lines(lines, keys)
    compact = compact_rows_from_columns(read.rows, [], "line_no")
    model = SCR.order_model()
    aligned = align_rows(compact, SCR.order_spec(), strict=True, rule=SCR.order_rule())
    ok = SCR.score_aligned(aligned.where("reject_reason IS NULL"), model).select("row_index", F.lit(None).cast("string").alias("reject_reason"), "proba_default", "decision")
    none = [F.lit(None).cast("double").alias("proba_default"), F.lit(None).cast("int").alias("decision")]
    bad = aligned.where("reject_reason IS NOT NULL").select("row_index", "reject_reason", *none)
    malformed = read.malformed.select(F.col("line_no").alias("row_index"), F.concat(F.lit("malformed_"), "reason").alias("reject_reason"), *none)
    return feat.snap_doubles(ok.unionByName(bad).unionByName(malformed))


@register("snk2_snk3_log_transaction")
def q_log_transaction(spark, sf):
    """All orders' scores in four batches, one appended twice, one first by a writer that fails before its commit."""
    log, _ = SCR.predict_batch(SCR.compact_order_rows(Tables(spark, sf)), SCR.order_spec(), SCR.order_model(), SCR.order_rule(), deterministic=True)
    path = folder(spark, "log")
    for number in range(4):
        part = log.where(F.col("log_seq") % 4 == number)
        if number == 2:
            PL.prediction_log(spark, path).stage(part.withColumnRenamed("log_seq", "row_index").withColumn("ds", F.to_date("ts_utc")), "b2", "row_index")
        PL.append_predictions(part, path, f"b{number}")
        if number == 1:
            PL.append_predictions(part, path, "b1")
    return feat.snap_doubles(PL.read_log(spark, path).select("log_seq", "batch", "row_index", "model_version", "proba_default", "decision", "ds"))


@register("str1_stream_scoring")
def q_stream(spark, sf):
    """All orders as a stream of request files, some requests twice, in several micro-batches over two runs of the query.

    A micro-batch takes as many files as one of the four deliveries has, so larger deliveries make larger micro-batches, not more:
    each costs all its jobs' tasks, whatever it holds."""
    base = folder(spark, "stream")
    known = 0
    rows = SCR.compact_order_rows(Tables(spark, sf))
    part = F.col("row_index") % 4
    request = F.concat(F.lit('{"request_id":"'), F.col("row_index").cast("string"), F.lit('","ts":"'),
                       F.timestamp_seconds(F.lit(1_700_000_000) + F.col("row_index") % 3_600).cast("string"), F.lit('","row_index":'),
                       F.col("row_index").cast("string"), F.lit(',"features":'), F.to_json("features", {"ignoreNullFields": "false"}), F.lit("}"))
    for number in range(4):
        again = (part == number - 1) & (F.col("row_index") % 3 == 0)  # requests of the file before arrive once more
        rows.where((part == number) | again).select(request.alias("value")).write.mode("append").text(f"{base}/in")
        if number % 2:  # stopped after two deliveries, started again for the rest
            files = len(spark.read.text(f"{base}/in").inputFiles())
            ST.start_scoring(spark, f"{base}/in", f"{base}/log", f"{base}/rejects", f"{base}/checkpoint", SCR.order_spec(), SCR.order_model(), SCR.order_rule(),
                             available_now=True, max_files_per_trigger=max(1, (files - known + 1) // 2), delay="2 hours").awaitTermination()
            known = files
    log = PL.read_log(spark, f"{base}/log").select("row_index", F.lit(None).cast("string").alias("reject_reason"), "proba_default", "decision")
    rejects = ST.read_rejects(spark, f"{base}/rejects").select("row_index", "reject_reason", F.lit(None).cast("double").alias("proba_default"),
                                                                F.lit(None).cast("int").alias("decision"))
    return feat.snap_doubles(log.unionByName(rejects))


# --- sinks as the rows they write ------------------------------------------------------------------------------


@register("snk1_feature_table_files")
def q_feature_files(spark, sf):
    """The orders rollup written as Parquet and as CSV, and both read back."""
    from riskframe.sources.sinks import write_table
    df, _ = feat.orders_rollup(Tables(spark, sf))
    base = folder(spark, "features")
    write_table(df, f"{base}/parquet")
    write_table(df, f"{base}/csv", "csv")
    parquet = spark.read.parquet(f"{base}/parquet").withColumn("source", F.lit("parquet"))
    csv = spark.read.schema(df.schema).option("header", True).csv(f"{base}/csv").withColumn("source", F.lit("csv"))
    both = parquet.unionByName(csv)
    return feat.snap_doubles(both, [c for c in both.columns if feat.passed_through(c)])


@register("snk4_drift_report_files")
def q_report_files(spark, sf):
    """The orders' drift report written as one JSON document and as rows; the document's lists, unfolded."""
    from riskframe.operators import drift as D
    from riskframe.plans import monitoring as mon
    from riskframe.sources.sinks import write_drift_report
    report = mon.drift_report_orders(Tables(spark, sf))
    base = folder(spark, "report")
    doc = D.report_document(report, {"generated_by": "batch"}, k=2)
    write_drift_report(doc, base, report)
    saved = spark.read.schema(doc.schema).json(f"{base}/report")
    lists = [saved.select(F.lit(n).alias("list"), "generated_by", "n_ref_rows", "n_prod_rows", "features_total", F.posexplode(n).alias("pos", "f"))
             .select("list", "pos", "generated_by", "n_ref_rows", "n_prod_rows", "features_total", "f.feature", "f.psi", "f.missing_rate_delta", "f.severity")
             for n in ("top_psi", "top_missing_delta", "all_features")]
    return feat.snap_doubles(lists[0].unionByName(lists[1]).unionByName(lists[2]))


@register("snk5_reference_sample_file")
def q_sample_file(spark, sf):
    """1000 events by hash order (the limit is the feature), as CSV with a header, read back."""
    from riskframe.sources.sinks import write_reference_sample
    events = Tables(spark, sf).events.select("event_id", "user_id", "event_type", "value")
    path = f"{folder(spark, 'reference')}/sample"
    write_reference_sample(events, "event_id", path, 1000)
    return spark.read.schema(events.schema).option("header", True).csv(path)


@register("snk7_requested_report_file")
def q_requested_file(spark, sf):
    from riskframe.operators import importance as IMP
    from riskframe.plans.catalog import _order_importances
    from riskframe.sources.sinks import write_requested_config
    report = IMP.requested_keys(_order_importances(spark, sf), SCR.order_spec(), 0.8)
    path = f"{folder(spark, 'requested')}/report"
    write_requested_config(spark, report, path, {"target": 0.8, "source": {"table": "orders"}})
    saved = spark.read.schema(report.schema.add("target", "double").add("source", "string")).json(path)
    return feat.snap_doubles(saved.withColumn("requested_groups", F.array_join("requested_groups", ",")).withColumn(
        "source", F.get_json_object("source", "$.table")))


@register("top4_importances")
def q_top_importances(spark, sf):
    """The three most important features and those without importance."""
    from riskframe.plans import train as TR
    from riskframe.plans.catalog import _order_importances
    imp = _order_importances(spark, sf).cache()
    top = TR.top_importances(imp, 3).select("feature", F.lit("top").alias("list"))
    return top.unionByName(TR.zero_importances(imp).select("feature", F.lit("zero").alias("list")))


# --- alignment and scoring ---------------------------------------------------------------------------------------


@register("sc6_lenient_scores")
def q_lenient(spark, sf):
    """Every order as a request of its own by the lenient switch: unknown keys are ignored, missing ones imputed."""
    log, _ = SCR.predict_batch(SCR.compact_order_rows(Tables(spark, sf)), SCR.order_spec(), SCR.order_model(), SCR.order_rule(), strict=False, deterministic=True)
    return feat.snap_doubles(log.select(F.col("log_seq").alias("row_index"), "proba_default", "decision"))


@register("adp12_rules_of_metadata")
def q_rules(spark, sf):
    """Requests judged by the rules that differently written metadata state: a list and a share, legacy names, a share above one, unusable entries."""
    from riskframe.operators.align import RequestedRule
    keys = ["O_TOTALPRICE", "O_ORDERPRIORITY", "O_ORDERSTATUS"]
    metas = {"plain": {"requested_groups": keys, "min_filled_rate_requested": 1.0}, "legacy": {"required_groups": keys, "min_filled_rate_groups": "0.9"},
             "clipped": {"requested_groups": keys, "min_filled_rate_requested": 7}, "bad_share": {"requested_groups": keys, "min_filled_rate_requested": "much"},
             "bad_list": {"requested_groups": "O_TOTALPRICE", "min_filled_rate_requested": 1.0}, "none": {}}
    rows = SCR.compact_order_rows(Tables(spark, sf))
    out = None
    for name, meta in metas.items():
        part = align_rows(rows, SCR.order_spec(), strict=True, rule=RequestedRule.read(meta)).groupBy("reject_reason").agg(F.count("*").alias("n"))
        part = part.select(F.lit(name).alias("meta"), "reject_reason", "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("adp14_feature_catalogue")
def q_catalogue(spark, sf):
    """Allowed keys with their examples, and how many requests name each."""
    from riskframe.operators.align import feature_catalogue
    named = SCR.compact_order_rows(Tables(spark, sf)).select(F.explode(F.map_keys("features")).alias("key")).groupBy("key").agg(F.count("*").alias("n_requests"))
    known = feature_catalogue(spark, SCR.order_spec()).join(named, "key", "left")
    return known.select("key", "kind", "n_dummies", F.array_join("examples", "|").alias("examples"), F.coalesce("n_requests", F.lit(0)).cast("long").alias("n_requests"))


# --- run log ----------------------------------------------------------------------------------------------------------


@register("exp1_exp2_champion_run")
def q_champion(spark, sf):
    """A run for every customer's orders (metrics: their prices, step: the order), written as a run log, and the run
    that is found by name, by model version and by the highest version."""
    from riskframe.plans.train import resolve_run
    o = Tables(spark, sf).orders
    who = F.concat(F.lit("run-"), F.col("o_custkey").cast("string"))
    start = (F.col("o_custkey") % 997).cast("double") + F.col("o_custkey") / 1e7
    base = o.select(F.lit("orders").alias("experiment"), who.alias("run_id"), F.concat(F.lit("group-"), (F.col("o_custkey") % 5).cast("string")).alias("run_name"),
                    start.alias("start_time"), "o_orderkey", "o_totalprice", "o_custkey")
    row = lambda kind, key, value, step: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.cast("string").alias("value"), step.cast("int").alias("step"))
    none = F.lit(None)
    log = base.select("experiment", "run_id", "run_name", "start_time", row("metric", "price", F.col("o_totalprice"), F.col("o_orderkey")).alias("r")).unionAll(
        base.select("experiment", "run_id", "run_name", "start_time", "o_custkey").distinct().select(
            "experiment", "run_id", "run_name", "start_time", F.explode(F.array(
                row("tag", "model_name", F.concat(F.lit("model-"), (F.col("o_custkey") % 3).cast("string")), none),
                row("tag", "model_version", F.col("o_custkey") % 11, none))).alias("r"))).select("experiment", "run_id", "run_name", "start_time", "r.*")
    path = folder(spark, "runs")
    log.write.parquet(path)
    runs = spark.read.parquet(path)
    found = {"name": dict(run_name="group-2"), "version": dict(model_name="model-1", model_version="4"), "latest": dict(model_name="model-2", model_version="latest"),
             "id": dict(run_id="run-7")}
    out = None
    for how, wanted in found.items():
        part = resolve_run(runs, experiment="orders", **wanted).select(F.lit(how).alias("how"), "run_id", "kind", "key", "value", "step")
        out = part if out is None else out.unionByName(part)
    return out
