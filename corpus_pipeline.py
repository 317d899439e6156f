"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each one of the operators of ``riskframe.llm`` over all that the stage
before kept:

* ``quality``: documents that the quality rules reject go;
* ``language``: documents without a language, or whose words no language explains, go (texts in several
  languages stay; without any labelled document nothing can be learned and all stay);
* ``near_duplicates``: of each group of SimHash near-duplicates one row stays;
* ``secrets``: every secret in a text is replaced by ``[REDACTED]`` (``n_chars`` follows);
* ``packing``: the remaining texts become sequences of ids.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns that they were given.  ``run`` writes each result as Parquet into
the shared folder and reads it again, so a lost executor costs one stage at most.

Null and empty texts fail the quality rules and go with the first stage; each stage
on its own also takes them: ``language`` drops them (if it learned a language), ``near_duplicates`` keeps one,
``secrets`` passes them on, ``packing`` gives them the separator only.  Repeated rows
are near-duplicates.  An empty table gives an empty result.  Extra columns of any name
are passed on up to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import langid, packing, quality, secret_scan, simhash
from riskframe.llm.common import columns, drop_folder, spread_join, stored
from riskframe.llm.queries import held_out
from riskframe.session import cut_lineage, ensure_checkpoint_dir

#: Least mean, over a document's words, of the posterior of each word's own most probable language.
LEAST_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that weak supervision over all documents' votes finds good.

    One pass counts and writes the rows with their counts; the model is fitted on, and the verdict read from, what was written."""
    counted = stored(quality.counts(docs, docs.columns))
    return counted.where(quality.kept(quality.fit(counted))).select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose words are clearly of some learned language, one or several."""
    model = langid.fit(docs, ~F.coalesce(held_out(), F.lit(True)))
    if not model.labels:
        return docs
    found = langid.predict(docs.select(F.struct(*columns(docs.columns)).alias("row")), model, text="row.text", keys=["row"], certainty=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("certainty") >= LEAST_SCORE)).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group (of rows that agree in everything, one).

    Only ids, fingerprints and 128 bits that stand for a row are grouped; the texts are shuffled once, to meet the rows that stay.
    Rows that agree in everything share one key: they meet it in several tasks, each of which keeps one of them before they come together.
    """
    plain = [columns([f.name])[0] for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = docs.select(F.struct(*columns(docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"),
                        F.xxhash64(*plain).alias("key_a"), F.xxhash64(F.lit("b"), *plain[::-1]).alias("key_b"))
    found = simhash.near_duplicates(keyed, shingle=3, radius=2, keys=["doc_id", "key_a", "key_b"])
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key_a"), F.col("key_b"))
    stay = cut_lineage(found.groupBy("group").agg(F.min_by(F.struct("key_a", "key_b"), order).alias("key")).select("key"))
    rows = keyed.select("row", F.struct("key_a", "key_b").alias("key"), F.monotonically_increasing_id().alias("copy"))
    met = spread_join(rows, stay, "key", docs.count(), ["copy"])
    return met.groupBy("key").agg(F.first("row").alias("row")).select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact every span of every rule."""
    found = secret_scan.scan(docs.select(F.struct(*columns(docs.columns)).alias("row")), text="row.text", keys=["row"], redact=True)
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences of at most 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Weak supervision, a trained model and SimHash groups are not expressed in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:  # what the stage before wrote is not needed any more
            drop_folder(spark, before)
        before = path
    return docs
