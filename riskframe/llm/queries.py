"""The registered queries of the training-data operators and their DuckDB checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import bpe, fingerprints, html_text, langid, packing, phrases, quality, secret_scan, sharding, simhash, suffix_dedup, token_alignment, warc
from riskframe.llm.common import table
from riskframe.session import cut_lineage, ensure_checkpoint_dir


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives in the shared folder, read them back and assemble the captures."""
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(cut_lineage(warc.read(spark, path, payloads=False)))
    page_id = lambda fields: F.try_element_at(fields, F.lit("page-id")).try_cast("long")
    return captures.select(
        page_id(F.col("metadata.fields")).alias("page_id"),
        F.coalesce("response.payload_bytes", "refers_to.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "refers_to.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), page_id(F.col("refers_to.fields")).alias("refers_to"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text."""
    marks = fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encode every document by the rank file, decode the ids, and give digests of both."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Pack every document into sequences of at most 1024 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents (3-word shingles) and their groups at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the base's figures in every document and judge it by weak supervision over all documents' votes."""
    counted = cut_lineage(quality.counts(table(spark, sf_dir, "documents"), ["doc_id"]))
    model = quality.fit(counted)
    return counted.select("row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
                          quality.base_failed().alias("base_failed"), quality.kept(model).alias("kept"),
                          *[v.alias(f"vote_{r.name}") for v, r in zip(quality.votes(), quality.VOTES)],
                          model.log_odds().alias("log_odds"))


def held_out() -> Column:
    """Documents that language identification never learns from: a fifth, by a checksum of the id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn languages from four fifths of the documents and predict that of all."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~F.coalesce(held_out(), F.lit(True)))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every document for secrets."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(secret_scan.base_kinds()))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all documents into 16 shards of nearly equal bytes, equal texts together."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op11_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Align the tokens of both tokenizers in every document and count the linked id pairs over all."""
    found = token_alignment.align(table(spark, sf_dir, "documents"), path_a or public_tokenizers.path("byte_bpe_50k.json"),
                                  path_b or public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every passage of 400 bytes or more that stands elsewhere too."""
    found = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_bytes", *suffix_dedup.figures(), joined.alias("spans"),
                        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two or three words."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_warc": op2_warc,
    "op3_fingerprints": op3_fingerprints,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_langid": op8_langid,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_phrases": op13_phrases,
}

_GROUPS = ", ".join(f"('0x' || substr(x, {10 * g + 1}, 10))::BIGINT AS g{g}" for g in range(4))
_BASE32 = " || ".join(f"substr('{warc.BASE32}', CAST((g{g} >> {35 - 5 * k}) & 31 AS INTEGER) + 1, 1)" for g in range(4) for k in range(8))

ORACLE: dict[str, str] = {
    "op2_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
        d AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS lead_id, {_GROUPS} FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = lead_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> lead_id THEN lead_id END AS refers_to FROM d""",
}
