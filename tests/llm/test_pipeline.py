import collections
import inspect

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskframe.llm import langid, quality, queries
from tests.llm.helpers import DOCS, documents
from tests.llm.test_documents import WORD, plain_components, plain_counts, plain_fingerprint

SMALL = "/root/testdata/sf0.001"


def plain_votes(text):
    """The rules' votes, counted again without Spark."""
    n, chars, symbols, dup, repeat = plain_counts(text)
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    upper = sum(c in quality.UPPER for c in text or "")
    ended = sum(x.rstrip(quality.SPACES)[-1] in quality.ENDS for x in lines)
    marks = sum(len(w) <= 3 and w.upper() == w.lower() and w < "0" for w in words)
    function = len(set(words) & set(quality.FUNCTION_WORDS))
    emphasis = (text or "").count("!!")

    def vote(bad, good):
        return -1 if bad else 1 if good else 0
    return (vote(symbols > 0.1 * n, symbols < 0.02 * n), vote(symbols > 0.05 * chars, symbols < 0.005 * chars),
            vote(dup > 0.3 * len(lines), dup == 0 and len(lines) > 1), vote(repeat > 0.15 * n, repeat < 0.03 * n),
            vote(upper > 0.3 * chars, upper < 0.08 * chars), vote(ended < 0.3 * len(lines), ended >= 0.8 * len(lines)),
            vote(emphasis > 0.1 * n, False), vote(marks > 0.15 * n, marks < 0.03 * n),
            vote(chars < 3 * n or chars > 9 * n, 3.5 * n <= chars <= 8 * n), vote(n < 12, n >= 50), vote(function == 0 and n >= 20, function >= 2))


def base_ok(text):
    n = plain_counts(text)
    return n[0] >= 10 and 100 * n[4] <= 20 * n[0]


def plain_quality(rows):
    """Texts that pass, by the posterior of the same model over plainly counted votes."""
    found = [(r, plain_votes(r.text)) for r in rows if base_ok(r.text)]
    model = quality.estimate(list(collections.Counter(v for _, v in found).items()))
    prior = np.log(model.good / (1 - model.good))
    gain = lambda votes: prior + sum(up if v > 0 else down if v < 0 else 0 for v, (up, down) in zip(votes, model.weights()))
    return [r for r, v in found if gain(v) >= 0]


def redacted(text):
    from tests.llm.test_documents import plain_spans
    spans = sorted((int(a), int(b)) for a, b in (s.split(":")[1:] for s in plain_spans(text)))
    out, at = [], 0
    while spans:
        a, b = spans.pop(0)
        while spans and spans[0][0] < b:
            b = max(b, spans.pop(0)[1])
        out += [text[at:a], "[REDACTED]"]
        at = b
    return "".join([*out, text[at:]])


def plain_cuts(n, most):
    out = []
    while n:
        out.append(most if n >= most else 1 << n.bit_length() - 1)
        n -= out[-1]
    return out


def test_pipeline_against_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = plain_quality(docs.collect())
    kept = spark.createDataFrame(rows, docs.schema)
    model = langid.fit(kept, ~F.coalesce(queries.held_out(), F.lit(True)))
    rows = [r for r, (lang, _, sure) in zip(rows, model.judge([r.text for r in rows])) if lang != "und" and sure >= corpus_pipeline.LEAST_SCORE]
    stay = {d for d, _, c in plain_components([(r.doc_id, r.text) for r in rows]) if d == c}
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in rows:
        if r.doc_id in stay:
            ids, start = own.encode(redacted(r.text), add_special_tokens=False).ids + [0], 0
            for size in plain_cuts(len(ids), 1024):
                want[r.doc_id, start] = (size, np.array(ids[start:start + size], "<u4").tobytes(), len(ids), 0)
                start += size
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert len(got) == len(want) and len({r.sequence_id for r in got}) == len(got)
    assert {(r.doc_id, r.start): (r.length, bytes(r.ids), r.doc_tokens, r.offset) for r in got} == want


def test_stages_keep_columns_and_take_awkward_rows(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"]
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out, empty = stage(spark, docs, ""), stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes) and empty.columns == docs.columns
        kept[name] = out.collect()
    assert all(base_ok(r.text) for r in kept["quality"]) and {r.row for r in kept["quality"]} <= {"clash"}
    assert all(r.text is not None for r in kept["language"])
    groups = {c if c is not None else f"null {m}" for _, m, c in plain_components([(d, t) for d, t, *_ in DOCS])}
    assert len(kept["near_duplicates"]) == len(groups)
    marks = [plain_fingerprint(r.text) for r in kept["near_duplicates"]]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(marks) for b in marks[:i])
    assert len(kept["secrets"]) == len(DOCS) and sum(r.text is None for r in kept["secrets"]) == sum(r[1] is None for r in DOCS)
    changed = [r for r in kept["secrets"] if r.text and "[REDACTED]" in r.text]
    assert changed and all(r.n_chars == len(r.text) for r in changed)


def test_language_stage_keeps_mixed_texts_and_unlabelled_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null")
    words = {}
    for r in docs.orderBy("doc_id").limit(600).collect():
        words.setdefault(r.lang, []).extend(r.text.split())
    assert len(words) >= 3
    mixed = " ".join(" ".join(words[k][:60]) for k in sorted(words)[:4])
    new = docs.limit(1).withColumns({"doc_id": F.lit(10 ** 9).cast(docs.schema["doc_id"].dataType), "text": F.lit(mixed),
                                     "lang": F.lit(None).cast("string")}).select(docs.columns)
    model = langid.fit(docs, ~F.coalesce(queries.held_out(), F.lit(True)))
    [(_, score, certainty)] = model.judge([mixed])
    assert score < corpus_pipeline.LEAST_SCORE < certainty
    kept = corpus_pipeline.language_stage(spark, docs.unionByName(new), "")
    assert kept.where(F.col("doc_id") == 10 ** 9).count() == 1
    bare = docs.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_stage(spark, bare, "").count() == 20


def test_columns_of_any_name_pass_through(spark, tmp_path):
    names = ["meta.src", "a`b", "row", "key_a", "text.len", "q", "__text", "spans"]
    docs = documents(spark, extra=False)
    for n in names:
        docs = docs.withColumn(n, F.lit("kept"))
    docs.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r[n] for r in out.collect() for n in names} <= {"kept"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_run_leaves_the_last_folder_only(spark):
    import pathlib

    from riskframe.session import ensure_checkpoint_dir
    root = pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.glob("corpus-*"))
    corpus_pipeline.run(spark, SMALL)
    [new] = set(root.glob("corpus-*")) - before
    assert [p.name for p in new.iterdir() if p.is_dir()] == ["4-packing"]
