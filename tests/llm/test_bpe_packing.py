import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import bpe, packing, pretokens, queries
from tests.llm.helpers import DOCS, documents

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PATTERN = regex.compile(public_tokenizers.PATTERN)
ALPHABET = "aabst're'vdmlL  \n\t\r\x0b\x1c\x85  é中١²Ⅷ'’!?_-​😀ſK"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.from_ranks(open(RANKS, "rb").read())


def ids(data):
    return np.frombuffer(data, "<i4").tolist()


@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=25), max_size=6))
@settings(max_examples=300, deadline=None)
def test_split_equals_pattern(texts):
    pieces, counts = pretokens.split(texts)
    at = 0
    for t, n in zip(texts, counts):
        assert pieces[at:at + n] == PATTERN.findall(t)
        at += n
    assert at == len(pieces)


@given(st.lists(st.one_of(st.text(max_size=30), st.text(st.sampled_from(ALPHABET), max_size=40)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_encode_equals_tiktoken(library, vocab, texts):
    for t, got in zip(texts, vocab.encode(texts)):
        assert ids(got) == library.encode_ordinary(t)
        assert vocab.decode(np.array(ids(got), np.int32)) == t.encode()


def test_long_pieces(library, vocab):
    for t in ("a" * 20_000, " " * 9_000 + "x", "ab" * 5_000, "日本語" * 3_000, "=" * 4_097):
        assert ids(vocab.encode([t])[0]) == library.encode_ordinary(t)


def test_tokenizers_file_gives_the_librarys_ids():
    vocab, own = bpe.Vocabulary.from_json(open(JSON, "rb").read()), Tokenizer.from_file(JSON)
    rng = random.Random(2)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(500)] + [r[1] or "" for r in DOCS] + [
        "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext|", " \n<|endoftext|>\n "]
    for got, want in zip(vocab.encode(texts), own.encode_batch(texts, add_special_tokens=False)):
        assert ids(got) == want.ids


def test_forgetting_keeps_results(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER_BYTES", 10)
    assert vocab.encode(["one two", "two three"]) == vocab.encode(["one two", "two three"])


def test_unknown_id_is_refused(vocab):
    with pytest.raises(ValueError):
        vocab.decode(np.array([10 ** 6]))


def test_encode_decode_frames(spark, library):
    docs = documents(spark)
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    want = sorted(((r[0] is None, r[0] or 0, library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in DOCS))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, bytes(r.decoded)) for r in rows) == want
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS), RANKS).count() == 0


def test_op4_against_library(spark, library):
    import hashlib
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op4_bpe(spark, d).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=5), st.sampled_from([1, 8, 1024]))
@settings(deadline=None)
def test_pieces(totals, most):
    which, starts, lengths = packing.pieces_of(np.array(totals), most)
    for i, n in enumerate(totals):
        mine = sorted((s, k) for w, s, k in zip(which.tolist(), starts.tolist(), lengths.tolist()) if w == i)
        got = [k for _, k in mine]
        assert [s for s, _ in mine] == [sum(got[:j]) for j in range(len(got))]
        assert sum(got) == n and all(c & (c - 1) == 0 and 0 < c <= most for c in got) and got == sorted(got, reverse=True)
        assert len(got) == n // most + bin(n % most).count("1")


def test_added_tokens_only_where_asked():
    vocab, own = bpe.Vocabulary.from_json(open(JSON, "rb").read()), Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "", "x"]
    got, counts = vocab.encode_flat(texts, added=False)
    assert got.tolist() == sum((own.encode(t, add_special_tokens=False).ids for t in texts), []) and counts.sum() == len(got)


def test_vocabulary_is_built_once_in_a_process(spark):
    """The function that tasks get is pickled by name: a copy shares the process's vocabularies, which are not sent along."""
    from pyspark import cloudpickle
    get = bpe.vocabulary(spark, RANKS)
    assert cloudpickle.loads(cloudpickle.dumps(get.func)) is bpe.load and get() is get()


def test_pack_frames(spark):
    own = Tokenizer.from_file(JSON)
    rows = packing.pack(documents(spark), JSON, keys=("doc_id", "text"), max_length=16).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    by = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 16 and len(r.ids) == 4 * r.length
        by.setdefault((r.doc_id, r.text), []).append(r)
    assert set(by) == {(r[0], r[1]) for r in DOCS}
    for (doc_id, text), pieces in by.items():
        times = sum((r[0], r[1]) == (doc_id, text) for r in DOCS)
        want = own.encode(text or "", add_special_tokens=False).ids + [0]
        pieces.sort(key=lambda r: r.start)
        assert sum((ids(p.ids) for p in pieces[::times]), []) == want and {p.doc_tokens for p in pieces} == {len(want)}
    assert packing.pack(documents(spark).limit(0), JSON).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents(spark), JSON, max_length=1000)


def test_buckets_are_written_by_length(spark, tmp_path):
    packing.write_buckets(packing.pack(documents(spark), JSON), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where(F.octet_length("ids") != 4 * F.col("length")).count() == 0


def test_op5_covers_every_id_once(spark):
    own = Tokenizer.from_file(JSON)
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: own.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    seen = dict.fromkeys(want, 0)
    for r in sorted(queries.op5_packing(spark, d).collect()):
        assert seen[r.doc_id] == r.start and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in want.items()}
