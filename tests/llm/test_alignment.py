import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import queries, token_alignment
from tests.llm.helpers import DOCS, documents

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "aabst're'vdmlL   \n\t\x0b\x85 é中١²Ⅷ'’!?_-▁​😀ſKﬁ<0x41></s>"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(letters))}
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL), letters


def plain(libraries, texts):
    """The contract, document by document and pair by pair."""
    a, b, letters = libraries
    rows, held = [], Counter()
    for t in texts:
        groups, pairs = [], []
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                spans = []
                for ids, data in ((ids_a, bytes_a), (ids_b, bytes_b)):
                    ends = np.cumsum([len(d) for d in data]).tolist()
                    spans.append([(e - len(d), e, i) for e, d, i in zip(ends, data, ids)])
                marks = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                grouped = [defaultdict(list), defaultdict(list)]
                for side in (0, 1):
                    for _, e, i in spans[side]:
                        grouped[side][int(np.searchsorted(marks, e))].append(i)
                groups = [(grouped[0][g], grouped[1][g]) for g in range(len(marks))]
                pairs = [(i, j) for s, e, i in spans[0] for s2, e2, j in spans[1] if s < e2 and s2 < e]
        held.update(set(pairs))
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), groups, pairs))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    return [(n_a, n_b, len(groups), len(pairs), sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs),
             hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else "")
            for n_a, n_b, groups, pairs in rows]


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=30), max_size=5))
@settings(max_examples=200, deadline=None)
def test_pieces_equal_the_library(libraries, texts):
    model = token_alignment.Pieces(open(MODEL, "rb").read())
    texts = [t for t in texts if t and "▁" not in t]
    got, counts = model.encode_flat([" " + t for t in texts]) if texts else (np.zeros(0), np.zeros(0))
    want = [libraries[1].encode(t) for t in texts]
    assert got.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_cut_keeps_everything():
    rng = random.Random(5)
    for _ in range(300):
        text = " " + "".join(rng.choice("ab  \n.é") if rng.random() < 0.7 else "x" * rng.randint(1, 60) for _ in range(rng.randint(0, 200)))
        pieces = token_alignment.cut(text, 30)
        assert "".join(text[low:high] for _, low, high, _ in pieces) == text
        for start, low, high, stop in pieces:
            assert start <= low < high <= stop
            assert start == 0 or (text[start] == " " and not text[start - 1].isspace())
            assert stop == len(text) or (text[stop] == " " and not text[stop - 1].isspace())


def random_fragment(rng):
    tokens = lambda n: token_alignment.Open(*(np.array([rng.randint(0, 9) for _ in range(n)], dtype=np.int64) for _ in range(4)))
    piece = token_alignment.Fragment.empty()
    piece.bounded = rng.random() < 0.6
    piece.prefix = tokens(rng.randint(0, 2))
    if piece.bounded:
        piece.suffix = tokens(rng.randint(1, 2))
        piece.n_groups, piece.text = 1, f"{rng.randint(0, 99)}|1"
        piece.codes, piece.mult = np.array([rng.randint(0, 5)]), np.array([rng.randint(1, 3)])
    return piece


def test_composition_is_associative():
    rng = random.Random(1)
    for _ in range(300):
        x, y, z = (random_fragment(rng) for _ in range(3))
        both = token_alignment.compose(token_alignment.compose(x, y, 10), z, 10), token_alignment.compose(x, token_alignment.compose(y, z, 10), 10)
        assert both[0].pack() == both[1].pack()
        assert token_alignment.compose(token_alignment.Fragment.empty(), x, 10).pack() == x.pack()


@given(st.lists(st.lists(st.tuples(st.integers(0, 2 ** 32 - 1), st.integers(1, 2 ** 31 - 1)), max_size=6), max_size=4))
@settings(deadline=None)
def test_packed_links_come_back(docs):
    docs = [dict(d) for d in docs]
    rows = [(i, c, m) for i, d in enumerate(docs) for c, m in sorted(d.items())]
    doc, code, mult = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
    codes, back, place, times = token_alignment.unpack_links(token_alignment.pack_links(doc, code, mult))
    assert [(d, codes[p], m) for d, p, m in zip(back.tolist(), place.tolist(), times.tolist())] == rows


def long_texts():
    rng = random.Random(3)
    words = ["internationalisation", "the", " ", "  ", "don't", "é", "日本語", "\n\n", "x" * 90, "▁", "AKIA", "...", "😀"]
    out = [" ".join(rng.choice(words[:9]) for _ in range(60)) for _ in range(6)]
    return out + ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(80)), "y" * 700, "a " + "z" * 300 + " b c " * 30, "<|endoftext|> x </s> <0x41>"]


def test_align_equals_plain(spark, libraries):
    texts = [r[1] if r[0] != 6 else "word " * 500 for r in DOCS] + long_texts()
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    want = plain(libraries, texts)
    for chunk, block in ((40, 300), (1 << 16, 8_000_000)):
        got = {r.doc_id: tuple(r[f] for f in FIGURES) for r in token_alignment.align(docs, JSON, MODEL, chunk=chunk, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert token_alignment.align(docs.limit(0), JSON, MODEL).count() == 0


def test_repeated_and_null_keys(spark, libraries):
    want = Counter(zip([r[0] for r in DOCS], plain(libraries, [r[1] if r[0] != 6 else "w" for r in DOCS])))
    docs = documents(spark, [(*r[:1], "w" if r[0] == 6 else r[1], *r[2:]) for r in DOCS])
    got = Counter((r.doc_id, tuple(r[f] for f in FIGURES)) for r in token_alignment.align(docs, JSON, MODEL).collect())
    assert got == want
    odd = documents(spark, extra=False).select(F.col("doc_id").alias("a.b"), "text")
    assert token_alignment.align(odd, JSON, MODEL, keys=["a.b"]).count() == len(DOCS)


def test_op11_equals_plain(spark, libraries):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain(libraries, [r.text[:1500] if r.text else r.text for r in rows])))
    short = spark.createDataFrame([(r.doc_id, r.text[:1500] if r.text else r.text) for r in rows], "doc_id long, text string")
    got = {r.doc_id: tuple(r[f] for f in FIGURES) for r in token_alignment.align(short, JSON, MODEL).collect()}
    assert got == want
    whole = queries.op11_alignment(spark, d)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert whole.where("n_links = n_a + n_b - n_groups AND count_sum >= n_links AND n_best <= n_links").count() == len(rows)
