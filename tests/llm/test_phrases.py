import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import phrases, queries
from tests.llm.helpers import DOCS, documents


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, least=10, within=50, top=2000):
    """The contract, phrase by phrase."""
    words, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            found = re.findall("[^ \t]+", piece)
            words[lang] += len(found)
            for k in (1, 2, 3):
                f.update((lang, tuple(found[i:i + k])) for i in range(len(found) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in candidates.items():
        if len(p) == 3:
            for part in (p[:2], p[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    out = {}
    for (lang, p), a in candidates.items():
        if len(p) == 2 and 100 * longer[lang, p] >= within * a and longer[lang, p]:
            continue
        cuts = [(10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, words[lang], -score)
            for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])}


def run(docs, **options):
    got = phrases.collocations(docs, **options).collect()
    assert len(got) == len(set(got))
    return set(map(tuple, got))


@given(st.lists(st.text(st.sampled_from("Aab  \t.\n\x0b\x85é!"), max_size=30), max_size=5))
@settings(deadline=None)
def test_words(texts):
    words, begins, per_text = phrases.words_of(texts)
    pieces = [[re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", lower(t))] for t in texts]
    assert words.to_pylist() == [w for t in pieces for p in t for w in p]
    assert begins.tolist() == [i == 0 for t in pieces for p in t for i in range(len(p))]
    assert per_text.tolist() == [sum(map(len, t)) for t in pieces]


@given(st.lists(st.integers(0, 6), max_size=60), st.booleans())
@settings(deadline=None)
def test_index_counts_phrases(numbers, far):
    numbers = np.array(numbers, dtype=np.int64) * ((1 << 28) if far else 1)
    shard = phrases.Shard(numbers, 3)
    f = Counter(tuple(numbers[i:i + k].tolist()) for k in (2, 3) for i in range(len(numbers) - k + 1) if numbers[i:i + k].all())
    pairs = dict(zip(*(x.tolist() for x in shard.pairs())))
    assert pairs == {p[0] << 32 | p[1]: n for p, n in f.items() if len(p) == 2}
    frequent = sorted(p for p, n in pairs.items() if n > 1)
    got = {(p, t): n for p, t, n in zip(*(x.tolist() for x in shard.triples(np.array(frequent, dtype=np.int64))))}
    assert got == {(p[0] << 32 | p[1], p[2]): n for p, n in f.items() if len(p) == 3
                   and {p[0] << 32 | p[1], p[1] << 32 | p[2]} <= set(frequent)}


def texts(seed=4):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "city", "the", "of", "a", "ÉTÉ", "x|y", "b", "日本"]
    return [(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(rng.randint(0, 80))) + " new york city",
             rng.choice(["en", "fr", None, "und"])) for _ in range(150)]


def test_collocations_equal_plain(spark):
    rows = texts()
    docs = documents(spark, [(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)])
    assert run(docs) == plain(rows)
    assert run(docs, shard=400) == plain(rows)
    assert run(docs, least=4, within=90, top=7, shard=1000) == plain(rows, 4, 90, 7)


def test_awkward_rows(spark):
    docs = documents(spark)
    assert run(docs, least=2) == plain([(r[1], r[2]) for r in DOCS], 2)
    assert run(docs.limit(0)) == set()


def test_large_counts_stay_exact():
    """a a 10^6 passes 64 bits long before a does."""
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.getOrCreate()
    a, left, right = 9_000_000_000_000, 9_000_000_000_001, 9_000_000_000_002
    got = spark.createDataFrame([(a, left, right)], "a long, x long, y long").select(phrases._score("a", phrases.F.col("x"), phrases.F.col("y"))).first()[0]
    assert got == 10 ** 6 * a * a // (left * right)


def test_op13_equals_plain(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").select("text", "lang").collect()]
    got = queries.op13_phrases(spark, d).collect()
    assert set(map(tuple, got)) == plain(rows) and len(got) == len(set(got))
