import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import queries, suffix_dedup
from tests.llm.helpers import DOCS, documents


def plain(texts, length):
    """The contract, window by window."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(hash(r[i:i + length]) for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, dtype=np.int64)
        for i in range(len(r) - length + 1):
            if seen[hash(r[i:i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:len(r)] > 0
        spans = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        out.append((len(r), int(mask.sum()), spans, hashlib.sha256(bytes(b for b, m in zip(r, mask) if not m)).hexdigest()))
    return out


@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=40), st.integers(1, 6))
@settings(deadline=None)
def test_loser_tree_merges(strings, parts):
    runs = []
    for k in range(parts):
        run = sorted(strings[k::parts])
        prefixes, rests = suffix_dedup.front_code(run)
        assert suffix_dedup.front_decode(prefixes, [len(s) for s in run], rests) == run
        runs.append((run, prefixes))
    merged = [(runs[r][0][i], same) for r, i, same in suffix_dedup.LoserTree(runs)]
    assert [s for s, _ in merged] == sorted(strings)
    for (a, _), (b, same) in zip(merged, merged[1:]):
        assert same == len(a) if b.startswith(a) else a[:same] == b[:same] and a[same] != b[same]


@given(st.binary(max_size=80), st.binary(max_size=80), st.integers(0, 80))
def test_common_prefix(a, b, k):
    b = a[:k] + b
    want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert suffix_dedup.common_prefix(a, b) == want == suffix_dedup.common_prefix(a, b, min(k, len(a)))


@given(st.lists(st.integers(0, 120), min_size=1, max_size=4), st.integers(0, 5), st.sampled_from([(20, 13), (20, 1), (12, 5)]))
@settings(deadline=None)
def test_every_window_has_its_anchor(sizes, seed, lengths):
    length, width = lengths
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in sizes]
    found = suffix_dedup.anchors(b"".join(texts), np.append(0, np.cumsum(sizes)), length, width)
    base = np.cumsum(sizes) - sizes
    windows = {}
    for t, place, low, high in zip(*(x.tolist() for x in found)):
        for d in range(low, high + 1):
            start = place - d - int(base[t])
            assert (t, start) not in windows
            windows[t, start] = d
    assert set(windows) == {(t, i) for t, n in enumerate(sizes) for i in range(n - length + 1)}
    same = {}
    for (t, i), d in windows.items():  # equal windows have equal distances
        assert same.setdefault(texts[t][i:i + length], d) == d


def passages(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    some = [" ".join(word() for _ in range(rng.randint(4, 30))) for _ in range(12)]
    out = []
    for _ in range(90):
        parts = [rng.choice(some)[rng.randint(0, 12):] if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 5))]
        text = " ".join(parts)
        if out and rng.random() < 0.2:
            text = rng.choice(out)
            if text and rng.random() < 0.6:
                i = rng.randrange(len(text))
                text = text[:i] + "X" + text[i + 1:]
        out.append(text)
    return out + ["ab" * 60, "a" * 100, "a" * 20, None, ""]


FIGURES = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("options", [{}, {"class_kinds": 1}, {"range_kinds": 7}, {"class_kinds": 3, "range_kinds": 20}])
def test_removal_equals_plain(spark, options):
    texts = passages()
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    for length, width in ((20, 13), (40, 8)) if not options else ((20, 13),):
        rows = suffix_dedup.remove_repeats(docs, length=length, width=width, **options).collect()
        got = {r.doc_id: tuple(r[f] for f in FIGURES) for r in rows}
        assert len(rows) == len(texts) and [got[i] for i in range(len(texts))] == plain(texts, length)


def test_long_text_in_stretches(spark, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abc ") for _ in range(9_000))
    texts = [long, long[3_000:3_500] + "#" + long[7_990:], "x" + long[10:2_000]]
    monkeypatch.setattr(suffix_dedup, "STEP", 700)
    rows = suffix_dedup.remove_repeats(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), length=30, width=16).collect()
    assert sorted(map(tuple, rows)) == [(i, *f) for i, f in enumerate(plain(texts, 30))]


def test_awkward_rows(spark):
    docs = documents(spark)
    for length in (20, 400):
        got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs, length=length, width=13).collect())
        assert got == Counter((r[0], *f) for r, f in zip(DOCS, plain([r[1] for r in DOCS], length)))
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, length=20, width=14)


def test_op12_equals_plain(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain([r.text for r in rows], 400)))
    got = queries.op12_suffix_dedup(spark, d).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r[f] for f in FIGURES) for r in got} == want
    assert any(r.n_removed for r in got) and any(not r.n_removed for r in got)


def test_kept_and_spans_equal_plain(spark):
    texts = passages(3)
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    rows = suffix_dedup.cut_repeats(docs, length=20, width=13).collect()
    want = plain(texts, 20)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id]
        assert all(a.start < a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        gone = {i for s in r.spans for i in range(s.start, s.end)}
        assert r.kept == bytes(b for i, b in enumerate(raw) if i not in gone)


def test_op12_gives_what_is_left(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n, k=9: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(k)) for _ in range(n))
    planted, short = words(60), words(55, 4)
    assert len(planted.encode()) >= 400 > len(short.encode())
    heads, tails = [f"{i} {words(40)}\n" for i in range(9)], [f"\n{words(30)} {i}" for i in range(9)]
    texts = [h + (planted if i < 3 else short if i < 5 else "") + t for i, (h, t) in enumerate(zip(heads, tails))]
    texts += [texts[8], words(50) + "ê", None, ""]  # 8 and 9 are copies
    texts += [texts[10][:-1] + "â"]  # the repeat ends inside a character
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_suffix_dedup(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts))) and [tuple(got[i][f] for f in FIGURES) for i in range(len(texts))] == plain(texts, 400)
    for i in range(3):  # the line breaks on both sides are part of the repeat
        assert got[i].text == heads[i][:-1] + tails[i][1:]
        assert got[i].spans == f"{len(heads[i].encode()) - 1}:{len((heads[i] + planted).encode()) + 1}"
    for i in range(3, 8):
        assert (got[i].text, got[i].spans) == (texts[i], "")
    for i in (8, 9):
        assert (got[i].text, got[i].spans) == ("", f"0:{len(texts[8].encode())}")
    assert [got[i].text for i in (10, 11, 12, 13)] == ["\ufffd", "", "", "\ufffd"]
