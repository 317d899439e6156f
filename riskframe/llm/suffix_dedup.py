"""Removal of long repeats by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else, in the same text or another.  Not every suffix is sorted: every window of
``length`` bytes names one anchor inside it, the leftmost smallest hash of eight
bytes among its first ``width`` starts.  That depends on the window's bytes alone, so
equal windows have equal anchors at equal distances, and only suffixes that start
at anchors are needed, together with the bytes before them.  An anchor and the
distances ``low`` .. ``high`` to the windows that name it stand for these windows.

1. One scan gives the anchors with two digests: of the bytes that all its windows
   share from the anchor on (``near``), and of all its windows' bytes (``full``).
   Anchors whose ``near`` occurs once have no repeated window and go.
2. Anchors of one ``full`` that occurs twice or more repeat in all their windows.
   Equal ones are counted before any of their bytes move, so a passage that a third
   of all documents share is one *kind*.
3. What is left are kinds that share ``near`` and differ elsewhere (ends of passages,
   edits).  Their suffixes are sorted: tasks sort runs of them and send them
   front-coded (common prefix with the suffix before, then the rest), a range of
   ``near`` to each receiver; a receiver merges its runs with a loser tree that
   compares common-prefix lengths first and characters only beyond the known prefix.
   From the merged order's common prefixes, and those of the bytes before the anchors
   read backwards, every window finds whether another kind has the same one.
   A ``near`` with more kinds than a receiver should hold is not sorted: its windows are
   counted by digests on Spark, which is exact too, combines before the shuffle and
   has no bound.

Texts are known by a digest, so equal texts are one; a text of ``length`` or more
bytes with a copy goes as a whole.  Digests have 128 bits (``near`` with ``full``; keys).

Results
-------
``cut_repeats``: one row per input row with the columns named ``keys`` and ``n_bytes``,
``spans`` (maximal removed runs in order: byte offsets, end exclusive), ``kept`` (the bytes
left, which may break a character).  ``remove_repeats``: the same as figures, ``n_bytes``,
``n_removed``, ``n_spans``, ``kept_sha256``.  A null text is an
empty one; texts shorter than ``length`` keep everything; repeated rows are copies of
each other; an empty table gives no rows; columns other than the keys and the text are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import chunks, columns, spread_join, stored

#: Bytes of a repeat, and starts among which a window's anchor is the smallest.
LENGTH, WIDTH = 400, 256
#: Bytes whose hash orders the starts.
GRAM = 8
#: Bytes of text whose anchors are found at once.
STEP = 1_000_000
#: Rows whose texts are Python strings at once while they are cut.
SLICE = 500
#: Kinds of one receiver's range in the mean, kinds of one ``near`` that a receiver may sort, kinds of one sorted run.
RANGE_KINDS, CLASS_KINDS, RUN_KINDS = 40_000, 20_000, 20_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def anchors(data: bytes, bounds: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts laid end to end: text, place, and the least and largest distance of the windows that name it."""
    sizes = np.diff(bounds)
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    if not len(text):
        return (np.zeros(0, np.int64),) * 4
    start = np.arange(len(text)) + np.repeat(bounds[:-1] - (np.cumsum(windows) - windows), windows)
    n = -(-len(data) // width) * width + width
    raw = np.frombuffer(data + bytes(n - len(data) + 8), dtype=np.uint8)
    grams = np.ndarray((n,), dtype="<u8", buffer=raw, strides=(1,)) * _MIX
    value = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)  # ties: the leftmost
    blocks = value.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[start], ahead[start + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return text[first], place[first], place[first] - start[last], place[first] - start[first]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _anchor_rows(texts: DataFrame, length: int, width: int) -> DataFrame:
    """All anchors of the distinct texts of each task."""
    shared = length - width + 1

    def rows_of(data: bytes, bounds: list[int], names: list[bytes], shift: int) -> pa.RecordBatch:
        marks = np.array(bounds, dtype=np.int64)
        text, place, low, high = anchors(data, marks, length, width)
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        near = [_signed(digest(view[p:p + shared])) for p in place.tolist()]
        full = [_signed(digest(view[p - b:p + length - a], b << 16 | a)) for p, a, b in zip(place.tolist(), low.tolist(), high.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(near, pa.int64()), pa.array(full, pa.int64()), pa.array(names, pa.binary()).take(pa.array(text)),
             pa.array(place - marks[text] + shift), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=list(ANCHOR))

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part, found in chunks(batch, "__text", STEP):
                data, bounds, names = [], [0], []
                for name, t in zip(part.column("key").to_pylist(), found):
                    raw = t.encode()
                    if name in seen or len(raw) < length:
                        continue
                    seen.add(name)
                    if len(raw) > 2 * STEP:  # a long text in overlapping stretches of windows
                        for at in range(0, len(raw) - length + 1, STEP):
                            piece = raw[at:at + STEP + length - 1]
                            yield rows_of(piece, [0, len(piece)], [name], at)
                        continue
                    data.append(raw)
                    bounds.append(bounds[-1] + len(raw))
                    names.append(name)
                if names:
                    yield rows_of(b"".join(data), bounds, names, 0)
    return texts.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in ANCHOR.items()))


ANCHOR = {"near": "long", "full": "long", "key": "binary", "place": "long", "low": "int", "high": "int"}


def _once(texts: DataFrame) -> DataFrame:
    """``key`` and ``__text`` of the texts, each text once a task, so that copies do not meet in one task with their text."""
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for i, name in enumerate(batch.column("key").to_pylist()):
                if name not in seen:
                    seen.add(name)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))
    return texts.mapInArrow(run, texts.schema)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in their first ``known`` bytes."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most  # they agree up to low, not up to high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class LoserTree:
    """Merge of sorted runs of strings with their common prefixes (each with the string before it in its run)."""

    def __init__(self, runs: Sequence[tuple[Sequence[bytes], Sequence[int]]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.known = [0] * self.size  # common prefix of each run's head with the string given out last
        self.tree = [0] * self.size
        self.top = self._play(1)

    def _head(self, run: int) -> bytes | None:
        return self.runs[run][0][self.at[run]] if run < len(self.runs) and self.at[run] < len(self.runs[run][0]) else None

    def _contest(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.known[a] != self.known[b]:  # the one that agrees longer with the last string is smaller
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        same = common_prefix(x, y, self.known[a])
        if x[same:same + 1] <= y[same:same + 1]:
            self.known[b] = same
            return a, b
        self.known[a] = same
        return b, a

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.tree[node] = self._contest(self._play(2 * node), self._play(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """Run, place in the run and common prefix with the string before, in the order of the strings."""
        while self._head(run := self.top) is not None:
            yield run, self.at[run], self.known[run]
            self.at[run] += 1
            if self._head(run) is not None:
                self.known[run] = self.runs[run][1][self.at[run]]
            winner, node = run, (run + self.size) >> 1
            while node:
                winner, self.tree[node] = self._contest(winner, self.tree[node])
                node >>= 1
            self.top = winner


def front_code(strings: Sequence[bytes]) -> tuple[list[int], bytes]:
    """Common prefixes of sorted strings with the one before, and the rests laid end to end."""
    prefixes = [0, *(common_prefix(a, b) for a, b in zip(strings, strings[1:]))] if strings else []
    return prefixes, b"".join(s[k:] for s, k in zip(strings, prefixes))


def front_decode(prefixes: Sequence[int], sizes: Sequence[int], rests: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for k, size in zip(prefixes, sizes):
        last = last[:k] + rests[at:at + size - k]
        at += size - k
        out.append(last)
    return out


def repeated_windows(right: np.ndarray, left: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray,
                     length: int) -> list[tuple[int, int, int]]:
    """Kind, first and last distance of every run of windows that another kind has too.

    Kinds are numbered in the order of their suffixes; ``right`` are the common prefixes there, ``left`` those of the bytes
    before the anchors read backwards, in the order ``order`` of these.
    """
    rows, distances = [], []
    for d in range(int(low.min(initial=length)), int(high.max(initial=-1)) + 1):
        here = np.flatnonzero((low <= d) & (high >= d))
        if len(here) < 2:
            continue
        a = np.cumsum(right < length - d)[here]
        b = np.empty(len(order), dtype=np.int64)
        b[order] = np.cumsum(left < d)
        code = a * (len(order) + 1) + b[here]
        by = np.argsort(code, kind="stable")
        code = code[by]
        same = code[1:] == code[:-1]
        twice = np.append(same, False) | np.append(False, same)
        rows.append(here[by][twice])
        distances.append(np.full(int(twice.sum()), d))
    if not sum(map(len, rows)):
        return []
    kind, d = np.concatenate(rows), np.concatenate(distances)
    by = np.lexsort((d, kind))
    kind, d = kind[by], d[by]
    new = np.ones(len(kind), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (d[1:] != d[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(kind)) - 1
    return list(zip(kind[first].tolist(), d[first].tolist(), d[last].tolist()))


RUN = {"range": "int", "prefixes": "array<int>", "sizes": "array<int>", "rests": "binary", "lefts": "array<binary>", "full": "array<long>",
       "low": "array<int>", "high": "array<int>", "single": "array<boolean>", "key": "array<binary>", "place": "array<long>"}


def _runs(held: DataFrame, length: int, ranges: int) -> DataFrame:
    """Sorted, front-coded runs of the asked kinds' suffixes, one row per run and range."""
    def rows_of(kinds: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds.sort(key=lambda k: k[:2])
        at = 0
        while at < len(kinds):
            end = at
            while end < len(kinds) and kinds[end][0] == kinds[at][0]:
                end += 1
            part = kinds[at:end]
            prefixes, rests = front_code([k[1] for k in part])
            columns = [[part[0][0]], [prefixes], [[len(k[1]) for k in part]], [rests], *([[k[i] for k in part]] for i in range(2, 9))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUN_TYPES)], names=list(RUN))
            at = end

    def run(batches):
        kinds: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                raw, key = batch.column("__text")[i].as_py().encode(), batch.column("key")[i].as_py()
                for k in batch.column("kinds")[i].as_py():
                    p = k["place"]
                    kinds.append((k["near"] % ranges, raw[p:p + length - k["low"]], raw[p - k["high"]:p], k["full"], k["low"], k["high"], k["n"] == 1, key, p))
                if len(kinds) >= RUN_KINDS:
                    yield from rows_of(kinds)
                    kinds = []
        yield from rows_of(kinds)
    return held.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in RUN.items()))


_INTS, _LONGS, _BYTES = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())
_RUN_TYPES = [pa.int32(), _INTS, _INTS, pa.binary(), _BYTES, _LONGS, _INTS, _INTS, pa.list_(pa.bool_()), _BYTES, _LONGS]


def _merge(table: pa.Table, length: int) -> pa.Table:
    """Spans of the single kinds of one range of which windows repeat."""
    rows = table.to_pylist()
    runs = [(front_decode(r["prefixes"], r["sizes"], r["rests"]), r["prefixes"]) for r in rows]
    right, kinds, equal = [], [], set()
    for run, at, same in LoserTree(runs):
        r = rows[run]
        kind = (r["full"][at], r["lefts"][at][::-1], r["low"][at], r["high"][at], r["single"][at], r["key"][at], r["place"][at])
        if same < len(runs[run][0][at]):
            equal = set()
        elif kind[0] in equal:  # the same kind again, from a copy of its text
            continue
        equal.add(kind[0])
        kinds.append(kind)
        right.append(same)
    order = sorted(range(len(kinds)), key=lambda i: kinds[i][1])
    left = [-1, *(common_prefix(kinds[a][1], kinds[b][1]) for a, b in zip(order, order[1:]))]
    column = lambda i: np.array([k[i] for k in kinds], dtype=np.int64)
    found = [(kinds[i][5], kinds[i][6] - last, kinds[i][6] - first + length)
             for i, first, last in repeated_windows(np.array(right), np.array(left), np.array(order), column(2), column(3), length) if kinds[i][4]]
    return pa.table({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate((("key", pa.binary()), ("start", pa.int64()), ("end", pa.int64())))})


SPAN = "key binary, start long, end long"


def _digest_windows(held: DataFrame, length: int) -> DataFrame:
    """Spans of single kinds of crowded classes: windows are counted by 128-bit digests."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw, key = memoryview(batch.column("__text")[i].as_py().encode()), batch.column("key")[i].as_py()
                for k in batch.column("kinds")[i].as_py():
                    starts = range(k["place"] - k["high"], k["place"] - k["low"] + 1)
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([xxhash.xxh3_128_digest(raw[s:s + length]) for s in starts], pa.binary()), pa.array([k["full"]] * n, pa.int64()),
                         pa.array([k["n"] == 1] * n), pa.array([key] * n, pa.binary()), pa.array(list(starts), pa.int64())],
                        names=["window", "full", "single", "key", "start"])
    windows = stored(held.mapInArrow(run, "window binary, full long, single boolean, key binary, start long"))
    twice = windows.groupBy("window").agg(F.min("full").alias("a"), F.max("full").alias("b")).where("a <> b").select("window")
    found = spread_join(windows.where("single"), twice, "window", windows.count(), ["key", "start"])
    return found.select("key", "start", (F.col("start") + length).alias("end"))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that spans cover."""
    runs: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], stop)
        else:
            runs.append((start, stop))
    return runs


def rest(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    if not runs:
        return raw
    return b"".join(raw[a:b] for a, b in zip([0, *(stop for _, stop in runs)], [*(start for start, _ in runs), len(raw)]))


def cut_repeats(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), length: int = LENGTH, width: int = WIDTH,
                class_kinds: int = CLASS_KINDS, range_kinds: int = RANGE_KINDS) -> DataFrame:
    """``keys``, ``n_bytes``, ``spans`` and ``kept`` of every row."""
    if not 1 <= width <= length - GRAM + 1:
        raise ValueError("a window must hold the hashes of all its starts")
    given, names = list(keys), [f"__key{i}" for i in range(len(keys))]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)).alias("key")
    rows = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(given, names)), key, whole.alias("__text"), F.monotonically_increasing_id().alias("row"))
    texts = docs.select(key, whole.alias("__text")).where(F.octet_length("__text") >= length)

    every = stored(_anchor_rows(texts, length, width))
    n_anchors = every.count()
    again = every.groupBy("near").agg(F.count("*").alias("n")).where("n > 1").select("near")
    every = stored(spread_join(every, again, "near", n_anchors, ["key", "place"]).withColumn("kind", F.struct("near", "full")))
    kinds = stored(every.groupBy("kind").agg(F.count("*").alias("n"), F.min_by(F.struct("key", "place", "low", "high"), F.struct("key", "place")).alias("at"))
                   .select("kind", "kind.near", "kind.full", "n", "at.*"))
    sure = spread_join(every.select("kind", "key", "place", "low", "high"), kinds.where("n > 1").select("kind"), "kind", n_anchors, ["key", "place"])
    sure = sure.select("key", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end"))

    mixed = kinds.groupBy("near").agg(F.count("*").alias("__kinds"), F.min("n").alias("__least")).where("__kinds > 1 AND __least = 1").drop("__least")
    asked = stored(spread_join(kinds.drop("kind"), mixed, "near", n_anchors, ["full"]))
    crowded = F.col("__kinds") > class_kinds
    ranges = max(1, -(-asked.where(~crowded).count() // range_kinds))

    def with_text(part: DataFrame) -> DataFrame:
        wanted = part.groupBy("key").agg(F.collect_list(F.struct("near", "full", "place", "low", "high", "n")).alias("kinds"))
        return _once(texts).join(wanted, "key")

    merged = stored(_runs(with_text(asked.where(~crowded)), length, ranges)).groupBy("range").applyInArrow(lambda t: _merge(t, length), SPAN)
    spans = sure.unionAll(merged).unionAll(_digest_windows(with_text(asked.where(crowded)), length))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    copies = stored(rows.groupBy("key").agg(F.count("*").alias("copies")))
    n_rows = copies.agg(F.sum("copies")).first()[0] or 0
    known = spans.join(copies.where("copies > 1"), "key", "full_outer")
    out = T.StructType(rows.select(*names).schema.fields).add("n_bytes", "long").add("spans", SPANS).add("kept", "binary")

    def cut(batches):
        slices = (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))
        for some in slices:
            for part, found in chunks(some, "__text", STEP):
                raws = [t.encode() for t in found]
                runs = [[(0, len(raw))] if again and len(raw) >= length else joined([(s["start"], s["end"]) for s in spans or ()])
                        for raw, again, spans in zip(raws, part.column("copies").to_pylist(), part.column("spans").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(map(len, raws), pa.int64()),
                     pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], _SPANS), pa.array(map(rest, raws, runs), pa.binary())],
                    names=[*names, "n_bytes", "spans", "kept"])

    met = spread_join(rows, known, "key", n_rows, ["row"], "left").select(*names, "__text", "spans", "copies")
    return met.mapInArrow(cut, out).select(*(F.col(n).alias(k) for n, k in zip(names, given)), "n_bytes", "spans", "kept")


SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def figures() -> list[Column]:
    """``n_removed``, ``n_spans``, ``kept_sha256`` of rows of ``cut_repeats``."""
    return [(F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
            F.sha2("kept", 256).alias("kept_sha256")]


def remove_repeats(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), length: int = LENGTH, width: int = WIDTH,
                   class_kinds: int = CLASS_KINDS, range_kinds: int = RANGE_KINDS) -> DataFrame:
    """``keys``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row."""
    found = cut_repeats(docs, text, keys, length, width, class_kinds, range_kinds)
    return found.select(*columns(keys), "n_bytes", *figures())
