"""Alignment of two tokenizers by an associative monoid of fragments.

Tokenizer A (byte-level BPE, a tokenizers file) and tokenizer B (a sentencepiece
model) cut the same bytes, a space and the text, in two ways.  Where a token of A
and one of B start at the same byte is a boundary; boundaries cut the tokens into
groups.  A token of A and one of B are linked where their byte ranges overlap.

A document is summarised in byte-range chunks.  A chunk's fragment holds the tokens
that start in its range: an open prefix (those before the chunk's first boundary,
whose group began in an earlier chunk), the closed groups, and an open suffix (from
the last boundary on).  ``compose`` joins two neighbouring fragments: the left
suffix and the right prefix close into one group.  It is associative, so the chunks
of a very long document are dealt over Spark's tasks, and rounds of grouped
compositions reduce them to one fragment.  A document of one chunk is closed at
once; all documents of a step are summarised together on arrays.

A chunk's text reaches to the nearest place on either side at which no token of
either tokenizer can cross (a blank after a character that is not white space), so
its tokens are those of the whole text.  Where no such place lies within a chunk's
length, neighbouring chunks are one.

How many documents hold an id pair is counted per block of documents and then over
all.  The counts go back the same way: every block asks once for each pair it holds,
so what is shuffled is blocks x distinct pairs and each block's packed links, never
a row per link.  Frequent pairs are split in the join.

Results
-------
``align``: one row per input row (repeated rows and null or repeated keys are rows of
their own) with the columns named ``keys`` and ``n_a``, ``n_b``, ``n_groups``,
``n_links``, ``n_best``, ``count_sum`` (long) and ``groups`` (SHA-256 of the
groups' ids as text).  A null or empty text, or one whose tokens do not give back its
bytes (B turns U+2581 into a space), has no tokens: zeros and ''.  An empty table
gives no rows; columns other than the keys and the text are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.bpe import Remembering, Vocabulary, vocabulary
from riskframe.llm.common import chunks, shuffle_partitions, spread_join, stored

#: Characters of a chunk of a document.
CHUNK = 1 << 16
#: Characters of a block of documents, within which an id pair is counted and asked for once.
BLOCK = 4_000_000
#: Characters of short documents summarised at once.
STEP = 1_000_000
#: Bytes of pieces that each tokenizer remembers in a worker process.
REMEMBER = 40_000_000
#: Neighbouring fragments that one composition of a round takes.
FAN_IN = 16

#: Fixed value: sentencepiece's mark of a space.
BLANK = "▁"


class Pieces(Remembering):
    """Ids and bytes of a sentencepiece model's pieces."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        data = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        #: No piece has a blank after another character, so none crosses the start of a run of blanks.
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in names)
        self.blank = self.model.piece_to_id(BLANK)
        self.lengths = np.array([len(d) for d in data], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.forget()

    def ids_of(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.model.encode([name[1:] for name in names], num_threads=1)  # the model puts the first space itself,
        rows = [r if len(name) > 1 else [self.blank] for r, name in zip(rows, names)]  # but not before nothing
        return np.array(list(chain.from_iterable(rows)), dtype=np.int32), np.array([len(r) for r in rows], dtype=np.int64)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (which begin with a space) in a row, and how many each has."""
        if not self.by_word:
            return self.ids_of(texts)
        data = "".join(texts).encode()
        raw = np.frombuffer(data, dtype=np.uint8)
        ends = np.cumsum([len(t.encode()) for t in texts])
        blank = raw == 32
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[np.append(0, ends[:-1])] = True
        at = np.flatnonzero(starts)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data))
        return self.gather(words, np.diff(np.searchsorted(at, np.append(0, ends))))


_models: dict[str, Pieces] = {}


def load_model(key: str, sent: Broadcast) -> Pieces:
    """The model of a broadcast file, built once in a worker process."""
    if key not in _models:
        _models[key] = Pieces(sent.value)
    return _models[key]


def model(spark: SparkSession, path: str):
    """A function that gives the model of ``path`` inside tasks."""
    with open(path, "rb") as f:
        data = f.read()
    return partial(load_model, hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data))


@dataclass
class Open:
    """Tokens whose group is not closed yet: ids and starting bytes in the document."""

    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray

    @staticmethod
    def empty() -> Open:
        none = np.zeros(0, np.int64)
        return Open(none, none, none, none)

    def __add__(self, other: Open) -> Open:
        return Open(*(np.concatenate((getattr(self, f.name), getattr(other, f.name))) for f in fields(Open)))

    def close(self, width: int) -> Fragment:
        """The fragment of the one group that these tokens form (of nothing: the empty fragment)."""
        if not len(self.a) or not len(self.b):
            return Fragment.empty()
        codes, mult = np.unique(links(self.a, self.a_at, self.b, self.b_at, width), return_counts=True)
        text = ",".join(map(str, self.a.tolist())) + "|" + ",".join(map(str, self.b.tolist()))
        return Fragment(True, True, Open.empty(), Open.empty(), 1, len(self.a), len(self.b), text, codes, mult)


@dataclass
class Fragment:
    """What a byte range of a document says about its groups.

    ``bounded``: there is a boundary in the range; without one all tokens are in ``prefix``.  ``good``: tokens give back the bytes.
    """

    good: bool
    bounded: bool
    prefix: Open
    suffix: Open
    n_groups: int
    n_a: int
    n_b: int
    text: str
    codes: np.ndarray
    mult: np.ndarray

    @staticmethod
    def empty() -> Fragment:
        none = np.zeros(0, np.int64)
        return Fragment(True, False, Open.empty(), Open.empty(), 0, 0, 0, "", none, none)

    def pack(self) -> list:
        """Values of a row (``ROW``)."""
        arrays = [getattr(part, f.name) for part in (self.prefix, self.suffix) for f in fields(Open)]
        return [self.good, self.bounded, self.n_groups, self.n_a, self.n_b, self.text,
                *(np.asarray(x, dtype="<i8").tobytes() for x in (*arrays, self.codes, self.mult))]

    @staticmethod
    def unpack(row: list) -> Fragment:
        good, bounded, n_groups, n_a, n_b, text, *data = row
        arrays = [np.frombuffer(d, dtype="<i8") for d in data]
        return Fragment(good, bounded, Open(*arrays[:4]), Open(*arrays[4:8]), n_groups, n_a, n_b, text, *arrays[8:])


ROW = T.StructType([T.StructField("good", T.BooleanType()), T.StructField("bounded", T.BooleanType()),
                    *(T.StructField(n, T.LongType()) for n in ("n_groups", "n_a", "n_b")), T.StructField("text", T.StringType()),
                    *(T.StructField(f"{p}_{n}", T.BinaryType()) for p in ("prefix", "suffix") for n in ("a", "a_at", "b", "b_at")),
                    T.StructField("codes", T.BinaryType()), T.StructField("mult", T.BinaryType())])


def compose(left: Fragment, right: Fragment, width: int) -> Fragment:
    """The fragment of two neighbouring byte ranges; associative, with ``Fragment.empty()`` as its unit."""
    good = left.good and right.good
    if not right.bounded:
        if not left.bounded:
            return Fragment(good, False, left.prefix + right.prefix, Open.empty(), 0, 0, 0, "", left.codes, left.mult)
        return Fragment(good, True, left.prefix, left.suffix + right.prefix, left.n_groups, left.n_a, left.n_b, left.text, left.codes, left.mult)
    if not left.bounded:
        return Fragment(good, True, left.prefix + right.prefix, right.suffix, right.n_groups, right.n_a, right.n_b, right.text, right.codes, right.mult)
    middle = (left.suffix + right.prefix).close(width)
    parts = [left, middle, right]
    codes, back = np.unique(np.concatenate([p.codes for p in parts]), return_inverse=True)
    mult = np.bincount(back, weights=np.concatenate([p.mult for p in parts]), minlength=len(codes)).astype(np.int64)
    total = lambda name: sum(getattr(p, name) for p in parts)
    return Fragment(good, True, left.prefix, right.suffix, total("n_groups"), total("n_a"), total("n_b"),
                    ";".join(p.text for p in parts if p.text), codes, mult)


def links(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, width: int, key: np.ndarray | None = None) -> np.ndarray:
    """``a x width + b`` of every overlapping pair (with ``key`` of A's token above it).

    Both cut the same bytes and begin together: each stretch between neighbouring starts lies in one token of either.
    """
    order = np.argsort(np.concatenate((a_at, b_at)), kind="stable")
    at = np.concatenate((a_at, b_at))[order]
    is_a = order < len(a_at)
    last = np.append(at[1:] != at[:-1], True)[:len(at)]
    which_a, which_b = (np.cumsum(is_a) - 1)[last], (np.cumsum(~is_a) - 1)[last]
    code = a[which_a].astype(np.int64) * width + b[which_b]
    return code if key is None else (key[which_a] << 32) | code


class Aligner:
    """Both tokenizers, for many chunks at once."""

    def __init__(self, a: Vocabulary, b: Pieces):
        self.a, self.b, self.width = a, b, len(b.lengths)
        a.remember = b.remember = REMEMBER
        if len(a.lengths) * self.width >= 1 << 32:
            raise ValueError("an id pair must fit 32 bits")
        self.decimal = pa.array([str(i) for i in range(max(len(a.lengths), self.width))])

    def _faithful(self, texts: list[str]) -> tuple[list[int], list[str], tuple]:
        """The texts that both tokenizers give back (their places, themselves), and their ids and counts by A and B."""
        a, na = self.a.encode_flat(texts, added=False)
        b, nb = self.b.encode_flat(texts)
        sizes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
        every = np.arange(len(texts))
        good = np.ones(len(texts), dtype=bool)
        for ids, counts, source in ((a, na, self.a), (b, nb, self.b)):
            good &= np.bincount(np.repeat(every, counts), weights=source.lengths[ids], minlength=len(texts)) == sizes
        if good.any():
            keep_b = np.repeat(good, nb)
            ids = b[keep_b]
            lengths = self.b.lengths[ids]
            ends = np.cumsum(lengths)
            decoded = self.b.bytes[np.repeat(self.b.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])]
            wrong = np.flatnonzero(decoded != np.frombuffer("".join(t for t, g in zip(texts, good) if g).encode(), dtype=np.uint8))
            if wrong.size:
                kept = every[good]
                good[kept[np.unique(np.searchsorted(np.cumsum(sizes[good]), wrong, side="right"))]] = False
        if not good.all():
            a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        places = every[good]
        return places.tolist(), [texts[i] for i in places], (a.astype(np.int64), na[good], b.astype(np.int64), nb[good], sizes[good])

    def fragments(self, texts: list[str], low: np.ndarray, high: np.ndarray, last: np.ndarray, begin: np.ndarray):
        """Fragments of chunks: text i's tokens that start at its bytes low[i] <= byte < high[i]; ``begin`` is the text's first byte in the document.

        Gives ``(good places, per good chunk: n_groups, n_a, n_b, text of groups, opens or None)`` and the closed links as sorted
        ``chunk << 32 | code`` with their counts, chunks numbered among the good ones.
        """
        places, texts, (a, na, b, nb, sizes) = self._faithful(texts)
        n = len(places)
        low, high, last, begin = (np.asarray(x)[places] for x in (low, high, last, begin))
        base = np.cumsum(sizes) - sizes
        a_at = np.cumsum(self.a.lengths[a]) - self.a.lengths[a]
        b_at = np.cumsum(self.b.lengths[b]) - self.b.lengths[b]
        a_in, b_in = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
        if (low > 0).any() or (high < sizes).any():
            mine = (a_at >= (base + low)[a_in]) & (a_at < (base + high)[a_in])
            a, a_at, a_in = a[mine], a_at[mine], a_in[mine]
            mine = (b_at >= (base + low)[b_in]) & (b_at < (base + high)[b_in])
            b, b_at, b_in = b[mine], b_at[mine], b_in[mine]
        found = np.searchsorted(b_at, a_at)
        is_bound = np.zeros(len(a_at), dtype=bool)
        inside = found < len(b_at)
        is_bound[inside] = b_at[found[inside]] == a_at[inside]
        bounds = a_at[is_bound]
        a_group, b_group = np.cumsum(is_bound) - 1, np.searchsorted(bounds, b_at, side="right") - 1
        first, end = np.searchsorted(bounds, base + low), np.searchsorted(bounds, base + high)
        n_groups = np.maximum(end - first - ~last, 0)
        closed = np.zeros(len(bounds) + 1, dtype=bool)
        bound_in = np.repeat(np.arange(n), end - first)
        closed[:-1] = np.arange(len(bounds)) < (first + n_groups)[bound_in]
        a_closed = closed[a_group] & (a_group >= first[a_in])
        b_closed = closed[b_group] & (b_group >= first[b_in])
        ca, cb, of = a[a_closed], b[b_closed], np.cumsum(closed) - 1
        groups = int(closed.sum())
        half = lambda ids, group: pc.binary_join(pa.ListArray.from_arrays(
            pa.array(np.searchsorted(of[group], np.arange(groups + 1)).astype(np.int32)), self.decimal.take(pa.array(ids))), ",")
        both = pc.binary_join_element_wise(half(ca, a_group[a_closed]), half(cb, b_group[b_closed]), "|")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_groups)).astype(np.int32)), both), ";").to_pylist()
        counts = [np.bincount(part, minlength=n).tolist() for part in (a_in[a_closed], b_in[b_closed])]
        codes, mult = np.unique(links(ca, a_at[a_closed], cb, b_at[b_closed], self.width, a_in[a_closed]), return_counts=True)
        opens: list[tuple[bool, Open, Open] | None] = [None] * n
        for i in np.flatnonzero((low > 0) | ~last).tolist():
            ra, rb = np.arange(*np.searchsorted(a_in, [i, i + 1])), np.arange(*np.searchsorted(b_in, [i, i + 1]))
            shift = int(begin[i] - base[i])
            parts = []
            for pick in (lambda g, i=i: g < first[i], lambda g, i=i: (g >= first[i]) & ~closed[g]):
                pa_, pb_ = ra[pick(a_group[ra])], rb[pick(b_group[rb])]
                parts.append(Open(a[pa_], a_at[pa_] + shift, b[pb_], b_at[pb_] + shift))
            opens[i] = (bool(end[i] > first[i]), *parts)
        return places, list(zip(n_groups.tolist(), *counts, text, opens)), codes, mult


_SAFE = re.compile(r"(?<=\S) ")


def cut(text: str, size: int) -> list[tuple[int, int, int, int]]:
    """Chunks of a text of more than ``size`` characters: context start, range start, range end, context end (characters).

    The contexts begin and end where no token crosses; a range bound with no such place within ``size`` on either side is left out.
    """
    def before(at: int) -> int:
        while (at := text.rfind(" ", max(at - size, 1), at)) > 0:
            if not text[at - 1].isspace():
                return at
        return -1

    bounds = [(0, 0, 0)]
    for at in range(size, len(text), size):
        after = _SAFE.search(text, at, min(at + size, len(text)))
        start = before(at)
        if after and start > bounds[-1][1]:
            bounds.append((start, at, after.start()))
    bounds.append((len(text), len(text), len(text)))
    return [(a[0], a[1], b[1], b[2]) for a, b in zip(bounds, bounds[1:])]


def _chunk_rows(docs: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """A row per chunk of the texts of more than ``size`` characters, dealt over tasks: ``doc``, ``no``, the keys (with chunk 0), text and range."""
    names = list(keys)
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("no", T.LongType()), *(docs.schema[k] for k in names),
                           T.StructField("part", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("low", "high", "begin")),
                           T.StructField("last", T.BooleanType())])

    def run(batches):
        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                text = " " + batch.column("__text")[i].as_py()
                pieces, at = cut(text, size), 0
                sized = lambda a, b, text=text: len(text[a:b].encode())
                for no, (start, low, high, stop) in enumerate(pieces):
                    begin = at - sized(start, low)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc]), pa.array([no]), *(batch.column(k).slice(i, 1) for k in names), pa.array([text[start:stop]]),
                         pa.array([at - begin]), pa.array([at - begin + sized(low, high)]), pa.array([begin]),
                         pa.array([no == len(pieces) - 1])], names=schema.names)
                    at += sized(low, high)
                doc += 1
    found = docs.where(F.length("__text") >= size).mapInArrow(run, schema)
    return found.repartition(shuffle_partitions(docs.sparkSession), "doc", "no")


#: What is known of a document, or (with ``payload``) of a block's links.
_DOC = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups", T.StringType())]


def pack_links(doc: np.ndarray, code: np.ndarray, mult: np.ndarray) -> bytes:
    """A block's distinct links per document (sorted by document and code), small: a dictionary of codes, steps through it, multiples."""
    names, place = np.unique(code, return_inverse=True)
    step = np.diff(place, prepend=0).astype("<i4")
    steps = np.where(np.diff(doc, prepend=-1) > 0, place, step).astype("<i4")
    planes = lambda x: np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    counts = np.bincount(doc) if len(doc) else np.zeros(0)
    head = np.array([len(names), len(code), len(counts)], dtype="<i8").tobytes()
    body = planes(np.diff(names.view(np.int64), prepend=0).astype("<u4").view("<i4")) + planes(steps) + planes(mult) + planes(counts)
    return head + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_links(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of the block, and per document's distinct link: document, place of its code among them, multiple."""
    n_names, n, n_docs = np.frombuffer(payload[:24], dtype="<i8").tolist()
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[24:]), dtype=np.uint8), 0, []
    for size in (n_names, n, n, n_docs):
        out.append(np.ascontiguousarray(raw[at:at + 4 * size].reshape(4, -1).T).view("<u4" if not out else "<i4").ravel().astype(np.int64))
        at += 4 * size
    names, steps, mult, counts = out
    doc = np.repeat(np.arange(n_docs), counts)
    total = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    has = counts > 0
    before = np.zeros(n_docs, dtype=np.int64)
    before[has] = total[first[has]] - steps[first[has]]
    return np.cumsum(names), doc, total - before[doc], mult


class _Block:
    """Rows of documents and their links, given out as a block when it is large enough."""

    def __init__(self, schema: T.StructType, number: int):
        self.names, self.types = schema.names, [_arrow(f.dataType) for f in schema.fields]
        self.number, self.size = number, 0
        self.rows: list[list] = []
        self.parts: list[tuple] = []
        self.columns: list[pa.Table] = []

    def add(self, keys: pa.RecordBatch, figures: list[tuple], doc: np.ndarray, code: np.ndarray, mult: np.ndarray, size: int) -> None:
        self.parts.append((doc + len(self.rows), code, mult))
        self.columns.append(keys)
        self.rows += figures
        self.size += size

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            n = len(self.rows)
            doc, code, mult = (np.concatenate(x) for x in zip(*self.parts))
            head = [pa.array([self.number] * n), pa.array(range(n), pa.int64())]
            keys = pa.Table.from_batches(self.columns).combine_chunks()
            figures = [pa.array(x, t) for x, t in zip(zip(*self.rows), self.types[2 + keys.num_columns:])]
            columns = [*head, *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in keys.columns), *figures, pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=self.names)
            nulls = [pa.nulls(1, c.type) for c in columns[1:-1]]
            yield pa.RecordBatch.from_arrays([pa.array([self.number]), *nulls, pa.array([pack_links(doc, code, mult)], pa.binary())], names=self.names)
            self.number += 1
        self.size, self.rows, self.parts, self.columns = 0, [], [], []


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def _short_blocks(docs: DataFrame, aligner, keys: Sequence[str], size: int, block: int, schema: T.StructType) -> DataFrame:
    names = list(keys)

    def run(batches):
        align, out = aligner(), _Block(schema, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for part, texts in chunks(batch, "__text", STEP):
                has = [i for i, t in enumerate(texts) if t]
                given = [" " + texts[i] for i in has]
                figures = [(0, 0, 0, 0, "")] * len(texts)
                doc = code = mult = np.zeros(0, np.int64)
                if given:
                    zero = np.zeros(len(given), np.int64)
                    ends = np.array([len(t.encode()) for t in given])
                    places, found, codes, mult = align.fragments(given, zero, ends, zero == 0, zero)
                    at = np.array(has, dtype=np.int64)[places]
                    for i, (n_groups, n_a, n_b, text, _) in zip(at.tolist(), found):
                        figures[i] = (n_a, n_b, n_groups, n_a + n_b - n_groups, _digest(text))
                    doc, code = at[codes >> 32], codes & 0xFFFFFFFF
                out.add(part.select(names), figures, doc, code, mult, sum(map(len, texts)))
                if out.size >= block:
                    yield from out.close()
        yield from out.close()
    return docs.where(F.col("__text").isNull() | (F.length("__text") < size)).mapInArrow(run, schema)


def _long_blocks(docs: DataFrame, aligner, keys: Sequence[str], size: int, schema: T.StructType) -> DataFrame:
    names = list(keys)
    rows = T.StructType([T.StructField("doc", T.LongType()), T.StructField("no", T.LongType()), *(docs.schema[k] for k in names), *ROW.fields])

    def summarise(batches):
        align = aligner()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, low, high, begin, last = (row.column(n)[0].as_py() for n in ("part", "low", "high", "begin", "last"))
                places, found, codes, mult = align.fragments([part], np.array([low]), np.array([high]), np.array([last]), np.array([begin]))
                piece = Fragment.empty()
                piece.good = bool(places)
                if places:
                    n_groups, n_a, n_b, text, opens = found[0]
                    bounded, prefix, suffix = opens or (True, Open.empty(), Open.empty())
                    piece = Fragment(True, bounded, prefix, suffix, n_groups, n_a, n_b, text, codes & 0xFFFFFFFF, mult)
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in ("doc", "no", *names)), *_arrays(piece)], names=rows.names)

    def reduce(group: pa.Table) -> pa.Table:
        width = aligner().width
        group = group.combine_chunks().sort_by("no")
        total = Fragment.empty()
        for row in zip(*(group.column(n).to_pylist() for n in ROW.names)):
            total = compose(total, Fragment.unpack(list(row)), width)
        head = group.slice(0, 1)
        return pa.Table.from_arrays([head["doc"], pc.divide(head["no"], FAN_IN), *(head[k] for k in names), *_arrays(total)], names=rows.names)

    def finish(batches):
        width = aligner().width
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                whole = Fragment.unpack([row.column(n)[0].as_py() for n in ROW.names])
                ended = Fragment.empty()
                ended.bounded = True  # the document's end is a boundary
                whole = compose(whole, ended, width)
                out = _Block(schema, -1 - row.column("doc")[0].as_py())
                none, figures = np.zeros(0, np.int64), (0, 0, 0, 0, "")
                doc, code, mult = none, none, none
                if whole.good:
                    figures = (whole.n_a, whole.n_b, whole.n_groups, whole.n_a + whole.n_b - whole.n_groups, _digest(whole.text))
                    doc, code, mult = np.zeros(len(whole.codes), np.int64), whole.codes, whole.mult
                out.add(row.select(names), [figures], doc, code, mult, 0)
                yield from out.close()

    level = stored(_chunk_rows(docs, keys, size).mapInArrow(summarise, rows))
    most = level.agg(F.max("no")).first()[0] or 0
    while most > 0:
        level = level.groupBy("doc", F.floor(F.col("no") / FAN_IN).alias("__to")).applyInArrow(reduce, rows)
        most //= FAN_IN
    return level.mapInArrow(finish, schema)


def _arrays(piece: Fragment) -> list[pa.Array]:
    return [pa.array([v], _arrow(f.dataType)) for v, f in zip(piece.pack(), ROW.fields)]


def _load(a, b) -> Aligner:
    key = (id(a_ := a()), id(b_ := b()))
    if key not in _aligners:
        _aligners[key] = Aligner(a_, b_)
    return _aligners[key]


_aligners: dict[tuple, Aligner] = {}


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keys: Sequence[str] = ("doc_id",),
          chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Groups, links and counts of every row's whole text by the tokenizers of ``path_a`` (json) and ``path_b`` (model)."""
    spark, given, keys = docs.sparkSession, list(keys), [f"__key{i}" for i in range(len(keys))]
    aligner = partial(_load, vocabulary(spark, path_a), model(spark, path_b))
    slim = docs.select(*(F.col(f"`{k}`").alias(name) for k, name in zip(given, keys)), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([T.StructField("__block", T.LongType()), T.StructField("__at", T.LongType()), *slim.schema.fields[:-1], *_DOC,
                           T.StructField("__payload", T.BinaryType())])
    found = stored(_short_blocks(slim, aligner, keys, chunk, block, schema).unionByName(_long_blocks(slim, aligner, keys, chunk, schema)))

    def held(batches):
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, _, place, _ = unpack_links(payload)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(codes), pa.int64()), pa.array(codes),
                                                  pa.array(np.bincount(place, minlength=len(codes)))], names=["__block", "__code", "__docs"])
    pairs = found.where("__payload IS NOT NULL").select("__block", "__payload").mapInArrow(held, "__block long, __code long, __docs long")
    with open(path_b, "rb") as f:
        width = len(Pieces(f.read()).lengths)
    counts = pairs.groupBy("__code").agg(F.sum("__docs").alias("__count"), F.count("*").alias("__blocks"))
    best = counts.groupBy(F.floor(F.col("__code") / width).alias("__a")).agg(F.max("__count").alias("__most"))
    counts = stored(counts.withColumn("__a", F.floor(F.col("__code") / width)).join(best, "__a")
                    .select("__code", "__count", "__blocks", (F.col("__count") == F.col("__most")).alias("__best")))
    total = counts.agg(F.sum("__blocks")).first()[0] or 0
    known = spread_join(pairs.select("__block", "__code"), counts.drop("__blocks"), "__code", total, ["__block"])
    out = T.StructType([*slim.schema.fields[:-1], *_DOC[:4], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), _DOC[4]])

    def answer(block: pa.Table, counts: pa.Table) -> pa.Table:
        rows = block.filter(pc.is_valid(block["__at"])).sort_by("__at").combine_chunks()
        payload = block.filter(pc.is_null(block["__at"]))["__payload"][0].as_py()
        codes, doc, place, mult = unpack_links(payload)
        order = np.argsort(counts["__code"].to_numpy())  # exactly the block's codes
        count, best = counts["__count"].to_numpy()[order], counts["__best"].to_numpy()[order]
        ends = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        total = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x))[ends]).astype(np.int64))
        extra = {"n_best": total(best[place] * mult), "count_sum": total(count[place] * mult)}
        return pa.Table.from_arrays([extra[f.name] if f.name in extra else rows[f.name] for f in out.fields], names=out.names)
    answered = found.groupBy("__block").cogroup(known.groupBy("__block")).applyInArrow(answer, out)
    return answered.select(*(F.col(name).alias(k) for name, k in zip(keys, given)), *out.names[len(keys):])
