"""Byte-level BPE encoding and decoding with segment trees over byte positions.

Each piece of text (see ``pretokens``) is a row of byte symbols.  A segment tree
over the byte positions stores, at every node, the smallest pair rank below it
together with its position, so the root names the leftmost pair of lowest rank.
A merge writes the merged symbol at the left position, unlinks the right one,
and updates the three leaves whose pair changed (left, removed, previous live
neighbour) along their paths to the root: O(log n) a merge, also in pieces of
a million bytes.  Many pieces of similar length are merged in step: one row of
a matrix is one piece's tree.

The encoder remembers the ids of pieces it has seen, within a fixed number of
bytes, so frequent words are merged once per worker process; a chunk's pieces are
numbered by their distinct values and its ids gathered by offsets.  A tokenizers
file's added tokens (``<|endoftext|>``) are matched in the texts before the
pre-tokens, as its library does by default; a rank file has none.

Results
-------
``encode``: one row per input row; a null or empty text gives an empty array of
ids.  Rows repeat and columns other than the id columns and the text are left
out, so clashing extra columns do no harm.  ``decode``: bytes of the ids; null
or empty ids give empty bytes; an id outside the vocabulary fails by name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import pretokens
from riskframe.llm.common import chunks

#: Bytes of remembered pieces in a worker process; beyond, it starts anew.
REMEMBER_BYTES = 64_000_000
#: Characters of text encoded at once inside a task: distinct pieces are looked up once in each such chunk.
CHUNK = 3_000_000
#: Matrix cells (pieces x positions) that are merged in step.
CELLS = 1 << 19

_NONE = np.int64(1 << 62)
_LOW = np.int64((1 << 32) - 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """Open-addressing table (left id, right id) -> (rank, merged id), looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.key = np.full(1 << bits, _EMPTY)
        self.rank = np.full(1 << bits, _NONE, dtype=np.int64)
        self.merged = np.zeros(1 << bits, dtype=np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while rest.size:
            free = self.key[slot] == _EMPTY
            self.key[slot[free]] = keys[rest[free]]
            placed = self.key[slot] == keys[rest]
            self.rank[slot[placed]] = rank[rest[placed]]
            self.merged[slot[placed]] = merged[rest[placed]]
            rest, slot = rest[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (a huge number where the pair never merges) and merged id of each pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = self.key[slot]
        rest = np.flatnonzero((found != keys) & (found != _EMPTY))
        while rest.size:
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.key[slot[rest]]
            rest = rest[(found != keys[rest]) & (found != _EMPTY)]
        return self.rank[slot], self.merged[slot]


class Grown:
    """An array that grows at its end by doubling."""

    def __init__(self, dtype):
        self.data, self.size = np.empty(1024, dtype=dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            data = np.empty(max(need, 2 * len(self.data)), dtype=self.data.dtype)
            data[:self.size] = self.values
            self.data = data
        self.data[self.size:need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.data[:self.size]


class Remembering:
    """The ids of pieces of text, remembered within ``remember`` bytes (``REMEMBER_BYTES`` where it is not set)."""

    remember: int | None = None

    def ids_of(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces in a row, and how many each has."""
        raise NotImplementedError

    def forget(self) -> None:
        """Start the memory of pieces anew."""
        self.seen: dict[str, int] = {}
        self.seen_bytes = 0
        self.slot_ids, self.slot_from, self.slot_len = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def _slots(self, names: list[str]) -> np.ndarray:
        """Places of distinct pieces in the memory; those not there yet are looked up."""
        if self.seen_bytes > (REMEMBER_BYTES if self.remember is None else self.remember):
            self.forget()
        slots = list(map(self.seen.get, names))
        new = [i for i, slot in enumerate(slots) if slot is None]
        if new:
            wanted = [names[i] for i in new]
            ids, lengths = self.ids_of(wanted)
            at = len(self.seen)
            self.seen.update(zip(wanted, range(at, at + len(new))))
            for i, slot in zip(new, range(at, at + len(new))):
                slots[i] = slot
            self.slot_from.extend(self.slot_ids.size + np.cumsum(lengths) - lengths)
            self.slot_ids.extend(ids)
            self.slot_len.extend(lengths)
            self.seen_bytes += 4 * len(ids) + sum(map(len, wanted)) + 160 * len(new)
        return np.array(slots, dtype=np.int64)

    def gather(self, pieces: pa.Array, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (32-bit) and how many each has, from their pieces and how many each has of these."""
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(len(per_text), np.int64)
        coded = pieces.dictionary_encode()
        slot = self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.slot_len.values[slot]
        ends = np.cumsum(lengths)
        ids = self.slot_ids.values[np.repeat(self.slot_from.values[slot] - (ends - lengths), lengths) + np.arange(ends[-1])]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text)))]
        return ids, np.diff(bounds)


class Vocabulary(Remembering):
    """Ids of byte strings, the ranks of pairs, and the pieces remembered by this process."""

    def __init__(self, tokens: dict[bytes, int], merges: Iterator[tuple[bytes, bytes, int]], direct: bool, added: dict[str, int] | None = None):
        self.tokens, self.direct, self.added = tokens, direct, added or {}
        names = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        rows = [(tokens[a], tokens[b], rank, tokens[a + b]) for a, b, rank in merges]
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.pairs = Pairs(table[:, 0], table[:, 1], table[:, 2], table[:, 3])
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(tokens.values()) + 1
        by_id = [b""] * size
        for t, i in tokens.items():
            by_id[i] = t
        self.known = np.zeros(size, dtype=bool)
        self.known[list(tokens.values())] = True
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.forget()

    @classmethod
    def from_ranks(cls, data: bytes) -> Vocabulary:
        """A rank file: base64 of the bytes and the rank, which is the id, on each line."""
        tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}

        def merges():
            for t, rank in tokens.items():
                for i in range(1, len(t)):
                    if t[:i] in tokens and t[i:] in tokens:
                        yield t[:i], t[i:], rank
        return cls(tokens, merges(), direct=True)

    @classmethod
    def from_json(cls, data: bytes) -> Vocabulary:
        """A tokenizers file of a byte-level BPE model: its vocabulary and its list of merges."""
        spec = json.loads(data)
        model = spec["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        to_bytes = lambda s: bytes(letters[c] for c in s)
        tokens = {to_bytes(t): i for t, i in model["vocab"].items() if t not in added}

        def merges():
            for rank, pair in enumerate(model["merges"]):
                a, b = pair.split(" ") if isinstance(pair, str) else pair
                yield to_bytes(a), to_bytes(b), rank
        return cls(tokens, merges(), direct=bool(model.get("ignore_merges")), added=added)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (not empty) as little-endian 32-bit numbers, by segment trees."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            width = 1 << max(1, int(sizes[order[at]] - 1).bit_length())
            end = int(np.searchsorted(sizes[order], width, side="right"))
            end = min(end, at + max(1, CELLS // width))
            rows = order[at:end].tolist()
            self._merge_rows([pieces[i] for i in rows], sizes[order[at:end]], width, out, rows)
            at = end
        return out

    def _merge_rows(self, pieces, sizes, width, out, rows) -> None:
        n = len(pieces)
        here = np.arange(n)
        live = np.arange(width)[None, :] < sizes[:, None]
        symbols = np.zeros((n, width + 1), dtype=np.int32)  # the last column stands for "no neighbour"
        symbols[:, :width][live] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[here, sizes - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        merged = np.zeros((n, width + 1), dtype=np.int32)
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        r, c = np.nonzero(live[:, 1:])
        rank, into = self.pairs.find(symbols[r, c], symbols[r, c + 1])
        merged[r, c] = into
        tree[r, width + c] = np.where(rank < _NONE, (rank << np.int64(32)) | c, _NONE)
        level = width
        while level > 1:
            np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2], out=tree[:, level // 2:level])
            level //= 2
        while True:
            top = tree[here, 1]
            here = here[top < _NONE]
            if not here.size:
                break
            left = (top[top < _NONE] & _LOW)
            gone = after[here, left]
            nxt = after[here, gone]
            symbols[here, left] = merged[here, left]
            after[here, left] = nxt
            before[here, nxt] = left
            live[here, gone] = False
            prev = before[here, left]
            has_next, has_prev = nxt < width, prev >= 0
            rank, into = self.pairs.find(symbols[here, left], symbols[here, nxt])
            merged[here, left] = into
            tree[here, width + left] = np.where(has_next & (rank < _NONE), (rank << np.int64(32)) | left, _NONE)
            tree[here, width + gone] = _NONE
            hp, pp = here[has_prev], prev[has_prev]
            rank, into = self.pairs.find(symbols[hp, pp], symbols[hp, left[has_prev]])
            merged[hp, pp] = into
            tree[hp, width + pp] = np.where(rank < _NONE, (rank << np.int64(32)) | pp, _NONE)
            who = np.concatenate((here, here, hp))
            node = (np.concatenate((left, gone, pp)) + width) >> 1
            while node[0]:
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                node = node >> 1
        ids = np.ascontiguousarray(symbols[:, :width][live], dtype="<i4").tobytes()
        ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        start = 0
        for i, end in zip(rows, ends):
            out[i] = ids[start:end]
            start = end

    def ids_of(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [name.encode() for name in names]
        whole = [self.tokens.get(d) if self.direct else None for d in data]
        rest = [k for k, i in enumerate(whole) if i is None]
        found = [b"" if i is None else i.to_bytes(4, "little") for i in whole]
        for k, ids in zip(rest, self.merge([data[k] for k in rest])):
            found[k] = ids
        return np.frombuffer(b"".join(found), dtype="<i4"), np.array([len(ids) // 4 for ids in found], dtype=np.int64)

    def encode_flat(self, texts: list[str], added: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (32-bit), and how many each text has.

        With ``added``, the file's added tokens are matched in the texts first, as its library does by default.
        """
        if added and self.added_pattern is not None and any(map(self.added_pattern.search, texts)):
            return self._encode_added(texts)
        return self.gather(*pretokens.cut(texts))

    def _encode_added(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner, fixed = [], [], []  # the parts between added tokens, their text, the token after each (-1: none)
        for i, t in enumerate(texts):
            cut = self.added_pattern.split(t)
            parts += cut[::2]
            owner += [i] * len(cut[::2])
            fixed += [self.added[c] for c in cut[1::2]] + [-1]
        ids, counts = self.encode_flat(parts, added=False)
        after = np.array(fixed)
        has = after >= 0
        out = np.insert(ids, np.cumsum(counts)[has], after[has].astype(np.int32))
        return out, np.bincount(owner, weights=counts + has, minlength=len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        ids, counts = self.encode_flat(texts)
        data, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of one row of ids."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        from_ = np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.bytes[from_ + np.arange(ends[-1])].tobytes()


_loaded: dict[str, Vocabulary] = {}


def load(key: str, sent: Broadcast, kind: str) -> Vocabulary:
    """The vocabulary of a broadcast file, built once in a worker process.

    A function of the module, so tasks get it by name and share ``_loaded``.
    """
    if key not in _loaded:
        _loaded[key] = Vocabulary.from_json(sent.value) if kind == "json" else Vocabulary.from_ranks(sent.value)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str) -> Callable[[], Vocabulary]:
    """A function that gives the vocabulary of ``path`` inside tasks; the driver reads the file (a few MB) once and broadcasts it."""
    with open(path, "rb") as f:
        data = f.read()
    kind = "json" if path.endswith(".json") else "ranks"
    return partial(load, hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data), kind)


def id_array(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ids, laid end to end, as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``ids`` (array of int) of every row's whole text; no shuffle."""
    get = vocabulary(docs.sparkSession, path)
    slim = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(f for f in slim.schema.fields[:-1]), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    names = list(keys)

    def run(batches):
        vocab = get()
        for batch in batches:
            for part, texts in chunks(batch, "__text", CHUNK):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), id_array(*vocab.encode_flat(texts))],
                                                 names=[*names, "ids"])
    return slim.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The input with the column ``out`` (binary): the bytes of each row's ids; no shuffle."""
    get = vocabulary(encoded.sparkSession, path)
    schema = T.StructType([*(f for f in encoded.schema.fields if f.name != out), T.StructField(out, T.BinaryType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        vocab = get()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                column = part.column(ids)
                values = column.values.to_numpy(zero_copy_only=False) if len(column.values) else np.zeros(0, np.int32)
                ends = column.offsets.to_numpy()
                empty = column.is_null().to_pylist()
                decoded = [b"" if empty[i] else vocab.decode(values[ends[i]:ends[i + 1]]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(decoded, pa.binary())],
                                                 names=[*names, out])
    return encoded.mapInArrow(run, schema)
