"""Document fingerprints from prefix polynomial hashes.

A text of code points c_0, c_1, ... gets, for each of two prime moduli, the
array of prefix sums of c_j * B^j.  Two differences of that array, shifted by a
power of B, tell whether any two spans are equal, in constant time, and a
binary search over span lengths finds the longest common extension of two
positions (``Prefixes.same``, ``Prefixes.extension``).

The fingerprint of a text is a string of its length, the hash of the whole
text, the hashes of its prefixes and its suffixes at a ladder of lengths
(four an octave: 1, 2, 3, 4, 5, 6, 8, ...), and the lengths and hashes of all the
spans into which the text falls at anchors.  An anchor is a position whose short
window has a smaller hash than every window near it, so it depends on the characters
around it and not on where they stand.

Prefix equality is monotone in the length, so ``likeness`` finds by binary search the
longest rung on which two fingerprints still agree, from the front and from the back.
Spans that occur in both texts count with what the two rungs leave of them.  The sum
over the longer text's length is the likeness: 1 for equal texts, about one half if only
the second half differs, near 1 for a near copy wherever its edits are, about 0 for
unrelated texts.  Texts under ``2 * REACH + WINDOW`` characters have no anchors: for them
only the rungs count.

Results
-------
Null and empty texts have length 0 and equal fingerprints; likeness of two
empty texts is 1, of an empty and another text 0.  Equal texts have equal
fingerprints, whatever their keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import shuffle_partitions

#: Fixed parameters of the hash: primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Rungs an octave of the ladder of prefix lengths.
RUNGS = 4
#: Characters that an anchor's hash covers, and how many positions on either side it must be less than.
WINDOW, REACH = 8, 28
#: A text without an anchor for more than ``LONGEST`` characters is cut every ``STEP`` ones.
LONGEST, STEP = 240, 57

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_inverses: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(tables: list[np.ndarray], which: int, n: int, base: int) -> np.ndarray:
    """Powers base^0 .. base^(n-1) or more modulo the prime, grown by doubling and kept in the process."""
    prime = PRIMES[which]
    while len(tables[which]) < n:
        have = tables[which]
        step = np.uint64(pow(base, len(have), prime))
        tables[which] = np.concatenate((have, have * step % np.uint64(prime)))
    return tables[which]


def powers(which: int, n: int) -> np.ndarray:
    return _grown(_powers, which, n, BASES[which])


def inverse_powers(which: int, n: int) -> np.ndarray:
    return _grown(_inverses, which, n, pow(BASES[which], -1, PRIMES[which]))


class Prefixes:
    """Prefix arrays of one text: ``sums[w][i]`` is the hash of the first ``i`` code points under modulus ``w``, before the modulo."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for w, prime in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(points * powers(w, max(1, self.n))[:self.n] % np.uint64(prime), out=sums[1:])
            self.sums.append(sums)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Hashes of many spans, moved to the origin so that equal spans agree wherever they lie."""
        out = []
        for w, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            out.append((self.sums[w][ends] - self.sums[w][starts]) % p * inverse_powers(w, self.n + 1)[starts] % p)
        return out

    def span(self, start: int, end: int) -> tuple[int, int]:
        a, b = self.spans(np.array([start]), np.array([end]))
        return int(a[0]), int(b[0])

    def same(self, start: int, other: Prefixes, other_start: int, length: int) -> bool:
        """Whether two spans of equal length are equal (but for hash collisions)."""
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def extension(self, start: int, other: Prefixes, other_start: int) -> int:
        """Length of the longest common extension of two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(start, other, other_start, mid):
                low = mid
            else:
                high = mid - 1
        return low


def ladder(n: int) -> np.ndarray:
    """Lengths up to ``n`` at which a fingerprint keeps prefix and suffix hashes."""
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    rungs = np.floor(2 ** (np.arange(int(np.log2(n) * RUNGS) + 2) / RUNGS)).astype(np.int64)
    rungs = np.unique(rungs)
    return rungs[rungs <= n]


def _mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """32 bits of each pair of hashes."""
    mixed = (hashes[0] * np.uint64(2654435761) + hashes[1] * np.uint64(40503 << 16 | 1)) >> np.uint64(16)
    return (mixed & np.uint64(0xFFFFFFFF)).astype(">u4")


def _words(hashes: list[np.ndarray]) -> str:
    return _mixed(hashes).tobytes().hex()


def anchors(own: Prefixes) -> np.ndarray:
    """Positions whose window's hash is less than those of the ``REACH`` positions before and after."""
    count = own.n - WINDOW + 1
    if count < 2 * REACH + 1:
        return np.zeros(0, np.int64)
    at = np.arange(count)
    marks = _mixed(own.spans(at, at + WINDOW)).astype(np.uint32)
    least, width = marks, 1
    while width < REACH:  # minimum over ``width`` positions from each one on
        more = min(width, REACH - width)
        least, width = np.minimum(least[:-more], least[more:]), width + more
    inner = marks[REACH:count - REACH]
    return REACH + np.flatnonzero((inner < least[:len(inner)]) & (inner < least[REACH + 1:]))


def cuts(own: Prefixes) -> np.ndarray:
    """Bounds of the spans of a text: its ends, its anchors, and steps where anchors are far apart."""
    bounds = np.concatenate(([0], anchors(own), [own.n]))
    wide = np.flatnonzero(np.diff(bounds) > LONGEST)
    steps = [np.arange(bounds[i] + STEP, bounds[i + 1], STEP) for i in wide.tolist()]
    return np.sort(np.concatenate((bounds, *steps))) if steps else bounds


def _spans(own: Prefixes) -> str:
    """Two digits of length and eight of hash for every span, in order."""
    if not own.n:
        return ""
    bounds = cuts(own)
    out = np.empty((len(bounds) - 1, 5), np.uint8)
    out[:, 0] = np.diff(bounds)
    out[:, 1:] = _mixed(own.spans(bounds[:-1], bounds[1:])).view(np.uint8).reshape(-1, 4)
    return out.tobytes().hex()


def fingerprint(text: str) -> str:
    """``length:whole:prefixes:suffixes:spans`` in hex."""
    own = Prefixes(text)
    rungs = ladder(own.n)
    whole = own.span(0, own.n)
    zero, full = np.zeros(len(rungs), np.int64), np.full(len(rungs), own.n)
    return f"{own.n:x}:{whole[0]:08x}{whole[1]:08x}:{_words(own.spans(zero, rungs))}:{_words(own.spans(full - rungs, full))}:{_spans(own)}"


def _left(spans: str, front: int, back: int) -> dict[str, list[int]]:
    """For each span's length and hash, how many characters of every occurrence lie between ``front`` and ``back``, most first."""
    out: dict[str, list[int]] = {}
    at = 0
    for i in range(0, len(spans), 10):
        end = at + int(spans[i:i + 2], 16)
        if (inside := min(end, back) - max(at, front)) > 0:
            out.setdefault(spans[i:i + 10], []).append(inside)
        at = end
    for found in out.values():
        found.sort(reverse=True)
    return out


def likeness(a: str, b: str) -> float:
    """Share of the longer text that the common prefix, the common suffix and the common spans between cover, from two fingerprints."""
    if a == b:
        return 1.0
    (na, _, pa_, sa, ia), (nb, _, pb, sb, ib) = a.split(":"), b.split(":")
    m, n = sorted((int(na, 16), int(nb, 16)))
    if not m:
        return 0.0
    rungs = ladder(m)

    def agreed(x: str, y: str) -> int:
        low, high = 0, len(rungs)
        while low < high:
            mid = (low + high + 1) // 2
            if x[8 * (mid - 1):8 * mid] == y[8 * (mid - 1):8 * mid]:
                low = mid
            else:
                high = mid - 1
        return int(rungs[low - 1]) if low else 0
    front, back = agreed(pa_, pb), agreed(sa, sb)
    if front + back >= m:
        return m / n
    there = _left(ib, front, int(nb, 16) - back)
    inside = sum(sum(map(min, found, there[k])) for k, found in _left(ia, front, int(na, 16) - back).items() if k in there)
    return (front + back + inside) / n


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt into ranges of descending ``doc_id``, sorted, each range followed by a copy of the next range's first row.

    Adds ``range`` (partition number), ``borrowed`` (true for the copies: one
    row a range, or as many as share that id).  The ids are cut at quantiles; the driver
    sees one number per range.  The text is shuffled once.  A null id counts as
    smaller than any other; equal ids are ordered by descending text.
    """
    parts = parts or shuffle_partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("__key"))
    cuts = ids.agg(F.percentile_approx("__key", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if parts > 1 else []
    # two small searches instead of a walk over all cuts
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<bigint>")
    count = lambda array, k: F.size(F.filter(array, lambda x: x < k))

    def below(k):
        """How many cuts lie below the key."""
        if not groups:
            return F.lit(0)
        coarse = F.greatest(count(longs([g[0] for g in groups]), k), F.lit(1)) - 1
        inside = F.get(F.array(*[longs(g) for g in groups]), coarse)
        return coarse * step + count(inside, k)
    number = (F.lit(len(cuts)) - below(F.col("__key"))).cast("int")
    firsts = {r["range"]: r["top"] for r in ids.select("__key", number.alias("range")).groupBy("range").agg(F.max("__key").alias("top")).collect()}
    order = sorted(firsts)
    if not order:
        return docs.limit(0).withColumns({"__key": key, "range": F.lit(0), "borrowed": F.lit(False)})
    lends = {order[i]: (order[i - 1], firsts[order[i]]) for i in range(len(order))}  # the first range lends to the last
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("borrowed"))
    slots = max(order) + 1
    to = F.get(F.array(*[F.lit(lends.get(r, (0, 0))[0]) for r in range(slots)]), F.col("range"))
    top = F.get(longs([lends.get(r, (0, 0))[1] for r in range(slots)]), F.col("range"))
    lent = F.struct(to.alias("range"), F.lit(True).alias("borrowed"))
    rows = docs.withColumn("__key", key).withColumn("range", number)
    rows = rows.withColumn("__to", F.explode(F.when(F.col("__key") == top, F.array(own, lent)).otherwise(F.array(own))))
    rows = rows.withColumns({"range": F.col("__to.range"), "borrowed": F.col("__to.borrowed")}).drop("__to")
    return (rows.repartitionById(max(parts, slots), F.col("range"))
            .sortWithinPartitions("range", "borrowed", F.desc("__key"), F.col("doc_id").isNull(), F.desc("text")))


def fingerprint_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Every document with the fingerprints of its text and of its edited text, and their likenesses.

    ``doc_id``, ``n_chars``, ``edited_text``, ``fingerprint``, ``edited_fingerprint``,
    ``next_id``, ``next_fingerprint``, ``near_edited``, ``near_next``.  The next document is the
    one of the next smaller id; after the smallest comes the largest (a lone document follows itself).
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = in_order(slim, parts).select("doc_id", "text", "range", "borrowed")
    text, real, long = T.StringType(), T.DoubleType(), T.LongType()
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("doc_id", long), ("n_chars", long), ("edited_text", text), ("fingerprint", text), ("edited_fingerprint", text),
        ("next_id", long), ("next_fingerprint", text), ("near_edited", real), ("near_next", real))])
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("next_id", pa.int64()), ("next_fingerprint", pa.string()),
                       ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        held, out, size = None, [], 0
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in ("doc_id", "range", "borrowed", "text"))
            for doc_id, place, borrowed, body in zip(*columns):
                mark = None
                if held and held[1] == place and not held[2]:
                    mark = fingerprint(body)
                    new = edited(held[3], body)
                    new_mark = fingerprint(new)
                    out.append((held[0], len(held[3]), new, held[4], new_mark, doc_id, mark,
                                likeness(held[4], new_mark), likeness(held[4], mark)))
                    size += len(new)
                if not borrowed:
                    held = (doc_id, place, False, body, mark or fingerprint(body))
                else:
                    held = (doc_id, place, True, "", "")
                if size > 4_000_000 or len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
    return rows.mapInArrow(run, schema)

