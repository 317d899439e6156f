"""Phrases (collocations) by FM-indexes over word ids.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and
pieces into words at blanks.  Documents are dealt into shards, blocks of some
megabytes of text inside the reading task.  A shard is a sequence of word ids with
0 between pieces; its index is the Burrows-Wheeler transform of the sequence
(suffixes are ordered by as many words as the longest phrase has, which is all
that intervals of that depth need) and the transform of the reversed sequence.

An interval of the index is a phrase, its width the phrase's count.  ``Index.extend``
takes all intervals of one depth at once and gives their extensions by one word on
the left (forward index) or on the right (index of the reversed sequence), with
counts.  Counts of shards are summed on Spark, level by level:

* words: those with ``least`` occurrences get numbers, which go back to the shards;
* pairs of such words: left extensions of all one-word intervals.  Each shard sends a
  pair once, so no pair has more rows than there are shards; frequent ones go back;
* triples: left extensions of frequent pairs that are also right extensions of
  frequent pairs (a triple is frequent only if both of its pairs are).

No count is cut off before the sum over all shards.  Scores are exact: products are
decimals of 38 digits.  Each language's first rows are chosen in two steps, in every
task and then over what remains.

Results
-------
``collocations``: the rows named in it.  A null text has no words, a null language is
``und``, a text without words adds nothing; repeated rows count each time; columns
other than the text and the language are not read, so extra ones cannot clash.  An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import chunks, spread_join, stored

#: Characters of a shard's texts.
SHARD = 8_000_000
#: Least occurrences of a candidate; share (percent) of a phrase's occurrences in a longer one that drops it; rows per language.
LEAST, WITHIN, TOP = 10, 50, 2_000
#: Language of documents without one.
UNKNOWN = "und"

_KIND = np.zeros(256, dtype=np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[32, 9]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts in order, whether each begins a piece, and how many words each text has."""
    sizes = np.array([len(t.encode()) + 1 for t in texts], dtype=np.int64)
    data = _LOWER[np.frombuffer(("\n".join(texts) + "\n").encode(), dtype=np.uint8)]
    kind = _KIND[data]
    inside = kind == 0
    edges = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    seps = np.flatnonzero(kind == 2)
    begins = np.ones(len(starts), dtype=bool)
    begins[1:] = np.searchsorted(seps, starts[1:]) > np.searchsorted(seps, ends[:-1])
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, begins, np.diff(np.searchsorted(starts, np.append(0, np.cumsum(sizes))))


def pack(ids: np.ndarray) -> bytes:
    """Numbers below 2^32, small."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Index:
    """Burrows-Wheeler transform of a sequence of small numbers (0 separates), for phrases of up to ``depth``."""

    def __init__(self, sequence: np.ndarray, depth: int):
        sequence = np.append(sequence, 0)  # the end, which also comes before the first symbol
        n = len(sequence)
        padded = np.append(sequence, np.zeros(depth, dtype=sequence.dtype))
        columns = [padded[k:k + n] for k in range(depth)]
        bits = int(sequence.max(initial=0)).bit_length()
        if bits * depth < 63:
            key = columns[0].astype(np.int64)
            for c in columns[1:]:
                key = key << bits | c
            order = np.argsort(key, kind="stable")
        else:
            order = np.lexsort(columns[::-1])
        #: First symbol of each row's suffix, and the symbol before it.
        self.first = sequence[order]
        self.before = np.roll(sequence, 1)[order]
        #: The rows ordered by the symbol before them: place r there is row r of the suffix one symbol longer.
        self.longer = np.argsort(self.before, kind="stable")

    def extend(self, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Extensions of all intervals by the symbol before them.

        ``interval`` has the number of each row's interval, -1 for none.  Gives the symbol, the extended interval and the
        count of each extension, and the rows' numbers of extensions.
        """
        symbol, parent = self.before[self.longer], interval[self.longer]
        rows = np.flatnonzero((symbol > 0) & (parent >= 0))
        symbol, parent = symbol[rows], parent[rows]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (parent[1:] != parent[:-1])
        out = np.full(len(interval), -1, dtype=np.int64)
        out[rows] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        return symbol[at], parent[at], np.diff(np.append(at, len(rows))), out

    def words(self) -> np.ndarray:
        """The rows' intervals of depth one, numbered by their word (-1: separator)."""
        return np.where(self.first > 0, self.first, -1)


class Shard:
    """Both indexes of a shard; ``sequence`` holds word numbers, 0 between pieces and in place of rare words."""

    def __init__(self, sequence: np.ndarray, depth: int):
        self.names, local = np.unique(np.append(0, sequence), return_inverse=True)  # 0 stays 0
        self.sequence, self.depth = local[1:].astype(np.int64), depth

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of neighbouring words (left number << 32 | right number) and its count."""
        index = Index(self.sequence, 2)
        left, right, count, _ = index.extend(index.words())
        return self.names[left] << 32 | self.names[right], count

    def triples(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Triples of which both pairs are frequent: the first pair, the third word, the count."""
        found = []
        for sequence in (self.sequence, self.sequence[::-1]):
            index = Index(sequence, 3)
            outer, inner, _, rows = index.extend(index.words())
            pair = (outer, inner) if sequence is self.sequence else (inner, outer)  # the reversed sequence extends on the right
            kept = np.isin(self.names[pair[0]] << 32 | self.names[pair[1]], frequent)
            symbol, parent, count, _ = index.extend(np.where(np.append(kept, False)[rows], rows, -1))  # -1: no interval
            three = (symbol, outer[parent], inner[parent])
            found.append((*(three if sequence is self.sequence else three[::-1]), count))
        (a, b, c, count), right = found
        k = len(self.names)
        code = lambda x, y, z: (x * k + y) * k + z if k < 1 << 20 else np.array([f"{i} {j} {m}" for i, j, m in zip(x, y, z)])
        both = np.isin(code(a, b, c), code(*right[:3]))
        return (self.names[a] << 32 | self.names[b])[both], self.names[c][both], count[both]


def shards(docs: DataFrame, text: str, lang: str, size: int = SHARD) -> DataFrame:
    """A row per shard: ``shard``, its distinct (language, word) with counts, and ``seq``, their places + 1 with 0 between pieces."""
    slim = docs.select(F.col(f"`{text}`").cast("string").alias("__text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("__lang"))

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in chunks(batch, "__text", size):
                words, begins, per_text = words_of(texts)
                if not len(words):
                    continue
                langs = part.column("__lang").dictionary_encode()
                coded = words.dictionary_encode()
                k = len(coded.dictionary)
                symbol = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), per_text) * k + coded.indices.to_numpy(zero_copy_only=False)
                names, place, counts = np.unique(symbol, return_inverse=True, return_counts=True)
                at = np.arange(len(place)) + np.cumsum(begins)
                seq = np.zeros(at[-1] + 1, dtype=np.int64)
                seq[at] = place + 1
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), one(langs.dictionary.take(pa.array(names // k))),
                    one(coded.dictionary.take(pa.array(names % k)).cast(pa.string())), one(pa.array(counts)), pa.array([pack(seq)], pa.binary())],
                    names=["shard", "langs", "words", "counts", "seq"])
                number += 1
    return slim.mapInArrow(run, "shard long, langs array<string>, words array<string>, counts array<long>, seq binary")


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Stored rows with dense numbers from 1, by offsets of their partitions (a table bounded by the number of partitions), and their number."""
    placed = stored(rows.withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__id", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n")).orderBy("__part").collect()
    total = sum(r["__n"] for r in sizes)
    if total >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    starts, at = [], 1
    for r in sizes:
        starts.append((r["__part"], at))
        at += r["__n"]
    offsets = rows.sparkSession.createDataFrame(starts, "__part long, __from long")
    number = (F.col("__from") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return placed.join(F.broadcast(offsets), "__part").select(*rows.columns, number), total


def _score(a: str, left: Column, right: Column) -> Column:
    wide = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")
    up = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", up.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, within: int = WITHIN,
                 top: int = TOP, shard: int = SHARD) -> DataFrame:
    """Each language's ``top`` phrases of two or three words.

    ``lang``, ``rank`` (from 1), ``phrase``, its count ``a``, the counts ``l`` and ``r`` of its two parts at the lowest-scoring cut,
    the language's number of words ``n``, and ``score`` = floor(10^6 a a / (l r)).  A phrase goes if at least ``within`` percent of
    its occurrences lie in a longer phrase with ``least`` occurrences.
    """
    table = stored(shards(docs, text, lang, shard))
    entries = table.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "e")).select(
        "shard", "place", F.col("e.langs").alias("lang"), F.col("e.words").alias("word"), F.col("e.counts").alias("count"))
    sums = stored(entries.groupBy("lang", "word").agg(F.sum("count").alias("f")))
    per_lang = sums.groupBy("lang").agg(F.sum("f").alias("n"))
    words, _ = numbered(sums.where(F.col("f") >= least), "id")
    words = stored(words)
    back = entries.select("shard", "place", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("of"), "place", "id")

    def renumber(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for number, seq in zip(left["shard"].to_pylist(), left["seq"].to_pylist()):
            seq = unpack(seq)
            name = np.zeros(int(seq.max(initial=0)) + 1, dtype=np.int64)
            name[right["place"].to_numpy() + 1] = right["id"].to_numpy()
            seq = name[seq]
            rows.append((number, pack(seq[(seq > 0) | (np.append(0, seq[:-1]) > 0)])))  # one separator is enough
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "seq": pa.array([r[1] for r in rows], pa.binary())})

    coded = stored(table.select("shard", "seq").groupBy("shard").cogroup(back.groupBy("of")).applyInArrow(renumber, "shard long, seq binary"))

    def pairs_of(batches):
        for batch in batches:
            for number, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pair, count = Shard(unpack(seq), 2).pairs()
                for at in range(0, len(pair), 1 << 16):
                    part = pair[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(part), pa.int64()), pa.array(part),
                                                      pa.array(count[at:at + (1 << 16)].astype(np.int32))], names=["shard", "pair", "count"])

    held = coded.mapInArrow(pairs_of, "shard long, pair long, count int").withColumn("a", F.sum("count").over(Window.partitionBy("pair")))
    held = stored(held.where(F.col("a") >= least).select("shard", "pair", "a"))
    pairs = stored(held.groupBy("pair").agg(F.max("a").alias("a")))

    def triples_of(left: pa.Table, right: pa.Table) -> pa.Table:
        frequent, out = right["pair"].to_numpy(), []
        for seq in left["seq"].to_pylist() if len(frequent) else []:
            out.append(Shard(unpack(seq), 3).triples(frequent))
        first, third, count = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(3))
        return pa.table({"pair": pa.array(first, pa.int64()), "third": pa.array(third, pa.int64()), "count": pa.array(count, pa.int64())})

    found = coded.groupBy("shard").cogroup(held.select("shard", "pair").groupBy("shard")).applyInArrow(triples_of, "pair long, third long, count long")
    second = lambda pair: F.col(pair).bitwiseAND(F.lit((1 << 32) - 1))
    triples = stored(found.groupBy("pair", "third").agg(F.sum("count").alias("a")).where(F.col("a") >= least)
                     .withColumn("rest", F.shiftleft(second("pair"), 32).bitwiseOR(F.col("third"))))

    # the largest longer candidate around each pair
    around = triples.select("pair", "a").unionAll(triples.select(F.col("rest").alias("pair"), "a")).groupBy("pair").agg(F.max("a").alias("longer"))
    kept = pairs.join(around, "pair", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    one = lambda prefix: words.select(F.col("id").alias(prefix), F.col("word").alias(f"{prefix}_word"), F.col("f").alias(f"{prefix}_f"), *(
        ["lang"] if prefix == "w1" else []))
    two = lambda key, name: pairs.select(F.col("pair").alias(key), F.col("a").alias(name))
    counts = (pairs.count(), triples.count())
    w1, w2 = F.shiftright("pair", 32).alias("w1"), second("pair").alias("w2")
    short = kept.select(w1, w2, "a")
    for key, other in (("w1", "w2"), ("w2", "w1")):  # stored: a split join names its left side twice, a chain of them would double the plan each time
        short = stored(spread_join(short, one(key), key, counts[0], [other]))
    short = short.select("lang", F.concat_ws(" ", "w1_word", "w2_word").alias("phrase"), "a",
                         F.array(F.struct(_score("a", F.col("w1_f"), F.col("w2_f")).alias("score"), F.lit(1).alias("k"),
                                          F.col("w1_f").alias("l"), F.col("w2_f").alias("r"))).alias("cuts"))
    long = triples.select(w1, w2, F.col("third").alias("w3"), "pair", "rest", "a")
    for key, other, right in (("w1", "w2", one("w1")), ("w2", "w1", one("w2")), ("w3", "w1", one("w3")),
                              ("pair", "w3", two("pair", "pair_f")), ("rest", "w1", two("rest", "rest_f"))):
        long = stored(spread_join(long, right, key, counts[1], [other]))
    long = long.select("lang", F.concat_ws(" ", "w1_word", "w2_word", "w3_word").alias("phrase"), "a", F.array(
        *(F.struct(_score("a", F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
          for k, x, y in ((1, "w1_f", "rest_f"), (2, "pair_f", "w3_f")))).alias("cuts"))
    rows = short.unionByName(long).withColumn("cut", F.array_min("cuts"))  # the lowest score, then the smallest k
    rows = rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
