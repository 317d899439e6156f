"""Language identification by a linear-chain conditional random field over words.

A text is a chain of words (runs of letters, lowered); each word carries a
language label, so text that switches between languages is labelled piece by
piece.  A word's score for a language sums weights of its features: its affixes
(character n-grams of 2 to 4 that touch a word border), its inner n-grams of 1 to 4, and
the word itself (the lexicon), all hashed into one table.  Learned transition
weights couple neighbours.  Forward-backward gives every word's posterior; a
text's language is the one with the largest mean posterior over its words, and
that mean is the score.

The chains of many texts are computed together: each chain is cut into blocks,
blocks are multiplied out side by side, their products are carried along the
chain, and the blocks are then filled in.  Matrix products are associative, so the
result is that of the plain recursion, for chains of any length.

Training is gradient ascent on the likelihood over a bounded sample: at most
about ``per_label`` different texts for each label, chosen by a hash of the text, and of each a
window of at most ``window`` words at a hashed place.  Half of the training chains join pieces of
different languages, from which the transitions are learned.  The sample, a few
MB, is the only text that reaches the driver.

Results
-------
A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing
was learned.  Rows with a null label are not learned from.  Repeated rows get equal
results, ties go to the first label in order.  Only the key columns are passed on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import pretokens
from riskframe.llm.common import carried, chunks

UNKNOWN = "und"
#: log2 of the feature table's rows.
BITS = 18
ORDERS = 4
#: Characters whose chains are computed together.
CHARS = 500_000
_WEIGHTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_MIX = np.uint32(0x7FEB352D)


def _slots(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _MIX
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words, each word after a 0; where each word's 0 is; how many words each text has."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le"), dtype="<u4")
    letter = pretokens.classes()[points] == pretokens.LETTER
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    lengths = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
    per_text = np.add.reduceat(first, np.cumsum(lengths) - lengths, dtype=np.int64) if len(lowered) else np.zeros(0, np.int64)
    after = np.zeros(len(points), dtype=bool)
    after[1:] = letter[:-1] & ~letter[1:]
    z = np.concatenate((np.zeros(1, np.uint32), np.where(letter, points, 0)[letter | after].astype(np.uint32)))
    return z, np.flatnonzero(z == 0)[:-1], per_text


def feature_slots(z: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each n-gram order the slot of the n-gram at every place (0: none), and the slot of every word."""
    out, n = [], len(z)
    h = np.zeros(n, dtype=np.uint32)
    inner = np.ones(n, dtype=bool)  # no border strictly inside the n-gram
    for k in range(ORDERS):
        h = h[:n - k] + z[k:] * _WEIGHTS[k]
        if k == 0:
            valid = z != 0
        else:
            if k > 1:
                inner = inner[:n - k] & (z[k - 1:n - 1] != 0)
            else:
                inner = inner[:n - k]
            valid = inner
        slot = np.zeros(n, dtype=np.int32)
        slot[:n - k] = np.where(valid, _slots(h + np.uint32(k * 77)), 0)
        out.append(slot)
    place = np.arange(n, dtype=np.uint32) - np.repeat(starts, np.diff([*starts, n])).astype(np.uint32)
    mixed = (z * np.uint32(0x9E3779B1) ^ (z >> np.uint32(7))) * (place * np.uint32(0x846CA68B) | np.uint32(1))
    out.append(_slots(np.add.reduceat(mixed, starts, dtype=np.uint32)) if len(starts) else np.zeros(0, np.int32))
    return out


def scores(z: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each word's score for each label; row 0 of the table is zero."""
    if not len(starts):
        return np.zeros((0, table.shape[1]), np.float32)
    *grams, lexicon = feature_slots(z, starts)
    total = table[grams[0]]
    for slot in grams[1:]:
        total += table[slot]
    return np.add.reduceat(total, starts, axis=0) + table[lexicon]


def forward_backward(score: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages (scaled) and emissions of every word, of chains of ``counts`` words each.

    The label before a chain's first word is free: every label weighs the same.
    """
    total, k = score.shape
    emit = np.exp((score - score.max(axis=1, keepdims=True)).astype(np.float64)) + 1e-30
    move = np.exp(transition - transition.max())
    counts = counts[counts > 0]
    size = max(4, int(np.sqrt(counts.max())))
    blocks = -(-counts // size)
    chain = np.repeat(np.arange(len(counts)), blocks)
    number = np.arange(len(chain)) - (np.cumsum(blocks) - blocks)[chain]
    first = (np.cumsum(counts) - counts)[chain] + number * size
    length = np.minimum(size, counts[chain] - number * size)
    real = np.arange(size)[None, :] < length[:, None]
    where = np.minimum(first[:, None] + np.arange(size)[None, :], total - 1)

    # the product of each block's steps, all blocks side by side
    product = np.tile(np.eye(k), (len(chain), 1, 1))
    for t in range(size):
        on = np.flatnonzero(real[:, t])
        step = (product[on].reshape(-1, k) @ move).reshape(-1, k, k) * emit[where[on, t]][:, None, :]
        product[on] = step / step.max(axis=(1, 2), keepdims=True)

    # the messages that enter each block, carried along the chains
    left, right = np.full((len(chain), k), 1.0 / k), np.full((len(chain), k), 1.0 / k)
    for b in range(int(blocks.max()) - 1):
        here = np.flatnonzero((number == b) & (b + 1 < blocks[chain]))
        v = np.einsum("ni,nij->nj", left[here], product[here])
        left[here + 1] = v / v.sum(axis=1, keepdims=True)
    for b in range(int(blocks.max()) - 1, 0, -1):
        here = np.flatnonzero(number == b)
        v = np.einsum("nij,nj->ni", product[here], right[here])
        right[here - 1] = v / v.sum(axis=1, keepdims=True)

    # the words inside the blocks
    alpha, beta = np.empty((total, k)), np.empty((total, k))
    for t in range(size):
        on = np.flatnonzero(real[:, t])
        word = where[on, t]
        v = (left[on] @ move) * emit[word]
        left[on] = alpha[word] = v / v.sum(axis=1, keepdims=True)
    for t in range(size - 1, -1, -1):
        on = np.flatnonzero(real[:, t])
        word = where[on, t]
        beta[word] = right[on]
        v = (emit[word] * right[on]) @ move.T
        right[on] = v / v.sum(axis=1, keepdims=True)
    return alpha, beta, emit


def posteriors(score: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Posterior of each word's label."""
    if not len(score):
        return np.zeros(score.shape)
    alpha, beta, _ = forward_backward(score, counts, transition)
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """Labels in order, feature weights (table rows x labels) and transition weights."""

    labels: tuple[str, ...]
    table: np.ndarray
    transition: np.ndarray

    def label(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words of the texts, and how many words each text has."""
        z, starts, counts = words(texts)
        return posteriors(scores(z, starts, self.table), counts, self.transition), counts

    def classify(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        return [f[:2] for f in self.judge(texts)]

    def judge(self, texts: Sequence[str]) -> list[tuple[str, float, float]]:
        """Language, score and certainty (mean of each word's largest posterior, whichever language has it) of each text."""
        if not self.labels:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        found, counts = self.label(texts)
        ends = np.cumsum(counts)
        out = []
        for end, n in zip(ends.tolist(), counts.tolist()):
            if not n:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            own = found[end - n:end]
            mean = own.mean(axis=0)
            best = int(mean.argmax())
            out.append((self.labels[best], min(1.0, float(mean[best])), min(1.0, float(own.max(axis=1).mean()))))
        return out


def chains(samples: dict[str, list[str]], length: int, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Training chains of ``length`` words, as texts, with each word's label number.

    Half come from one label, half join two or three pieces of different labels.
    """
    labels = sorted(samples)
    total = sum(map(len, samples.values()))
    at = dict.fromkeys(labels, 0)
    texts, gold = [], []
    for i in range(max(1, -(-total // length))):
        pieces = 1 if i % 2 == 0 or len(labels) < 2 else int(rng.integers(2, 4))
        cuts = [0, *sorted(rng.integers(1, length, size=pieces - 1).tolist()), length]
        line, kinds, last = [], [], None
        for a, b in zip(cuts, cuts[1:]):
            pick = last
            while pick == last:
                pick = labels[int(rng.integers(len(labels)))]
                if len(labels) == 1:
                    break
            own = samples[pick]
            line += [own[(at[pick] + j) % len(own)] for j in range(b - a)]
            at[pick] += b - a
            kinds += [labels.index(pick)] * (b - a)
            last = pick
        texts.append(" ".join(line))
        gold.append(kinds)
    return texts, np.array(gold).reshape(-1)


def train(samples: dict[str, list[str]], length: int = 60, rounds: int = 20, rate: float = 0.4, decay: float = 1e-4, seed: int = 0) -> Model:
    """Fit feature and transition weights on words per label, by AdaGrad on the chains' log-likelihood."""
    samples = {k: v for k, v in samples.items() if v}
    labels = tuple(sorted(samples))
    k = len(labels)
    table, transition = np.zeros((1 << BITS, max(1, k)), dtype=np.float32), np.zeros((max(1, k), max(1, k)))
    if k < 2:
        return Model(labels, table, transition)
    texts, gold = chains(samples, length, np.random.default_rng(seed))
    z, starts, counts = words(texts)
    *grams, lexicon = feature_slots(z, starts)
    word_of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(z)]))
    slots = np.concatenate([*(g[g > 0] for g in grams), lexicon])
    owner = np.concatenate([*(word_of[g > 0] for g in grams), np.arange(len(starts))])
    used, compact = np.unique(slots, return_inverse=True)
    weights, squares = np.zeros((len(used), k)), np.full((len(used), k), 1e-8)
    move_squares = np.full((k, k), 1e-8)
    truth = np.eye(k)[gold]
    follows = np.ones(len(gold), dtype=bool)
    follows[np.cumsum(counts) - counts] = False
    after = np.flatnonzero(follows)
    seen = np.einsum("ni,nj->ij", truth[after - 1], truth[after])
    for _ in range(rounds):
        score = np.stack([np.bincount(owner, weights=weights[compact, j], minlength=len(starts)) for j in range(k)], axis=1)
        alpha, beta, emit = forward_backward(score, counts, transition)
        both = alpha * beta
        error = truth - both / both.sum(axis=1, keepdims=True)
        gradient = np.stack([np.bincount(compact, weights=error[owner, j], minlength=len(used)) for j in range(k)], axis=1) - decay * weights
        squares += gradient ** 2
        weights += rate * gradient / np.sqrt(squares)
        pair = alpha[after - 1][:, :, None] * np.exp(transition - transition.max())[None] * (emit[after] * beta[after])[:, None, :]
        turn = seen - (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        move_squares += turn ** 2
        transition = transition + rate * turn / np.sqrt(move_squares)
    table[used] = weights
    table[0] = 0
    return Model(labels, table, transition)


def sample(docs: DataFrame, learn: Column, per_label: int, window: int, text: str = "text", label: str = "lang") -> dict[str, list[str]]:
    """Lowered words per label of about ``per_label`` rows of each label for which ``learn`` holds."""
    rows = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("string")).count().collect()}
    if not sizes:
        return {}
    span = 1 << 30
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(span, span * per_label // n + 1))]),
                        F.col(label).cast("string"))
    h = F.xxhash64(F.col(text), F.lit(17))
    picked = (rows.where(F.pmod(h, F.lit(span)) < rate)
              .select(F.col(label).cast("string").alias("label"), h.alias("h"), F.split(F.col(text), r"\s+").alias("parts"))
              .select("label", "h", F.slice("parts", (F.pmod(F.shiftright("h", 7), F.greatest(F.size("parts") - window, F.lit(0)) + 1) + 1).cast("int"),
                                            window).alias("parts")).distinct())
    out: dict[str, list[str]] = {k: [] for k in sizes}
    for r in sorted(picked.collect()):
        z, starts, _ = words([" ".join(r["parts"])])
        line = z.tobytes().decode("utf-32-le").split("\0")
        out[r["label"]] += [w for w in line if w]
    return out


def fit(docs: DataFrame, learn: Column, per_label: int = 200, window: int = 120, text: str = "text", label: str = "lang") -> Model:
    """A model of the rows for which ``learn`` holds, from a sample bounded by ``per_label`` and ``window``."""
    return train(sample(docs, learn, per_label, window, text, label))


def predict(docs: DataFrame, model: Model, text: str = "text", keys: Sequence[str] = ("doc_id",), runs: bool = False,
            certainty: bool = False) -> DataFrame:
    """``keys``, ``lang_pred`` and ``score`` of every row; with ``certainty`` also the mean of the words' largest posteriors,
    with ``runs`` also the runs of words with one label."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS x labels numbers, whatever the input's size
    slim, column = carried(docs, keys, text)
    fields = [*(slim.schema[k] for k in keys), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if certainty:
        fields.append(T.StructField("certainty", T.DoubleType()))
    if runs:
        fields.append(T.StructField("runs", T.ArrayType(T.StructType([
            T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType())]))))
    schema, names = T.StructType(fields), list(keys)
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        own: Model = sent.value
        for batch in batches:
            for part, texts in chunks(batch, column, CHARS):
                found = own.judge(texts)
                columns = [*(part.column(c) for c in names), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                if certainty:
                    columns.append(pa.array([f[2] for f in found], pa.float64()))
                if runs:
                    columns.append(pa.array([label_runs(own, t) for t in texts], run_type))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return slim.mapInArrow(run, schema)


def label_runs(model: Model, text: str) -> list[dict]:
    """Runs of words with the same most probable label."""
    if not model.labels:
        return []
    found, _ = model.label([text])
    best = found.argmax(axis=1)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(best)), bool), best[1:] != best[:-1])))
    return [{"lang": model.labels[best[a]], "first_word": a, "words": b - a} for a, b in zip(first.tolist(), [*first[1:].tolist(), len(best)])]
