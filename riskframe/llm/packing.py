"""Packing by power-of-two decomposition.

Every document's ids, closed by the separator id, are cut into pieces whose
lengths are powers of two: as many of ``max_length`` as fit, then the binary
digits of the rest from high to low.  A piece is a sequence of its own, so no
sequence crosses documents and none needs padding; sequences of equal length
form a bucket (column ``length``), from which batches of equal shape are drawn
(``write_buckets`` lays a folder per bucket).

There is no shuffle: the cut is made where the document is read.  Sequence ids
are the task's number times 2^33 plus a count inside the task, unique in one
result and the same when a lost task runs again on the same input split; inside
each chunk of some megabytes of text sequences of equal length are numbered side
by side.  The ids are those of the tokenizers library with the given file at its
defaults: the file's added tokens are matched in texts.

Results
-------
One row per piece.  A null or empty text is one document of the separator only
(one piece of length 1).  Repeated rows and repeated or null keys are documents
of their own.  Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.bpe import CHUNK, vocabulary
from riskframe.llm.common import chunks


def pieces_of(totals: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece of documents with ``totals`` ids; ``max_length`` is a power of two.

    As many of ``max_length`` as fit, then the binary digits of the rest from high to low.
    """
    full = totals // max_length
    which = [np.repeat(np.arange(len(totals)), full)]
    starts = [(np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)) * max_length]
    lengths = [np.full(full.sum(), max_length, dtype=np.int64)]
    at = full * max_length
    for digit in range(max_length.bit_length() - 2, -1, -1):
        has = np.flatnonzero(totals - full * max_length >> digit & 1)
        which.append(has)
        starts.append(at[has])
        lengths.append(np.full(len(has), 1 << digit, dtype=np.int64))
        at[has] += 1 << digit
    return np.concatenate(which), np.concatenate(starts), np.concatenate(lengths)


def pack(docs: DataFrame, path: str, text: str = "text", keys: Sequence[str] = ("doc_id",),
         max_length: int = 1024, separator: int = 0) -> DataFrame:
    """``keys``, ``start``, ``length``, ``ids`` (little-endian 32-bit, packed binary), ``doc_tokens``, ``sequence_id``, ``offset``."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    get = vocabulary(docs.sparkSession, path)
    slim = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType([*slim.schema.fields[:-1], long("start"), long("length"), T.StructField("ids", T.BinaryType()),
                           long("doc_tokens"), long("sequence_id"), long("offset")])
    names = list(keys)

    def run(batches):
        vocab, number = get(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in chunks(batch, "__text", CHUNK):
                ids, counts = vocab.encode_flat(texts)
                totals = counts + 1
                data = np.full(totals.sum(), separator, dtype="<i4")
                data[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), counts)] = ids
                which, starts, lengths = pieces_of(totals, max_length)
                order = np.argsort(-lengths, kind="stable")  # one bucket of equal lengths after the other
                which, starts, lengths = which[order], starts[order], lengths[order]
                begins = (np.cumsum(totals) - totals)[which] + starts
                ends = np.cumsum(lengths)
                gather = np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1])
                packed = pa.Array.from_buffers(pa.binary(), len(which), [
                    None, pa.py_buffer((4 * np.append(0, ends)).astype(np.int32)), pa.py_buffer(data[gather])])
                n = len(which)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(pa.array(which)) for k in names), pa.array(starts), pa.array(lengths), packed,
                     pa.array(totals[which]), pa.array(np.arange(number, number + n)), pa.array(np.zeros(n, np.int64))],
                    names=schema.names)
                number += n
    return slim.mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences with one folder per length, ready to be read bucket by bucket."""
    pieces.write.mode("overwrite").partitionBy("length").parquet(path)
