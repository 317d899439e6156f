"""Secret scans over a trigram inverted index.

Every rule is a regular expression.  From its parse tree a Boolean query over
trigrams is derived: concatenated literals must all occur (AND), alternatives
may (OR), repeats that may be absent and character classes demand nothing.  The
texts that a task holds form an index segment: one vectorised pass over their
bytes builds the postings (trigram -> texts) of every trigram that some query
names, whatever the number of rules.  A rule's query intersects and unites
postings, and only the texts that remain are verified with the expression
itself.  A rule without a mandatory trigram scans every text.  Letters are
folded to lower case in the index and in the queries, so rules may ignore case.

Segments are local to a task: no shuffle, and memory is bounded by the segment's
characters.

Results
-------
One row per input row.  A null or empty text has no spans.  Spans are in code
points, end exclusive, sorted by start and then by the rule's place in the list;
equal rows get equal results.  Verification is over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import carried, chunks, column_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; one is kept if its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    fold: bool = False


#: What follows a private key's BEGIN: all up to its END, or without one the header lines and the base64 (runs of
#: 16 or more characters, and shorter ones that fill the rest of a line), also quoted or with \\n for line breaks.
_TO_END = r"(?>[^-]+|-(?!----(?:BEGIN|END)\x20))*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
_BREAK = r"""(?>\s|\\[nrt]|[>"',]|\+(?=\s))"""
_LINES = (rf"(?:{_BREAK}*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+"
          r"""|[A-Za-z0-9+/]{16,}+={0,2}|[A-Za-z0-9+/]++={0,2}(?=["',\x20\t]*+(?:[\r\n]|\\[nr]|\Z))))*+""")
#: The three base kinds, then well-known public token formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----" + f"(?:{_TO_END}|{_LINES})"),
)

# A query is True (anything may match), ("tri", bytes), ("and", [...]) or ("or", [...]).
Query = bool | tuple
#: More alternatives than these are not spelled out; the query then asks for less, never for more.
SPELLED = 64


def _and(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _or(parts: list[Query]) -> Query:
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _need(strings: set[str] | None) -> Query:
    """What a text needs that contains one of the strings."""
    if not strings:
        return True
    return _or([_and([("tri", b[i:i + 3]) for i in range(len(b) - 2)]) for b in (s.encode().lower() for s in strings)])


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The exact strings of an expression (None: not spelled out), and what else every match needs."""
    exact: set[str] | None = {""}
    needs: list[Query] = []

    def close() -> None:
        nonlocal exact
        if exact is not None:
            needs.append(_need(exact))
        exact = {""}

    for op, arg in tree:
        if op is ops.LITERAL:
            one: set[str] | None = {chr(arg)}
        elif op is ops.IN and arg[0][0] is not ops.NEGATE and all(k is ops.LITERAL for k, _ in arg) and len(arg) <= 8:
            one = {chr(v) for _, v in arg}
        elif op is ops.SUBPATTERN:
            one, more = _walk(arg[-1])
            needs.append(more)
        elif op is ops.BRANCH:
            found = [_walk(b) for b in arg[1]]
            if all(s is not None and more is True for s, more in found):
                one = set().union(*(s for s, _ in found))
            else:
                one = None
                needs.append(_or([_and([_need(s), more]) for s, more in found]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, inner = arg
            strings, more = _walk(inner)
            if (low, high) == (0, 1) and strings is not None and more is True:
                one = strings | {""}
            else:
                if low:
                    needs.append(_and([_need(strings), more]))
                one = None
        elif op is ops.AT:
            continue
        else:
            one = None
        if one is None:
            close()
        elif len(exact) * len(one) > SPELLED:
            close()
            exact = one if len(one) <= SPELLED else {""}
        else:
            exact = {a + b for a in exact for b in one}
    if any(op not in (ops.LITERAL, ops.IN, ops.BRANCH, ops.SUBPATTERN, ops.MAX_REPEAT) for op, _ in tree) or needs:
        close()
        return None, _and(needs)
    return exact, True


def query(pattern: str) -> Query:
    """Boolean trigram query that every text with a match satisfies (True: no trigram is mandatory)."""
    strings, more = _walk(parser.parse(pattern))
    return _and([_need(strings), more])


def trigrams(q: Query) -> set[bytes]:
    if q is True:
        return set()
    return {q[1]} if q[0] == "tri" else set().union(*map(trigrams, q[1]))


class Index:
    """Postings of one segment of texts, for the trigrams that a set of queries names."""

    def __init__(self, texts: Sequence[str], names: Sequence[bytes], lookup: np.ndarray):
        self.all = np.arange(len(texts))
        self.postings = {t: self.all[:0] for t in names}
        parts = [t.encode().lower() for t in texts]  # bytes.lower folds ASCII letters only
        data = np.frombuffer(b"\0\0".join(parts), dtype=np.uint8).astype(np.int32)
        if len(data) < 3 or not names:
            return
        number = lookup[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(number >= 0)
        ends = np.cumsum([len(p) + 2 for p in parts])
        found = np.unique(number[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        which, text = np.divmod(found, len(texts))
        cuts = np.searchsorted(which, np.arange(len(names) + 1))
        for i, t in enumerate(names):
            self.postings[t] = text[cuts[i]:cuts[i + 1]]

    def candidates(self, q: Query) -> np.ndarray:
        """Numbers of the texts that satisfy the query."""
        if q is True:
            return self.all
        if q[0] == "tri":
            return self.postings[q[1]]
        found = sorted((self.candidates(p) for p in q[1]), key=len)
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if q[0] == "and" else np.union1d(out, more)
        return out


class Scanner:
    """Rules with their queries, compiled once."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
        self.queries = [query(r.pattern) for r in rules]
        self.names = sorted(set().union(*map(trigrams, self.queries)))
        self.lookup = np.full(1 << 24, -1, dtype=np.int16)
        for i, t in enumerate(self.names):
            self.lookup[(t[0] << 16) | (t[1] << 8) | t[2]] = i

    def scan(self, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, rule number) of every kept span of each text, sorted."""
        index = Index(texts, self.names, self.lookup)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, compiled, q) in enumerate(zip(self.rules, self.compiled, self.queries)):
            for i in index.candidates(q).tolist():
                for m in compiled.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), m.end(), k))
        for spans in out:
            spans.sort(key=lambda s: (s[0], s[2]))
        return out


_scanners: dict[tuple, Scanner] = {}


def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    """The scanner of the rules, built once in a worker process (tasks get this function by name)."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keys: Sequence[str] = ("doc_id",),
         redact: bool = False) -> DataFrame:
    """``keys`` and ``spans`` (array of kind, start, end) of every row; with ``redact`` also ``redacted``, the text with
    every span (overlapping ones as one) replaced by ``[REDACTED]``, null where the text is null."""
    rules = tuple(rules)
    slim, column = carried(docs, keys, text)
    fields = [*(slim.schema[k] for k in keys), T.StructField("spans", T.ArrayType(SPAN))]
    if redact:
        fields.append(T.StructField("redacted", T.StringType()))
    schema = T.StructType(fields)
    names = list(keys)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = scanner_of(rules)
        for batch in batches:
            for part, texts in chunks(batch, column):
                found = scanner.scan(texts)
                columns = [*(part.column(k) for k in names),
                           pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in spans] for spans in found], span_type)]
                if redact:
                    empty = column_of(part, column).is_null().to_pylist()
                    columns.append(pa.array([None if e else covered(t, s) for e, t, s in zip(empty, texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return slim.mapInArrow(run, schema)


def covered(text: str, spans: Sequence[tuple[int, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with every maximal run of overlapping spans replaced by the mark."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end = spans[k][:2]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]]) if out else text


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_kinds(rules: Sequence[Rule] = RULES) -> list[str]:
    return [r.kind for r in rules if r.base]
