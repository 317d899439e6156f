"""Quality rules by weak supervision, in DataFrame expressions only.

A base of counted rules rejects outright.  Beyond it, rules vote for quality (+1),
against it (-1) or abstain (0), and expectation-maximisation estimates, without
labels, how often each rule that votes is right on good and on bad texts, and the
share of good texts.  A text is kept if its posterior probability of quality,
given all its votes, is at least one half; no single rule decides.

Everything about a text is computed in its row by built-in functions, so there is
no shuffle but the count of vote patterns (at most 3 to the number of rules rows,
summed map-side), and a text of any length is one row.  Expectation-maximisation
runs over those counts, which stand for all rows; its result is a few numbers
that enter the verdict as literals.

Repeated windows of five words are found inside the row: windows are hashed (64
bits, over their words) and sorted with their places; equal neighbours are
repeated; their places, sorted again, give the covered words.

Results
-------
Null and empty texts have zero counts and fail the base.  Repeated rows get equal
results.  An empty table gives no rows.  The columns to keep travel in a struct,
so their names cannot clash with the counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import columns

#: The base's symbols, white space, capitals, and frequent function words of four languages.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "der", "die", "und", "das", "nicht", "ein", "eine",
                  "mit", "le", "la", "les", "des", "et", "que", "est", "un", "une", "dans", "el", "los", "las", "y", "por", "con", "de", "en")
#: Characters that end a line of prose.
ENDS = (".", "!", "?", ":", ";", "…")


@dataclass(frozen=True)
class Vote:
    """-1 where ``bad`` holds, else +1 where ``good`` holds, else 0 (SQL over the counts)."""

    name: str
    bad: str
    good: str


VOTES = (
    Vote("symbols", "n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    Vote("symbol_share", "n_symbols > 0.05 * word_chars", "n_symbols < 0.005 * word_chars"),
    Vote("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    Vote("windows", "n_repeat_words > 0.15 * n_words", "n_repeat_words < 0.03 * n_words"),
    Vote("capitals", "n_upper > 0.3 * word_chars", "n_upper < 0.08 * word_chars"),
    Vote("endings", "n_ended < 0.3 * n_lines", "n_ended >= 0.8 * n_lines"),
    Vote("emphasis", "n_emphasis > 0.1 * n_words", "false"),
    Vote("marks", "n_marks > 0.15 * n_words", "n_marks < 0.03 * n_words"),
    Vote("word_length", "word_chars < 3 * n_words or word_chars > 9 * n_words", "word_chars between 3.5 * n_words and 8 * n_words"),
    Vote("length", "n_words < 12", "n_words >= 50"),
    Vote("function_words", "n_function = 0 and n_words >= 20", "n_function >= 2"),
)
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def counts(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``row`` (a struct of the columns to keep) and ``q`` (a struct of the counts) of every row."""
    plain = F.translate("t", SPACES, " " * len(SPACES))
    trimmed = F.trim(plain)
    removed = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    long = lambda **c: F.struct(*[v.cast("long").alias(k) for k, v in c.items()])
    step = docs.select(F.struct(*columns(keep)).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    step = step.select(
        "row",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " +")).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.trim(F.translate(x, SPACES, " " * len(SPACES))) != "").alias("lines"),
        long(word_chars=F.length(F.replace(plain, F.lit(" "), F.lit(""))), n_symbols=removed(SYMBOLS), n_upper=removed(UPPER),
             n_emphasis=(F.length("t") - F.length(F.replace("t", F.lit("!!"), F.lit("")))) / 2).alias("of_text"))
    ended = F.filter("lines", lambda x: F.right(F.rtrim(F.translate(x, SPACES, " " * len(SPACES))), F.lit(1)).isin(*ENDS))
    marks = F.filter("words", lambda w: (F.length(w) <= 3) & (F.upper(w) == F.lower(w)) & (w < "0"))
    step = step.select(
        "row", "of_text",
        long(n_words=F.size("words"), n_marks=F.size(marks),
             n_function=F.size(F.array_intersect("words", F.array(*map(F.lit, FUNCTION_WORDS)))),
             n_lines=F.size("lines"), n_dup_lines=F.size("lines") - F.size(F.array_distinct("lines")), n_ended=F.size(ended)).alias("of_words"),
        F.expr("""case when size(words) < 5 then cast(array() as array<struct<h: bigint, i: int>>)
                  else sort_array(transform(sequence(0, size(words) - 5), i -> struct(
                      xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) as h, i as i))) end""").alias("windows"))
    step = step.select("row", "of_text", "of_words", F.expr("""sort_array(transform(filter(windows, (w, k) ->
        (k > 0 and w.h = windows[k - 1].h) or (k + 1 < size(windows) and w.h = windows[k + 1].h)), w -> w.i))""").alias("starts"))
    covered = F.expr("aggregate(starts, struct(-5 as last, 0L as n), (a, s) -> struct(s as last, a.n + least(5, s - a.last) as n), a -> a.n)")
    # a generator: filters on the counts stay above it, instead of repeating their expressions below
    return step.select("row", F.explode(F.array(F.struct("of_words.*", "of_text.*", covered.alias("n_repeat_words")))).alias("q"))


def base_failed() -> Column:
    """Whether the base rejects, over a column ``q``."""
    return F.expr(_over(BASE))


def votes() -> list[Column]:
    """The rules' votes over a column ``q``."""
    return [F.expr(f"case when {_over(v.bad)} then -1 when {_over(v.good)} then 1 else 0 end").alias(v.name) for v in VOTES]


def _over(condition: str) -> str:
    words = condition.replace("(", "( ").replace(")", " )").split()
    return " ".join(f"q.{w}" if w.startswith(("n_", "word_chars")) else w for w in words)


@dataclass(frozen=True)
class Model:
    """Share of good texts; for each rule, how often it is right when it votes, on good and on bad texts."""

    good: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log-odds that a rule's vote for and against quality adds."""
        return [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in zip(self.right_on_good, self.right_on_bad)]

    def log_odds(self) -> Column:
        """Posterior log-odds of quality, over a column ``q``."""
        total = F.lit(math.log(self.good / (1 - self.good)))
        for vote, (up, down) in zip(votes(), self.weights()):
            total = total + F.when(vote == 1, F.lit(up)).when(vote == -1, F.lit(down)).otherwise(F.lit(0.0))
        return total


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 60) -> Model:
    """Expectation-maximisation over counted vote patterns.

    Starts from the votes' balance, in which a vote against counts double; pseudo-counts keep every
    estimate inside its range, in which a rule is right more often than not on good texts.
    """
    n_rules = len(VOTES)
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    posterior = [1 / (1 + math.exp(-sum(2 * v if v < 0 else v for v in p) / 2)) for p, _ in patterns]
    model = Model(0.8, (0.9,) * n_rules, (0.5,) * n_rules)
    weight = max(2.0, 0.002 * total)
    for _ in range(rounds):
        share = (sum(q * n for q, (_, n) in zip(posterior, patterns)) + 4) / (total + 5)
        on_good, on_bad = [], []
        for j in range(n_rules):
            up_good = sum(q * n for q, (p, n) in zip(posterior, patterns) if p[j] > 0)
            down_good = sum(q * n for q, (p, n) in zip(posterior, patterns) if p[j] < 0)
            up_bad = sum((1 - q) * n for q, (p, n) in zip(posterior, patterns) if p[j] > 0)
            down_bad = sum((1 - q) * n for q, (p, n) in zip(posterior, patterns) if p[j] < 0)
            on_good.append(min(0.995, max(0.55, (up_good + 0.9 * weight) / (up_good + down_good + weight))))
            on_bad.append(min(0.95, max(0.01, (down_bad + 0.3 * weight) / (up_bad + down_bad + weight))))
        model = Model(min(0.98, max(0.3, share)), tuple(on_good), tuple(on_bad))
        gains, prior = model.weights(), math.log(model.good / (1 - model.good))
        posterior = [1 / (1 + math.exp(-max(-500.0, prior + sum(up if v > 0 else down if v < 0 else 0.0 for v, (up, down) in zip(p, gains)))))
                     for p, _ in patterns]
    return model


def fit(counted: DataFrame) -> Model:
    """The model of all rows of ``counts`` that pass the base."""
    found = counted.where(~base_failed()).select(*votes()).groupBy(*[v.name for v in VOTES]).count().collect()
    return estimate([(tuple(r[:-1]), r[-1]) for r in found])


def kept(model: Model) -> Column:
    """The verdict over a column ``q``."""
    return ~base_failed() & (model.log_odds() >= 0)
