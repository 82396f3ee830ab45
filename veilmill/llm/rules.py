"""Quality rules as a short-circuit cascade.

Every text gets the base counts.  Texts that pass the base rules go through further rules, which stop at
the first that rejects.  ``plan`` runs all rules on a sample of about ``SAMPLE_ROWS`` rows (those whose
hash lies below a threshold that the row count gives), takes the seconds each one needs and the share
it rejects, and orders them by rejections per second.  The sample is measured where it lies: no task
gathers it.  The order changes the work, never the verdict: a text is kept if no rule rejects it.

Defined results: a null or empty text has zero counts and fails the base rules.  Repeated rows give equal
results.  Windows of words are compared exactly, through ranks of pairs, however long the text is.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmill.llm.common import drawn, text_udf

WINDOW = 8  #: words of a window whose repetition counts
SAMPLE_ROWS = 400  #: rows on which costs and selectivities are estimated
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in some window of ``window`` (a power of two) words found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ranks = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    width = 1
    while width < window:
        pairs = ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(ranks)[ranks] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


class Counts:
    """Counts of one text; those that only some rules need are made when asked for."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "replace")
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self.word_chars = sum(map(len, self.words)) - self.in_raw(bytes(range(128, 192)))
        self.n_symbols = self.in_raw(_SYMBOLS)
        lines = [x for x in self.raw.split(b"\n") if x.split()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(self.words)

    def in_raw(self, members: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, members))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


#: A rule is true where it rejects.
RULES: dict[str, Callable[[Counts], bool]] = {
    "symbols": lambda c: 100 * c.n_symbols > 5 * c.word_chars,
    "repeated lines": lambda c: c.n_dup_lines > 3 and 2 * c.n_dup_lines > c.n_lines,
    "capitals": lambda c: 100 * c.in_raw(bytes(range(65, 91))) > 40 * c.word_chars,
    "exclamations": lambda c: 100 * c.raw.count(b"!") > 5 * c.word_chars,
    "word length": lambda c: not 2 * c.n_words <= c.word_chars <= 20 * c.n_words,
    "echoes": lambda c: 10 * sum(map(bytes.__eq__, c.words, c.words[1:])) > 3 * c.n_words,
    "few different words": lambda c: 20 * len(set(c.words)) < c.n_words,
}


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for counts in map(Counts, batch["text"]):
            if counts.base_failed:
                continue
            for name, rule in RULES.items():
                begun = time.perf_counter()
                rejected = rule(counts)
                rows.append((name, time.perf_counter() - begun, float(rejected)))
        yield pd.DataFrame(rows, columns=["rule", "seconds", "rejected"])


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules by rejections per second on the sample, best first; ties by name."""
    sample = docs.where(drawn(F.xxhash64(doc_id, text), rows, docs.count())).select(F.col(text).alias("text"))
    measured = (
        sample.mapInPandas(_measured, "rule string, seconds double, rejected double")
        .groupBy("rule").agg(F.avg("seconds").alias("cost"), F.avg("rejected").alias("share")).collect()
    )
    worth = {r.rule: r.share / max(r.cost, 1e-9) for r in measured}
    return sorted(RULES, key=lambda name: (-worth.get(name, 0.0), name))


def cascade(docs: DataFrame, order: list[str], text: str = "text", into: str = "rules") -> DataFrame:
    """Add a struct ``into``: the base counts, ``base_failed``, ``kept`` and the rule that rejected first."""

    def one(value: str | None) -> tuple:
        c = Counts(value)
        rejected = None if c.base_failed else next((name for name in order if RULES[name](c)), None)
        return (
            c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed,
            not c.base_failed and rejected is None, rejected,
        )

    judge = text_udf(
        lambda: one,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, rejected_by string",
    )
    return docs.withColumn(into, judge(F.col(text)))


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_failed`` and ``kept`` of every row."""
    judged = cascade(docs.select("doc_id", "text"), plan(docs))
    return judged.select("doc_id", "rules.*").drop("rejected_by")
