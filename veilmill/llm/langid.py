"""Language identification by compression.

For each language a zstandard raw-content dictionary is put together from a bounded sample of labelled
texts.  A text is cut into pieces, each piece is compressed with every dictionary, and the language
with the smallest total wins.  ``margin`` is the share of bytes that the best dictionary saves over the
second best; below ``narrow`` the decision is rejected (``accepted`` is false, the best guess stays).

Defined results: a null text or one without a letter is ``und`` with score 0 and not accepted, and so is
every text if nothing was learned.  Ties go to the language with more training rows, then by name.  The
whole text is read whatever its length.  Repeated rows give equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmill.llm.common import drawn, fold, text_udf
from veilmill.session import cut_lineage

UNDETERMINED = "und"
SAMPLE_ROWS = 400  #: labelled rows per language that a dictionary is made of
DICTIONARY_BYTES = 1 << 16  #: bytes of a dictionary, shared equally by those rows
MOST_LANGUAGES = 500  #: the most frequent ones are learned; bounds the broadcast: 32 MB of dictionaries
EXCERPT_BYTES = 512  #: of a piece of a text that gives several
PIECE_BYTES = 8192
LEVEL = 6
NARROW = 0.01  #: margin below which a decision is rejected

_LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def letters_only(text: str) -> bytes:
    """The text in lower case, with anything ASCII but letters as single spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split())


def excerpt(text: str, share: int, key: int) -> bytes:
    """``share`` bytes of the letters of a text, in pieces from places over the whole text that hashes choose."""
    raw = letters_only(text)
    if len(raw) <= share:
        return raw
    pieces = max(1, share // EXCERPT_BYTES)
    size = share // pieces
    out = []
    for j in range(pieces):
        u = xxhash.xxh64_intdigest(f"{key}|{j}") / 2**64
        begin = int((j + u) * (len(raw) - size) / pieces)
        out.append(raw[begin : begin + size])
    return b" ".join(out)[:share]


@dataclass
class Dictionaries:
    content: dict[str, bytes]  # by language, most frequent first
    level: int
    narrow: float


class Classifier:
    """Compressors of one task."""

    def __init__(self, model: Dictionaries):
        self.model = model
        self.compressors = []
        for content in list(model.content.values()) + [b""] * (len(model.content) == 1):
            extra = {}
            if content:
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=model.level)
                extra["dict_data"] = words
            self.compressors.append(
                zstandard.ZstdCompressor(level=model.level, write_content_size=False, write_checksum=False, **extra)
            )

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes by dictionary; with a single one, also without it."""
        raw = letters_only(text)
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        if not text or not self.model.content or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(self.model.content)), key=lambda i: (sizes[i], i))
        second = min(x for i, x in enumerate(sizes) if i != best)
        margin = max(0.0, (second - sizes[best]) / second)
        score = 1.0 - 0.5 * math.exp(-margin / self.model.narrow)
        return list(self.model.content)[best], score, margin, margin >= self.model.narrow


def learn(
    labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", *,
    rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES, level: int = LEVEL, narrow: float = NARROW,
) -> Dictionaries:
    """Dictionaries from at most ``rows`` rows of each language, those with the smallest hashes.

    Twice as many are drawn first, by a threshold on the hash that the number of different rows of the
    language gives, so no task ranks more than about that.  Equal rows count once.
    Rows with a null language or no letter in the text don't count.  The rows of a language share its
    ``size`` bytes, each giving excerpts of its whole text, so few rows give more each.  Of more than
    ``MOST_LANGUAGES`` languages the most frequent are learned.
    """
    usable = labelled.select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("at")
    ).where("lang is not null and text rlike '\\\\p{L}'")
    counts = usable.groupBy("lang").agg(
        F.count("*").alias("count"), F.approx_count_distinct("at").alias("different")
    ).orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    # No language at all gives an empty map, whose rows are none.
    of = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, float(r.different)))) if counts else F.lit(None).cast("map<string,double>")
    sample = (
        usable.where(drawn(F.col("at"), 2 * rows, of[F.col("lang")])).dropDuplicates(["lang", "at"])
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at")))
        .where(F.col("n") <= rows)
    )
    sample = cut_lineage(sample, "dictionary_rows")
    given = sample.groupBy("lang").agg(F.count("*").alias("given"))

    @F.pandas_udf("binary")
    def excerpts(texts: pd.Series, given: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([excerpt(t, size // g, k) for t, g, k in zip(texts, given, keys, strict=True)], dtype=object)

    parts = sample.join(given, "lang").select("lang", "n", excerpts("text", "given", "at").alias("part"))
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in parts.collect():  # ``size`` bytes a language
        found.setdefault(r.lang, []).append((r.n, bytes(r.part)))
    content = {r.lang: b" ".join(p for _, p in sorted(found.get(r.lang, [])))[:size] for r in counts}
    content = {lang: c for lang, c in content.items() if c}
    return Dictionaries(content, level, narrow)


def identify(docs: DataFrame, model: Dictionaries, text: str = "text", into: str = "language") -> DataFrame:
    """Add a struct ``into`` of ``lang_pred, score, margin, accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    classify = text_udf(
        lambda: Classifier(shared.value), "lang_pred string, score double, margin double, accepted boolean"
    )
    return docs.withColumn(into, classify(F.col(text)))


def predictions(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fifth, then classify every row."""
    held_out = fold(F.col("doc_id"), 5) == 0
    model = learn(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "language.*")
