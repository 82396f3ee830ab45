"""Text expressions shared by the operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern (a run of ASCII letters/digits, or one other visible character).
TOKEN_PATTERN = r"([A-Za-z0-9]+|[^A-Za-z0-9\s])"
WORD_PATTERN = r"([A-Za-z]+)"
# The 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Field separator of a rendered triple.
SEPARATOR = " | "
# Markers after which a generated text is cut.
ANSWER_MARKER = "Output text: "
CUT_MARKERS = (
    "USER:", "\t", "ASSISTANT", "USER", "###", "Note:", "Explanation:", "```", "EXPECTED_OUTPUT",
)
PARAPHRASE_PREFIX = "Document : "
PARAPHRASE_SUFFIX = "\nParaphrase of the document :"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters."""
    found = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(1))
    return F.transform(found, F.lower)


def is_punctuation(token: Column) -> Column:
    return token.isin(*PUNCTUATION)


def is_word(token: Column) -> Column:
    return ~is_punctuation(token)


def word_count(toks: Column) -> Column:
    """Number of tokens that are not a single punctuation mark."""
    return F.size(F.filter(toks, is_word))


def n_words(text: Column) -> Column:
    """``word_count`` of the tokens of a text, without a list of them all."""

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pc.count_substring_regex(texts, r"[A-Za-z0-9]+|[^\t-\r -~]").cast(pa.int64())

    return counted(text)


def truncate_tokens(toks: Column, limit: int | None) -> Column:
    return toks if limit is None else F.slice(toks, 1, limit)


def detokenize(toks: Column) -> Column:
    """Join with blanks, then close the gap before closing marks."""
    return F.regexp_replace(F.array_join(toks, " "), r"\s+([.,;:!?])", "$1")


def render_triple(subject: Column, relation: Column, obj: Column) -> Column:
    return F.translate(F.concat_ws(SEPARATOR, subject, relation, obj), "_", " ")


def parse_triple(triple: Column, swap_ends: bool = False) -> Column:
    """Split a rendered triple into a struct; a short row gives nulls, extra parts are ignored."""
    parts = F.split(triple, r" \| ")
    whole = F.size(parts) >= 3
    first, relation, last = (F.when(whole, F.get(parts, F.lit(i))) for i in range(3))
    if swap_ends:
        first, last = last, first
    return F.struct(first.alias("subject"), relation.alias("relation"), last.alias("object"))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; empty when the text is shorter than ``n``."""
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - F.lit(n - 1), F.lit(1))),
        lambda i: F.substring(text, i, F.lit(n)),
    )
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(
        F.array().cast("array<string>")
    )


def clean_generation(text: Column) -> Column:
    """Keep the answer of a raw model output: after the answer marker, before any cut marker."""
    blanks = F.lit(" \t\r\n")
    out = F.btrim(F.substring_index(text, ANSWER_MARKER, -1), blanks)
    out = F.replace(out, F.lit("\n"), F.lit(""))
    for marker in CUT_MARKERS:
        out = F.substring_index(out, marker, 1)
    return F.btrim(out, blanks)


def paraphrase_prompt(text: Column) -> Column:
    return F.concat(F.lit(PARAPHRASE_PREFIX), text, F.lit(PARAPHRASE_SUFFIX))
