"""Triple extraction, rendering and exact in-document deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmill.functions import text as tx

# Words that anchor a triple in the default extractor.
ANCHORS = ("is", "was", "are", "be")
SENTENCE_BREAK = r"[.!?\n|]+"
SPAN_LENGTHS = ((1, 1), (1, 2), (2, 1), (2, 2))

Extractor = Callable[[str], list[tuple[str, str, str]]]


def triple_structs(text: Column) -> Column:
    """All ``subject, relation, object`` structs of a text, in order, as one array column.

    Every anchor word yields up to four overlapping variants: one or two words on each side.
    """
    sentences = F.filter(
        F.transform(F.split(text, SENTENCE_BREAK), tx.words), lambda w: F.size(w) >= 3
    )

    def variants(words: Column) -> Column:
        anchors = F.filter(
            F.sequence(F.lit(2), F.size(words) - 1),
            lambda i: F.element_at(words, i).isin(*ANCHORS),
        )

        def around(i: Column) -> Column:
            spans = [
                F.when(
                    (i > before) & (i + after <= F.size(words)),
                    F.struct(
                        F.array_join(F.slice(words, i - before, before), " ").alias("subject"),
                        F.element_at(words, i).alias("relation"),
                        F.array_join(F.slice(words, i + 1, after), " ").alias("object"),
                    ),
                )
                for before, after in SPAN_LENGTHS
            ]
            return F.filter(F.array(*spans), lambda s: s.isNotNull())

        return F.flatten(F.transform(anchors, around))

    return F.flatten(F.transform(sentences, variants))


def extract_triples(docs: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """``(doc_id, pos, subject, relation, object, triple)``, one row per extracted triple.

    The default extractor is a narrow column expression.  A user extractor maps one text to a
    list of tuples and runs on Arrow batches.
    """
    if extractor is None:
        rows = docs.select("doc_id", F.posexplode(triple_structs(F.col("text"))).alias("pos", "t"))
        rows = rows.select("doc_id", "pos", "t.subject", "t.relation", "t.object")
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            columns = ["doc_id", "pos", "subject", "relation", "object"]
            for batch in batches:
                yield pd.DataFrame(
                    [
                        (doc_id, pos, *fields)
                        for doc_id, text in zip(batch["doc_id"], batch["text"])
                        for pos, fields in enumerate(extractor(text))
                    ],
                    columns=columns,
                )

        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, pos int, subject string, relation string, object string"
        rows = docs.select("doc_id", "text").mapInPandas(run, schema)
    return rows.withColumn(
        "triple", tx.render_triple(F.col("subject"), F.col("relation"), F.col("object"))
    )


def dedupe_exact(triples: DataFrame) -> DataFrame:
    """First occurrence of every rendered triple of a document."""
    return triples.groupBy("doc_id", "triple").agg(F.min("pos").alias("pos"))


def document_triples(docs: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """Extraction and exact deduplication together.

    With the default extractor the repeats are dropped inside the row, before the array is
    unfolded, so the step needs no shuffle; ``pos`` is then the rank among the distinct ones.
    """
    if extractor is not None:
        return dedupe_exact(extract_triples(docs, extractor))
    rendered = F.transform(
        triple_structs(F.col("text")),
        lambda t: tx.render_triple(t["subject"], t["relation"], t["object"]),
    )
    return docs.select("doc_id", F.posexplode(F.array_distinct(rendered)).alias("pos", "triple"))
