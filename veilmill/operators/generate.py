"""Prompts and text reconstruction from triples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmill.functions import text as tx

Generator = Callable[[list[list[dict]]], list[str]]

DEFAULT_SYSTEM = (
    "Write one short, grammatical text that says what the listed triples say. "
    "Leave out triples that do not fit the others. Reply with the text alone."
)
DEFAULT_EXAMPLES = (
    ("Input triples: [{subject: tea, relation: is, object: hot}]", "Output text: The tea is hot."),
)


IDS = ("doc_id",)


def ordered_triples(triples: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """``(*ids, items)``: the parsed triples of a document, or of a run of one, in order."""
    parsed = triples.select(*ids, "pos", tx.parse_triple(F.col("triple")).alias("t"))
    return (
        parsed.groupBy(*ids)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("items"))
        .select(*ids, F.transform("items", lambda i: i["t"]).alias("items"))
    )


def triple_list_text(items: Column) -> Column:
    shown = F.transform(
        items,
        lambda t: F.concat(
            F.lit("{subject: "), t["subject"], F.lit(", relation: "), t["relation"],
            F.lit(", object: "), t["object"], F.lit("}"),
        ),
    )
    return F.concat(F.lit("Input triples: ["), F.array_join(shown, ", "), F.lit("]"))


def assemble_prompts(
    triples: DataFrame,
    system: str = DEFAULT_SYSTEM,
    examples: tuple[tuple[str, str], ...] = DEFAULT_EXAMPLES,
    ids: tuple[str, ...] = IDS,
) -> DataFrame:
    """``(*ids, messages)``: system turn, worked examples, then the document's triples."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = [message("system", F.lit(system))]
    for question, answer in examples:
        turns += [message("user", F.lit(question)), message("assistant", F.lit(answer))]
    turns.append(message("user", triple_list_text(F.col("items"))))
    return ordered_triples(triples, ids).select(*ids, F.array(*turns).alias("messages"))


def verbalize(items: Column) -> Column:
    """``s r o.`` per triple, in order."""
    return F.array_join(
        F.transform(
            items,
            lambda t: F.concat(F.concat_ws(" ", t["subject"], t["relation"], t["object"]), F.lit(".")),
        ),
        " ",
    )


def reconstruct_text(
    triples: DataFrame,
    originals: DataFrame | None = None,
    generator: Generator | None = None,
    system: str = DEFAULT_SYSTEM,
    examples: tuple[tuple[str, str], ...] = DEFAULT_EXAMPLES,
    ids: tuple[str, ...] = IDS,
) -> DataFrame:
    """``(*ids, text)`` from ``(*ids, pos, triple)``; ``ids`` begin with ``doc_id``.

    With ``originals`` a text has at most as many tokens as the original document.  A generator
    gets message lists in Arrow batches, and its output is cleaned.
    """
    if generator is None:
        texts = ordered_triples(triples, ids).select(*ids, verbalize(F.col("items")).alias("text"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                prompts = [[dict(m) for m in messages] for messages in batch["messages"]]
                yield batch[list(ids)].assign(raw=generator(prompts))

        kinds = ", ".join(f"{c} {triples.schema[c].dataType.simpleString()}" for c in ids)
        raw = assemble_prompts(triples, system, examples, ids).mapInPandas(run, f"{kinds}, raw string")
        texts = raw.select(*ids, tx.clean_generation(F.col("raw")).alias("text"))
    if originals is None:
        return texts
    caps = originals.select("doc_id", F.size(tx.tokens(F.col("text"))).alias("_cap"))
    capped = F.when(
        F.size(tx.tokens(F.col("text"))) > F.col("_cap"),
        tx.detokenize(F.slice(tx.tokens(F.col("text")), 1, F.greatest("_cap", F.lit(0)))),
    ).otherwise(F.col("text"))
    return texts.join(caps, "doc_id").select(*ids, capped.alias("text"))


POLICIES = ("null", "passthrough", "drop")


def apply_empty_policy(
    docs: DataFrame, rewritten: DataFrame, on_empty: str = "null", ids: tuple[str, ...] = IDS
) -> DataFrame:
    """``(*ids, text)`` for every row of ``docs``; those without a rewrite follow the policy.

    ``passthrough`` releases the original text unprotected.
    """
    if on_empty not in POLICIES:
        raise ValueError(f"on_empty must be one of {', '.join(POLICIES)}, not {on_empty!r}")
    made = rewritten.select(*ids, F.col("text").alias("_made"))
    if on_empty == "drop":
        return docs.select(*ids).join(made, list(ids)).withColumnRenamed("_made", "text")
    if on_empty == "null":
        joined = docs.select(*ids).join(made, list(ids), "left")
        return joined.withColumnRenamed("_made", "text")
    joined = docs.select(*ids, "text").join(made.withColumn("_has", F.lit(True)), list(ids), "left")
    return joined.select(*ids, F.when(F.col("_has"), F.col("_made")).otherwise(F.col("text")).alias("text"))
