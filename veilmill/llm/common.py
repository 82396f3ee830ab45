"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_udf(make: Callable[[], Callable[[str | None], object]], returns: T.DataType | str) -> Callable:
    """A vectorised column function of one text column.

    ``make`` is called once in each task and gives the function of one text; a struct result is
    given as a tuple in the order of its fields.
    """
    kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns

    if isinstance(kind, T.StructType):
        names = kind.fieldNames()

        def struct_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            one = make()
            for batch in batches:
                rows = [one(text) for text in batch]
                yield pd.DataFrame(
                    {n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)}
                )

        return F.pandas_udf(struct_of, kind)

    def value_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = make()
        for batch in batches:
            yield pd.Series([one(text) for text in batch], dtype=object)

    return F.pandas_udf(value_of, kind)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def drawn(key: Column, wanted: int | Column, of: int | Column) -> Column:
    """Whether the hash of ``key`` puts its row among about ``wanted`` of ``of`` rows; all if there are fewer."""
    place = F.shiftrightunsigned(F.xxhash64(key), 12) / float(1 << 52)
    return place * F.lit(of) < F.lit(wanted)


def light(keys: DataFrame, most: int = 1 << 22) -> DataFrame:
    """A written table of 64-bit keys, marked to be sent to all tasks while it has at most ``most`` rows (32 MB)."""
    return F.broadcast(keys) if keys.count() <= most else keys
