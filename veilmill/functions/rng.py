"""Keyed randomness.

Every draw is a function of (seed, row keys), never of ``rand()``: a retried task or a plan
that is evaluated twice repeats the same draw instead of releasing a second one.  Seeds must
be secret and fresh for each real release; fixed seeds are for tests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2**52)


def key_text(seed, *keys: Column) -> Column:
    """The text that is hashed: seed and keys joined by ``|``."""
    return F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])


def hash_int(text: Column, hex_digits: int = 13) -> Column:
    """The leading hex digits of md5 as a BIGINT (13 digits = 52 bits)."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("bigint")


def digit_codes(texts: pa.Array, hex_digits: int) -> np.ndarray:
    """The leading hex digits of the md5 of each text as a number; equal texts are hashed once."""
    coded = texts.dictionary_encode()
    each = [int(hashlib.md5(t.encode()).hexdigest()[:hex_digits], 16) for t in coded.dictionary.to_pylist()]
    return np.array(each, np.int64)[coded.indices.to_numpy()] if len(each) else np.zeros(0, np.int64)


def list_lengths(lists: pa.Array) -> np.ndarray:
    """Lengths of the lists, 0 for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def lists_of(values: pa.Array, lengths: np.ndarray, nulls: pa.Array | None = None) -> pa.Array:
    """The values cut into lists of these lengths, null where ``nulls`` says so."""
    ends = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
    return pa.ListArray.from_arrays(ends, values, mask=nulls)


def hash_ints(texts: Column, hex_digits: int = 13) -> Column:
    """``hash_int`` of each text of an array; a text that repeats in a batch is hashed once."""

    @F.arrow_udf("array<bigint>")
    def hashes(lists: pa.Array) -> pa.Array:
        return lists_of(pa.array(digit_codes(lists.flatten(), hex_digits)), list_lengths(lists), lists.is_null())

    return hashes(texts)


def hash_pair(text: Column) -> tuple[Column, Column]:
    """The two halves of md5 as BIGINTs."""
    return digest_pair(F.md5(text))


def digest_pair(digest: Column) -> tuple[Column, Column]:
    """The two halves of an md5 in hex; within a lambda, where Spark works out every mention of a column anew."""
    high, low = (F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(2))
    return high, low


def uniform(seed, *keys: Column) -> Column:
    """A uniform draw strictly between 0 and 1."""
    return (hash_int(key_text(seed, *keys)) + F.lit(0.5)) / F.lit(TWO_52)


def gumbel(seed, *keys: Column) -> Column:
    return -F.ln(-F.ln(uniform(seed, *keys)))


def laplace(scale: Column, seed, *keys: Column) -> Column:
    """Laplace noise by inversion of the distribution function."""
    u = uniform(seed, *keys) - F.lit(0.5)
    return -scale * F.signum(u) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def normal(scale: Column, seed, *keys: Column) -> Column:
    """Normal noise by Box-Muller from two independent keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(f"{seed}.r", *keys)))
    return scale * radius * F.cos(F.lit(2.0) * F.pi() * uniform(f"{seed}.a", *keys))
