"""Words of whole batches of texts as arrays: the same words as ``text.words`` gives, without a regular expression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 24  #: bytes of text held as arrays at once; a longer text is a chunk of its own
START = "<s>"
BLANK = 32
# Letters in lower case, everything else a blank; bytes of other characters are never ASCII.
LETTERS = np.full(256, BLANK, np.uint8)
LETTERS[65:91] = LETTERS[97:123] = np.arange(97, 123)
# The marks that end a sentence.
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in ".!?\n"]] = True
# Bytes by their part in a token: blanks, letters and digits, bytes that go on with a character, others.
BETWEEN, ALNUM, GOES_ON, ALONE = range(4)
KINDS = np.full(256, ALONE, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = BETWEEN
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = ALNUM
KINDS[0x80:0xC0] = GOES_ON


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts and where each begins, and the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text, else ``CHUNK``."""
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // (size or CHUNK)
    begins = np.append(0, np.flatnonzero(np.diff(part)) + 1)
    for begin, end in zip(begins, [*begins[1:], batch.num_rows], strict=True):
        if end > begin:
            yield batch.slice(begin, end - begin)


def split_words(texts: pa.Array, marked: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the number of words of each text, and, if ``marked``, for each word the marks before it."""
    data, bounds = _bytes(texts)
    low = LETTERS[data]
    letter = low != BLANK
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    begin[first] = letter[first]
    starts = np.flatnonzero(begin)
    upto = np.append(np.cumsum(letter, dtype=np.int32)[starts] - 1, np.count_nonzero(letter))
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(low[letter]))
    counts = np.diff(np.searchsorted(starts, bounds))
    return words, counts, np.cumsum(MARKS[data], dtype=np.int32)[starts] if marked else starts[:0]


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of the texts as ``text.tokens`` gives them, the number of each text, and which are not one punctuation mark."""
    data, bounds = _bytes(texts)
    kind = KINDS[data]
    begin = kind == ALNUM
    run = begin.copy()
    begin[1:] &= ~run[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    begin[first] = run[first]
    begin |= kind == ALONE
    starts, kept = np.flatnonzero(begin), kind != BETWEEN
    upto = np.append(np.cumsum(kept, dtype=np.int32)[starts] - 1, np.count_nonzero(kept))
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data[kept]))
    lead = data[starts]
    counts = np.diff(np.searchsorted(starts, bounds))
    return tokens, counts, (kind[starts] == ALNUM) | (lead < 33) | (lead > 126)


def coded_bigrams(
    texts: pa.Array, most: int | None = None
) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``(dictionary, row, prev, word)``: the bigrams of the texts in order, words as places in the dictionary.

    The start token is its first entry.  Of each text only the first ``most`` words are taken.
    """
    words, counts, _ = split_words(texts)
    coded = words.dictionary_encode()
    row, word = np.repeat(np.arange(len(counts)), counts), coded.indices.to_numpy().astype(np.int64) + 1
    prev = np.append(0, word[:-1])[: len(word)]
    first = (np.cumsum(counts) - counts)[counts > 0]
    prev[first] = 0
    if most is not None:
        kept = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts) < most
        row, prev, word = row[kept], prev[kept], word[kept]
    return pa.concat_arrays([pa.array([START]), coded.dictionary]), row, prev, word


def counted_bigrams(texts: pa.Array, by_text: bool, most: int | None = None) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """``(row, prev, word, n)``: each different bigram of a text, or of all texts together, and how often it stands there."""
    names, row, prev, word = coded_bigrams(texts, most)
    size, rows = len(names), len(texts)
    both = prev * size + word
    if not by_text:
        pairs, n = np.unique(both, return_counts=True)
        row = np.zeros(len(pairs), np.int64)
    elif rows * size * size < 2**62:
        codes, n = np.unique(row * (size * size) + both, return_counts=True)
        row, pairs = codes // (size * size), codes % (size * size)
    else:  # pairs are numbered within the chunk, so that a row and a pair fit one number
        listed, place = np.unique(both, return_inverse=True)
        codes, n = np.unique(row * len(listed) + place, return_counts=True)
        row, pairs = codes // max(len(listed), 1), listed[codes % max(len(listed), 1)]
    return row, names.take(pa.array(pairs // size)), names.take(pa.array(pairs % size)), n.astype(np.int64)


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Of each text the words, their letters, sentences with a word, squares of their words, different bigrams."""
    words, counts, marks = split_words(texts, marked=True)
    rows = len(counts)
    row = np.repeat(np.arange(rows), counts)
    letters = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (marks[1:] != marks[:-1])
    at = np.flatnonzero(new)
    lengths, of = np.diff(np.append(at, len(row))), row[at]
    different = np.bincount(counted_bigrams(texts, by_text=True)[0], minlength=rows)

    def total(of_rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return np.bincount(of_rows, numbers, minlength=rows).astype(np.int64)

    return {
        "n_words": counts, "letters": total(row, letters), "sentences": np.bincount(of, minlength=rows),
        "squares": total(of, lengths.astype(np.float64) ** 2), "bigrams": different,
    }
