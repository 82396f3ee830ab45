"""Byte pair encoding with a deterministic automaton over tokens.

``compile_automaton`` starts from the automaton of all byte strings, one state with an arc to itself
for each byte, and applies one merge gadget per merge in rank order.  The gadget of (u, v): the state
that u leads to is split off without its arc v, and every state that still has the arc u gets an arc
for the new token uv, which leads where v led.  Each byte string is then spelled by exactly one path,
and its arc labels are the merged tokens.

The arcs that a state lacks are kept, not those that it has.  Tokens are numbered in preorder along
their left parts, later merges first; with an arc v a state loses exactly the tokens that later merges
make out of v, so each gadget takes one interval of numbers away.  A transition is one search in the
sorted intervals of a state.  The tables depend on the vocabulary alone, so their size is bounded
whatever the corpus; they are compiled on the driver and broadcast.

Null texts count as empty: no ids, decoded to the empty text.  Repeated rows give equal results, an
empty table gives an empty one.  Other columns of the input are kept as they are.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmill.llm.common import text_udf

#: Code points that Unicode counts as white space (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Distinct words whose tokens a task remembers before it starts afresh.
REMEMBERED = 250_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def split_patterns() -> tuple[str, str]:
    """The split into words that precedes the merges, for ``regex`` and, quicker, for ``re``.

    The second takes Python's own character classes; it is right for texts without a character on
    which those differ from the general categories (``odd_characters``).
    """
    shape = (
        "'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{space}]+(?![^{space}])|[{space}]+"
    )
    exact = shape.format(
        letter=r"\p{L}", number=r"\p{N}", other=rf"[^{WHITE_SPACE}\p{{L}}\p{{N}}]", space=WHITE_SPACE
    )
    quick = shape.format(
        letter=r"[^\W\d_]", number=r"\d", other=rf"(?:[^{WHITE_SPACE}\w]|_)", space=WHITE_SPACE
    )
    return exact, quick


@lru_cache(maxsize=1)
def odd_characters() -> frozenset[str]:
    odd = set()
    for c in map(chr, range(0x110000)):
        kind, digit = unicodedata.category(c)[0], c.isdecimal()
        if (kind == "L") != (c.isalnum() and not digit) or (kind == "N") != digit:
            odd.add(c)
    return frozenset(odd)


@dataclass
class Automaton:
    """Transition tables; ids are those of the vocabulary."""

    labels: list[bytes]  # arc label of each id
    begins: dict[bytes, int]  # id of each label that some path can use, -1 for beginnings of labels
    place: array  # preorder number of each id
    first: array  # where the intervals of each id's state start, one more at the end
    opens: array  # first number of each interval of missing arcs
    closes: array  # number after its last
    specials: dict[str, int]
    odd: frozenset[str]

    def has_arc(self, last: int, token: int) -> bool:
        """Whether the state that ``last`` leads to has the arc ``token``."""
        number, low = self.place[token], self.first[last]
        at = bisect_right(self.opens, number, low, self.first[last + 1])
        return at == low or self.closes[at - 1] <= number

    def spell(self, word: bytes, seen: dict[int, bool]) -> list[int]:
        """The labels of the one path that spells ``word``.

        Longer arcs are tried first.  Every prefix has one path too, so a position from which no arc
        leads on is dead for good, and the search is linear in the word.  ``seen`` holds transitions
        already looked up.
        """
        n, at, last, left = len(word), 0, -1, None
        begins, labels, width = self.begins.get, self.labels, len(self.labels)
        path: list[int] = []
        shorter: list[list[int]] = []  # what remains to be tried for each arc of the path
        dead: set[int] = set()
        while at < n:
            if left is None:
                left = []
                for end in range(at + 1, n + 1):
                    token = begins(word[at:end])
                    if token is None:
                        break
                    if token >= 0:
                        left.append(token)
            while left:
                token = left.pop()
                end = at + len(labels[token])
                if end in dead:
                    continue
                if at:
                    pair = last * width + token
                    arc = seen.get(pair)
                    if arc is None:
                        arc = seen[pair] = self.has_arc(last, token)
                    if not arc:
                        continue
                path.append(token)
                shorter.append(left)
                at, last, left = end, token, None
                break
            else:
                dead.add(at)
                at -= len(labels[path.pop()])
                last, left = path[-1] if path else -1, shorter.pop()
        return path


def compile_automaton(vocabulary: dict) -> Automaton:
    """Apply the merge gadgets of a byte-level vocabulary (the parsed ``tokenizers`` file)."""
    model, letters = vocabulary["model"], byte_letters()
    ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
    if len(ids) != len(model["vocab"]) or any(bytes([b]) not in ids for b in range(256)):
        raise ValueError("not a byte-level vocabulary")
    specials = {x["content"]: x["id"] for x in vocabulary.get("added_tokens") or []}
    size = max([*ids.values(), *specials.values()]) + 1
    labels: list[bytes] = [b""] * size
    for label, i in ids.items():
        labels[i] = label
    for label, i in specials.items():
        labels[i] = label.encode()
    merges, made = [], set()
    for pair in model["merges"]:
        left, right = (bytes(letters[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
        u, v, uv = ids[left], ids[right], ids[left + right]
        if uv in made:
            raise ValueError("two merges make the same token")
        made.add(uv)
        merges.append((u, v, uv))

    # Preorder along left parts, later merges first.
    children: list[list[int]] = [[] for _ in range(size)]
    ranks: list[list[int]] = [[] for _ in range(size)]
    for rank, (u, _, uv) in enumerate(merges):
        children[u].append(uv)
        ranks[u].append(rank)
    weight, after = [1] * size, [[0] for _ in range(size)]
    order = [uv for _, _, uv in reversed(merges)] + [ids[bytes([b])] for b in range(256)]
    for token in order:
        sums = [0]
        for child in reversed(children[token]):
            sums.append(sums[-1] + weight[child])
        after[token] = sums[::-1]  # weight of the children from each on
        weight[token] += sums[-1]
    place, at = array("i", [-1] * size), 0
    for token in reversed(order[len(merges):]):
        place[token] = at
        at += weight[token]
    for token in reversed(order):
        for k, child in enumerate(children[token]):
            place[child] = place[token] + 1 + after[token][k + 1]

    # The gadgets.  A state is the state that a token led to at some time, less what it lost since.
    lost: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    base: list[tuple[int, int]] = [(-1, 0)] * size
    alive = [False] * size
    for b in range(256):
        alive[ids[bytes([b])]] = True

    def lacks(token: int, number: int) -> bool:
        until = len(lost[token])
        while token >= 0:
            if any(o <= number < c for o, c in lost[token][:until]):
                return True
            token, until = base[token]
        return False

    for rank, (u, v, uv) in enumerate(merges):
        if not (alive[u] and alive[v]) or lacks(u, place[v]):
            continue  # no path ever has u before v: the merge adds no arc
        alive[uv] = True
        base[uv] = (v, len(lost[v]))
        lost[u].append((place[v], place[v] + 1 + after[v][bisect_left(ranks[v], rank)]))

    first, opens, closes = array("i", [0]), array("i"), array("i")
    for token in range(size):
        gone, t, until = [], token, len(lost[token])
        while t >= 0:
            gone += lost[t][:until]
            t, until = base[t]
        gone.sort()
        begun = len(opens)
        for o, c in gone:
            if len(opens) > begun and o <= closes[-1]:
                closes[-1] = max(closes[-1], c)
            else:
                opens.append(o)
                closes.append(c)
        first.append(len(opens))
    begins: dict[bytes, int] = {}
    for label, i in ids.items():
        if alive[i]:
            for end in range(1, len(label)):
                begins.setdefault(label[:end], -1)
            begins[label] = i
    return Automaton(labels, begins, place, first, opens, closes, specials, odd_characters())


class Words(dict):
    """Packed ids by word, spelled when first asked for."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.seen = automaton, {}

    def __missing__(self, word: str) -> bytes:
        packed = self[word] = array("I", self.automaton.spell(word.encode(), self.seen)).tobytes()
        return packed

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.seen) > 2 * REMEMBERED:
            self.seen.clear()


class Coder:
    """Encoding and decoding in one task, with a bounded memory of words already spelled."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        exact, quick = split_patterns()
        self.exact, self.quick = regex.compile(exact).findall, re.compile(quick).findall
        specials = sorted(automaton.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.known = Words(automaton)

    def _packed(self, text: str) -> bytes:
        plain = self.automaton.odd.isdisjoint(text)
        words = (self.quick if plain else self.exact)(text)
        packed = b"".join(map(self.known.__getitem__, words))
        self.known.trim()
        return packed

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        parts, at = [], 0
        for match in self.special.finditer(text) if self.special else ():
            parts.append(self._packed(text[at : match.start()]))
            parts.append(array("I", [self.automaton.specials[match[0]]]).tobytes())
            at = match.end()
        parts.append(self._packed(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray | None) -> str:
        """Emit the label of each arc; bytes that aren't UTF-8 become the replacement character."""
        if ids is None or not len(ids):
            return ""
        labels = self.automaton.labels
        return b"".join(map(labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """One coder per worker process and broadcast."""
    if shared.value is not getattr(_coders.get(0), "automaton", None):
        _coders[0] = Coder(shared.value)
    return _coders[0]


@lru_cache(maxsize=4)
def load_automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as file:
        return compile_automaton(json.load(file))


def broadcast_automaton(spark: SparkSession, path: str):
    """The tables of the vocabulary file at ``path`` (on the driver), for all executors."""
    return spark.sparkContext.broadcast(load_automaton(path))


def encode(docs: DataFrame, shared, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the token ids (array of int) of ``text`` as column ``into``."""
    ids = text_udf(lambda: lambda x, c=_coder(shared): c.encode(x).astype("i4"), "array<int>")
    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, shared, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that the token ids stand for as column ``into``."""
    texts = text_udf(lambda: lambda x, c=_coder(shared): c.decode(x), "string")
    return docs.withColumn(into, texts(F.col(ids)))


def round_trip(docs: DataFrame, shared, text: str = "text", into: str = "tokens") -> DataFrame:
    """Add a struct ``into``: the ids as little-endian unsigned 32-bit integers, and the text decoded from them.

    Both steps run in one Python worker per task, which holds the tables and remembered words once.
    """

    def make():
        coder = _coder(shared)

        def one(value: str | None) -> tuple[bytes, str]:
            ids = coder.encode(value)
            return ids.tobytes(), coder.decode(ids)

        return one

    return docs.withColumn(into, text_udf(make, "ids binary, decoded string")(F.col(text)))


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode, decode and give ``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row."""
    shared = broadcast_automaton(docs.sparkSession, path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return round_trip(rows, shared).select(
        "doc_id",
        (F.octet_length("tokens.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens.ids", 256).alias("ids_sha256"),
        F.sha2("tokens.decoded", 256).alias("decoded_sha256"),
    )


__all__ = [
    "Automaton", "Coder", "broadcast_automaton", "compile_automaton", "decode", "digests", "encode",
    "load_automaton", "round_trip",
]
