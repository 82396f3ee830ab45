"""Surrogates for personal data.

``find`` locates e-mail addresses, telephone numbers, IP addresses (both versions), card numbers, IBANs
with right check digits, keys, tokens, passwords and titled names of up to four words; ``mentions`` adds
every later or earlier capitalised mention of a part of such a name in the same text.  Each entity gets a replacement of its own type, drawn from HMAC-SHA256 of
a secret key, the type and the entity in normal form: digits become digits, letters letters of the same
case, punctuation stays, card numbers keep a valid check digit and their first digit, IBANs their country and valid check digits, addresses of one
domain share a domain, names keep gender, script and title.  The same entity gets the same surrogate
in every document.  First and last names are entities of their own, so a last name alone agrees with the
whole name; a first name is the same wherever its title tells the same gender.

Two entities whose surrogates meet, or a surrogate that is an entity of the corpus, would merge what was
distinct.  ``attempts`` checks all different entities of the corpus: of those that meet, all but the
smallest draw again, until none meet; later draws are longer, so there is always a free one.  Only entities that drew again are kept, with their number; all
others are replaced from the key alone, so the texts needn't be joined with a table of all entities.

Defined results: null texts stay null, texts without entities stay as they are, a secret without letters
or digits (masked) is no entity, entities that overlap are
taken from the left, longer first.  Repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmill.session import cut_lineage

#: Titles and the gender that they tell (fixed values).
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Herr": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
    "Dr": "n", "Prof": "n", "господин": "m", "госпожа": "f",
}
#: First names by script and gender (fixed values).
FIRST = {
    ("latin", "m"): "Adam Bruno Carl David Erik Felix George Hugo Ivan Jonas Karl Leo Martin Noel Oscar Paul".split(),
    ("latin", "f"): "Alice Berta Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula".split(),
    ("latin", "n"): "Alex Chris Dana Eli Jamie Kim Lee Morgan Noa Robin Sam Sasha Taylor Toni".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга".split(),
    ("cyrillic", "n"): "Саша Женя Валя Шура".split(),
}
#: Syllables of surnames by script (fixed values).
SYLLABLES = {
    "latin": "ba be bo da den dor fa fel gar hal ken kor la lin mar men nor pel ram ros sal ten tor val ver wen".split(),
    "cyrillic": "ба бе во га да до ка ко ла ле ма на ро са та ти".split(),
}
_FEMALE_NAMES = frozenset(x for (_, g), names in FIRST.items() if g == "f" for x in names)
_MALE_NAMES = frozenset(x for (_, g), names in FIRST.items() if g == "m" for x in names)

#: Words that a sentence may put behind a title without meaning a name (fixed values).
NO_NAMES = frozenset(
    "And Are At But Can Could Did Do Does For From Had Has Have He How I If In Is It May Might Must My No Not "
    "Of On Or Our She Should So That The Then There They This To Was We What When Where Which Who Why Will With Would You Your".split()
)

_NO_NAMES = NO_NAMES | set(TITLES)
_NAME = r"[^\W\d_][^\W\d_'’-]+"
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<=password=)[^\s\"']+|(?<=token = \")[^\s\"']+|(?<=token=)[^\s\"']+|\bAKIA[0-9A-Z]{16}\b|\b[0-9a-f]{32,64}\b",
    "ip": r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:{1,2}){1,7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])",
    "national": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "person": rf"(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? {_NAME}(?: {_NAME}){{0,3}}",
}
_ALL = re.compile("|".join(f"(?P<{kind}>{p.replace(chr(92) + '1', '(?P=gap)').replace('([ -]?)', '(?P<gap>[ -]?)')})" for kind, p in _PATTERNS.items()))
_ACCESS_KEY = re.compile(r"AKIA[0-9A-Z]{16}")
_TRIGGER = re.compile(r"[@\d]|password=|token ?=")


def _valid(kind: str, shown: str) -> bool:
    """Whether a find is what it looks like."""
    if kind == "secret":  # a masked value, such as password=***, has nothing to replace
        return any(c.isalpha() or c.isdigit() for c in shown)
    if kind == "iban":
        return _iban_rest(shown.replace(" ", "")) == 1
    if kind == "ipv6":
        try:
            return bool(ipaddress.IPv6Address(shown)) and sum(c != ":" for c in shown) >= 8
        except ValueError:
            return False
    return True


def _iban_rest(shown: str) -> int:
    return int("".join(str(int(c, 36)) for c in shown[4:] + shown[:4])) % 97


def _without_genitive(word: str) -> str:
    return word[:-2] if len(word) > 3 and word[-2:] in ("'s", "\u2019s") else word


def find(text: str | None) -> list[tuple[str, int, int]]:
    """``(type, begin, end)`` of each entity, in order."""
    if not text or not (_TRIGGER.search(text) or any(t in text for t in TITLES)):
        return []
    found, at = [], 0
    while m := _ALL.search(text, at):
        kind = next(k for k in _PATTERNS if m[k])
        begin, at = m.start(), m.end()
        if kind == "person":
            title, *parts = m[0].split(" ")
            names = list(takewhile(lambda x: x[:1].isupper(), parts))
            if not names or names[0] in _NO_NAMES:
                at = begin + len(title)
                continue
            names = list(takewhile(lambda x: x not in _NO_NAMES, names))
            at = begin + len(" ".join([title, *names]))
            names[-1] = _without_genitive(names[-1])
            found.append((kind, begin + len(title) + 1, begin + len(" ".join([title, *names]))))
        elif _valid(kind, m[0]):
            found.append((kind, begin, at))
        elif kind != "secret":
            at = begin + 1
    return found


def normal(kind: str, shown: str) -> str:
    """The form in which an entity is the same wherever it is written."""
    if kind in ("card", "phone", "national"):
        return "+" * shown.startswith("+") + "".join(c for c in shown if c.isdigit())
    if kind == "ipv6":
        return ipaddress.IPv6Address(shown).exploded
    if kind == "iban":
        return shown.replace(" ", "")
    return shown.lower() if kind == "email" or "name" in kind else shown


class Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, *parts: object):
        self.seed = hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()
        self.bytes, self.block = b"", 0

    def below(self, n: int) -> int:
        if len(self.bytes) < 8:
            self.bytes = hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        value, self.bytes = int.from_bytes(self.bytes[:8], "big"), self.bytes[8:]
        return value % n

    def more(self, attempt: int, of: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> str:
        """What later attempts add, so that there is always a free form."""
        return "".join(of[self.below(len(of))] for _ in range(attempt // 4))

    def like(self, shown: str) -> str:
        """Each letter and digit replaced by one of its kind."""
        hexadecimal = len(shown) >= 16 and not shown.isdigit() and all(c in "0123456789abcdef" for c in shown)
        made = []
        for c in shown:
            if hexadecimal:
                made.append("0123456789abcdef"[self.below(16)])
            elif c.isdigit():
                made.append(str(self.below(10)))
            elif "a" <= c <= "z":
                made.append(chr(97 + self.below(26)))
            elif "A" <= c <= "Z":
                made.append(chr(65 + self.below(26)))
            elif "а" <= c.lower() <= "я":
                letter = chr(ord("а") + self.below(32))
                made.append(letter.upper() if c.isupper() else letter)
            elif c.isalpha():
                letter = chr(97 + self.below(26))
                made.append(letter.upper() if c.isupper() else letter)
            else:
                made.append(c)
        return "".join(made)


def _script(name: str) -> str:
    return "cyrillic" if any("а" <= c.lower() <= "я" for c in name) else "latin"


def _check_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def units(kind: str, shown: str, gender: str) -> list[tuple[str, str]]:
    """The entities in a find as written: one, or the first and last name."""
    if kind != "person":
        return [(kind, shown)]
    *first, last = shown.split(" ")
    return [*((f"first name {gender}", x) for x in first), ("last name", last)]


def name(key: bytes, kind: str, shown: str, attempt: int) -> str:
    """Each attempt adds a syllable to choose from, so there is always a free name."""
    script, stream = _script(shown), Stream(key, kind, shown.lower(), attempt)
    syllables = SYLLABLES[script]
    if kind == "last name":
        made, more = "", 4 + attempt // 2
    else:
        gender = next((g for g, n in (("f", _FEMALE_NAMES), ("m", _MALE_NAMES)) if shown.capitalize() in n), kind[-1])
        made, more = (pool := FIRST[script, gender])[stream.below(len(pool))], attempt
    made += "".join(syllables[stream.below(len(syllables))] for _ in range(more))
    return made.upper() if shown.isupper() else made.capitalize()


def surrogate(key: bytes, kind: str, shown: str, attempt: int = 0) -> str:
    """The replacement of an entity as written, in the form in which it is written."""
    entity = normal(kind, shown)
    stream = Stream(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        of_domain = Stream(key, "domain", domain).like(domain.rpartition(".")[0])
        made = f"{stream.like(local)}{stream.more(attempt)}@{of_domain}.{domain.rpartition('.')[2]}"
        return made.upper() if shown.isupper() else made
    if kind == "ip":
        return ".".join([str(1 + stream.below(223)), *(str(stream.below(256)) for _ in range(3))])
    if kind == "ipv6":
        # Groups of zeros stay, so that an address is shortened where the original is.
        groups = [g if g == "0000" else f"{1 + stream.below(0xFFFF):04x}" for g in entity.split(":")]
        if "::" in shown:
            made = str(ipaddress.IPv6Address(":".join(groups)))
        else:
            full = all(len(g) == 4 for g in shown.split(":"))
            made = ":".join(g if full else f"{int(g, 16):x}" for g in groups)
        return made.upper() if shown.isupper() else made
    if kind == "iban":
        rest = stream.like(entity[4:])
        made = iter(f"{entity[:2]}{98 - _iban_rest(entity[:2] + '00' + rest):02d}{rest}")
        return "".join(c if c == " " else next(made) for c in shown)
    if kind in ("card", "phone", "national"):
        entity = entity.lstrip("+")
        digits = stream.like(entity)
        if kind == "card":
            digits = entity[0] + digits[1:-1]
            digits += _check_digit(digits)
        elif shown.startswith("+"):
            digits = entity[0] + str(2 + stream.below(8)) + digits[2:]
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in shown) + stream.more(attempt, "0123456789") * (kind == "phone")
    if kind.endswith("name") or kind.startswith("first name"):
        return name(key, kind, shown, attempt)
    prefix = "AKIA" if _ACCESS_KEY.fullmatch(shown) else ""
    made = stream.like(shown[len(prefix) :])
    if prefix:
        made = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[stream.below(32)] for _ in made)
    return prefix + made + stream.more(attempt)


def _gender(text: str, begin: int) -> str:
    """What the title before a name tells."""
    title = re.split(r"\s", text[max(0, begin - 20) : begin].rstrip(" ."))[-1]
    return next((g for t, g in sorted(TITLES.items(), key=lambda x: -len(x[0])) if title.endswith(t)), "n")


_WORD = re.compile(r"[^\W\d_]+(?:['\u2019-][^\W\d_]+)*")


def mentions(text: str | None) -> list[tuple[str, int, int, list[tuple[str, str]]]]:
    """``(type, begin, end, units)`` of each entity, other mentions of a text's names among them."""
    found = [
        (kind, b, e, units(kind, text[b:e], _gender(text, b) if kind == "person" else "n")) for kind, b, e in find(text)
    ]
    known: dict[str, str] = {}
    for kind, _, _, parts in found:
        for k, x in parts if kind == "person" else ():
            known.setdefault(x.lower(), k)
    if not known:
        return found
    # One pass over the words between the entities; a name counts where it begins with a capital.
    out, at = [], 0
    for entity in [*found, ("", len(text), len(text), [])]:
        for m in _WORD.finditer(text, at, entity[1]):
            word = _without_genitive(m[0])
            if word[0].isupper() and word not in _NO_NAMES and word.lower() in known:
                out.append(("person", m.start(), m.start() + len(word), [(known[word.lower()], word)]))
        out.append(entity)
        at = entity[2]
    return out[:-1]


def replace(text: str | None, key: bytes, drawn: dict[tuple[str, str], int]) -> tuple[str | None, list[str], list[int], list[int]]:
    """The text with surrogates, and the type, begin and end of each in the new text."""
    if text is None:
        return None, [], [], []
    out, kinds, begins, ends, at, size = [], [], [], [], 0, 0
    for kind, begin, end, parts in mentions(text):
        made = " ".join(surrogate(key, k, x, drawn.get((k, normal(k, x)), 0)) for k, x in parts)
        out += [text[at:begin], made]
        size += begin - at
        kinds.append(kind)
        begins.append(size)
        size += len(made)
        ends.append(size)
        at = end
    return "".join([*out, text[at:]]), kinds, begins, ends


def entities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` (as text, null as empty)``, kind, entity`` of each different entity of each document."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {
                (i, k, normal(k, x))
                for i, value in zip(batch["i"], batch["text"], strict=True)
                for _, _, _, parts in mentions(value)
                for k, x in parts
            }
            yield pd.DataFrame(sorted(found), columns=["doc_id", "kind", "entity"])

    rows_in = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("text"))
    return rows_in.mapInPandas(rows, "doc_id string, kind string, entity string")


def attempts(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, entity, attempt`` of the entities that had to draw again, after all collisions are gone."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [
                normal(k, surrogate(key, k, e, a))
                for k, e, a in zip(b["kind"], b["entity"], b["attempt"], strict=True)
            ]
            yield b.assign(made=pd.Series(made, dtype=object, index=b.index))

    schema = "kind string, entity string, attempt int, made string"
    different = found.select("kind", "entity").distinct().withColumn("attempt", F.lit(0))
    drawn = cut_lineage(different.mapInPandas(draw, schema), "drawn")
    taken = drawn.select("kind", F.col("entity").alias("made")).withColumn("real", F.lit(True))
    while True:
        order = Window.partitionBy("kind", "made").orderBy("attempt", "entity")
        meets = drawn.withColumn("n", F.row_number().over(order)).join(taken, ["kind", "made"], "left")
        again = cut_lineage(
            meets.where("n > 1 or real").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), "again"
        )
        if again.isEmpty():
            return drawn.where("attempt > 0").select("kind", "entity", "attempt")
        stay = drawn.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti").select(*drawn.columns)
        drawn = cut_lineage(stay.unionByName(again.mapInPandas(draw, schema)), "drawn")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id", into: str = "surrogates") -> DataFrame:
    """Add a struct ``into``: the new text and the type and place of each surrogate in it."""
    if len(key) < 16:
        raise ValueError("the key must have 16 bytes at least")
    found = cut_lineage(entities(docs, text, doc_id), "entities")
    again = attempts(found, key)
    per_doc = found.join(again, ["kind", "entity"]).groupBy("doc_id").agg(
        F.to_json(F.collect_set(F.struct("kind", "entity", "attempt"))).alias("_drawn")
    )
    # The rows of documents with an entity that drew again are few; Spark sends them to the texts while small.
    per_doc = cut_lineage(per_doc, "drawn_by_doc").withColumnRenamed("doc_id", "_of_doc")
    joined = docs.join(per_doc, F.coalesce(docs[doc_id].cast("string"), F.lit("")) == F.col("_of_doc"), "left")

    def make(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import json

        for texts, drawn in batches:
            rows = []
            for value, given in zip(texts, drawn, strict=True):
                table = {(x["kind"], x["entity"]): x["attempt"] for x in json.loads(given)} if given else {}
                rows.append(replace(value, key, table))
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(("text", "kinds", "begins", "ends"))})

    udf = F.pandas_udf(make, "text string, kinds array<string>, begins array<long>, ends array<long>")
    return joined.withColumn(into, udf(F.col(text), F.col("_drawn"))).drop("_drawn", "_of_doc")


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_entities, kinds`` of every row."""
    made = pseudonymise(docs.select("doc_id", "text"), key)
    return made.select(
        "doc_id", F.col("surrogates.text").alias("text"), F.size("surrogates.kinds").alias("n_entities"),
        F.array_join("surrogates.kinds", ",").alias("kinds"),
    )


__all__ = ["attempts", "entities", "find", "pseudonymise", "replace", "replaced", "surrogate"]
