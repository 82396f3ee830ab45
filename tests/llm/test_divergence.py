"""Distances of sources against a plain version in Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from veilmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, v int, digest string, p long"


def brute(rows, least=3, top=200):
    docs = defaultdict(list)
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        docs[r[2] or ""].append((r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang, texts in docs.items():
        df = Counter(t for _, words in texts for t in set(words))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for source, words in texts:
            counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())
        p = {
            s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in [*counts.items(), (None, whole)]
        }
        for s in counts:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in counts if x != s]
            terms = [(t, (p[s][t] - p[None][t]) ** 2 // p[None][t]) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                ranked = ranked if part == "pair" else ranked[:top]
                out += [repr((lang, s, part, item, value, k + 1)) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("few", [0, divergence.FEW_REPEATED])
def test_audit_matches_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(divergence, "FEW_REPEATED", few)
    monkeypatch.setattr(divergence, "HELD", 40 if few else divergence.HELD)
    rnd = random.Random(3)
    words = ["the", "The", "é", "Été", "a-b", "don't", "x1y", "漢字", "zz"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(0, None, "en", "a"), (1, "", "en", None), (2, "12 !", "xx", "only"), (3, "word word", "yy", "a"), (4, "other", "yy", "b")]
    for i in range(200):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(30)))
        rows.append((5 + i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None, "ü"])))
    rows += [(300 + i, "the same text, again THE same", "en", rnd.choice("abc")) for i in range(50)]
    rows.append((999, " ".join(rnd.choice(words) for _ in range(20000)), "de", "long"))
    docs = spark.createDataFrame([(*r, "t", 1, 1, "d", 1) for r in rows], SCHEMA).repartition(4)
    got = divergence.audit(docs)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)
    few = divergence.audit(docs, top=2)
    assert few.where("part = 'term'").groupBy("lang", "source").count().agg({"count": "max"}).first()[0] == 2


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
