"""The operators against brute force, and on nulls, empty and long texts, repeats, ties, no rows and clashing columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from veilmill.llm import ann, bpe, langid, licenses, linechunks, mixing, quality, rules, simhash, surrogates
from veilmill.llm.graph import components

KEY = b"0123456789abcdef"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, list int"


def prose(n, seed=0, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage = "\n".join(prose(9, s) for s in range(900, 912))
    texts = [None, "", " \n\t", "one", prose(60, 1), prose(60, 1), prose(60, 1) + " more", prose(9000, 2), prose(80, 3),
             f"{prose(8, 4)}\n{passage}\n{prose(8, 5)}", f"{prose(8, 6)}\n{prose(8, 7)}\n{passage}", "don't 12 ²½ é漢　x<|endoftext|> y"]
    out = [(i, t, ["en", "de", None][i % 3], [None, "a", "b"][i % 3], len(t or ""), 0.0, "x", 1) for i, t in enumerate(texts)]
    return [*out, out[4], (None, prose(60, 8), "en", "a", 0, 0.0, "x", 1), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_matches_library(spark, docs, none, rows, tokenizer):
    path, library = tokenizer
    got = bpe.digests(docs, path).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.digests(none, path).count() == 0
    shared = bpe.broadcast_automaton(spark, path)
    both = bpe.decode(bpe.encode(docs, shared), shared)
    assert {(r.text or "") == r.decoded for r in both.collect()} == {True}


def test_automaton_on_random_strings(tokenizer):
    path, library = tokenizer
    coder, rnd = bpe.Coder(bpe.load_automaton(path)), random.Random(5)
    letters = "aabcdeehilnorstt  \n\t'.,0123²½Ⅷéß漢字नि\x1c\x85　😀<|>$$$"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    for text in [*texts, "a" * 3000, " " * 500, "x" * 9 + "<|endoftext|>" * 2]:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def brute_print(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(docs, none, rows):
    got = simhash.memberships(docs).collect()
    prints = [brute_print(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group = [group[j] if g == group[i] else g for g in group]
    ids = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    want = [(r[0], f"{p:016x}", ids[g]) for r, p, g in zip(rows, prints, group, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert simhash.memberships(none).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))


def test_tree_links_connect_like_all_pairs(spark):
    rnd = random.Random(1)
    prints = {rnd.getrandbits(64) for _ in range(300)}
    centre = rnd.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for _ in range(600)}
    signed = [p - (p >> 63 << 64) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for shard in (2048, 50):  # whole trees and split ones
        root = {r.node: r.root for r in components(simhash.links(frame, shard=shard)).collect()}
        for a in signed:
            for b in signed:
                if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                    assert root[a] == root[b]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0}


def test_rules_count_repeated_windows():
    rnd = random.Random(2)
    for _ in range(60):
        words = [b"%d" % rnd.randrange(3) for _ in range(rnd.randrange(80))]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        assert rules.repeated_words(words) == len(covered)


def test_rules_verdict_does_not_depend_on_order(docs, none, rows):
    one = {repr(r) for r in rules.verdicts(docs).collect()}
    other = rules.cascade(docs.select("doc_id", "text"), sorted(rules.RULES, reverse=True)).select("doc_id", "rules.*").drop("rejected_by")
    assert one == {repr(r) for r in other.collect()}
    assert rules.verdicts(docs).count() == len(rows) and rules.verdicts(none).count() == 0


def test_language(docs, none, rows):
    got = langid.predictions(docs).collect()
    assert len(got) == len(rows) and langid.predictions(none).count() == 0
    assert all((r.lang_pred == "und") == (r.score == 0) and 0 <= r.score <= 1 for r in got)
    content = {"aa": langid.letters_only(prose(3000, 1)), "bb": langid.letters_only("z".join(prose(3000, 2).split("w")))}
    classify = langid.Classifier(langid.Dictionaries(content, 6, 0.01))
    assert classify(prose(200, 9))[0] == "aa" and classify("12 34")[0] == "und" and classify(None)[0] == "und"


def test_quality(spark, docs, none):
    good = [(i, prose(50 + i, i)) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}###" for w in prose(50 + i, i).split())) for i in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality.predictions(table, labels).collect()}
    assert sum(got[i] == (i < 100) for i in got) >= 117
    assert {r.doc_id for r in quality.keep_good(table, labels).collect()} == {i for i, p in got.items() if p}
    scores = [r.score for r in quality.predictions(docs, labels.where("quality = 5")).collect()]
    assert set(scores) == {0.5} and quality.predictions(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_surrogates():
    text = "Mr. John Smith met Mrs. Smith at a.b@x.org, 10.2.3.4; call +1 (624) 555-2408, card 4111 1111 1111 1111"
    made, kinds, begins, ends = surrogates.replace(text, KEY, {})
    assert kinds == ["person", "person", "email", "ip", "phone", "card"]
    spans = [made[b:e] for b, e in zip(begins, ends, strict=True)]
    assert spans[0].split()[1] == spans[1]  # one last name
    card = spans[5].replace(" ", "")
    assert surrogates._check_digit(card[:-1]) == card[-1] and spans[4].startswith("+1 (")
    assert all(x not in made for x in ("Smith", "a.b@x.org", "10.2.3.4", "555-2408", "4111 1111"))
    assert surrogates.replace("nothing here", KEY, {})[0] == "nothing here" and surrogates.replace(None, KEY, {})[0] is None


def test_surrogates_stay_distinct(spark, docs, none, rows):
    names = [(i, f"Mrs. {n} Weber said") for i, n in enumerate(f"Ab{chr(97 + a)}{chr(97 + b)}" for a in range(6) for b in range(8))]
    got = surrogates.replaced(spark.createDataFrame(names, "doc_id long, text string"), KEY).collect()
    firsts = {r.text.split()[1] for r in got}
    assert len(firsts) == len(names) and len({r.text.split()[2] for r in got}) == 1
    same = {r.text for r in surrogates.replaced(docs, KEY).collect()}
    assert same == {r[1] for r in rows} and surrogates.replaced(none, KEY).count() == 0


def test_mixing(docs, none):
    got = mixing.mixture(docs, "s").collect()
    for r in got:
        assert 1 <= r.copy <= r.n_copies
    again = mixing.mixture(docs.repartition(3), "s").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(none, "s").count() == 0 and mixing.mix(docs, "s").columns == docs.columns


def test_mixing_meets_the_targets(spark):
    table = spark.range(8000).selectExpr("id as doc_id", "if(id < 6000, 'a', 'b') as source", "'t' as text")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("absent", 9.0)], "source string, weight double")
    counts = {r.source: r["count"] for r in mixing.mix(table, "s", weights).groupBy("source").count().collect()}
    assert abs(counts["a"] - 2000) < 200 and abs(counts["b"] - 6000) < 350


def brute_lines(rows):
    seen, want = {}, []
    version = {}
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    for null, i, text in order:
        lines, cut = linechunks.chunks(text)
        version[null, i, text] = cut, lines
        for k, (b, e, passage) in enumerate(cut):
            if passage:
                seen.setdefault("\n".join(lines[b:e]), (null, i, text, k))
    for r in rows:
        key = (r[0] is None, r[0] or 0, r[1] or "")
        cut, lines = version[key]
        gone = [k for k, (b, e, p) in enumerate(cut) if p and seen["\n".join(lines[b:e])] != (*key, k)]
        want.append((r[0], len(gone), None if r[1] is None else linechunks.without(r[1], gone)))
    return want


def test_line_chunks(docs, none, rows):
    got = linechunks.shortened(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_lines(rows)))
    assert sum(r.n_removed for r in got) >= 2 and linechunks.shortened(none).count() == 0
    assert linechunks.deduplicated(docs).drop("_n_removed").columns == docs.columns


def test_patience_alignment(docs, none, rows):
    known = licenses.templates(licenses.TEMPLATES)
    notice = "This work is licensed under the GNU General Public License, version 3."
    found = licenses.scan(f"{prose(500)}\n{notice}\n{notice}\n{prose(500, 1)}", known)
    assert [x[0] for x in found] == ["GPL-3.0"] and found[0][1] == 1.0
    assert licenses.scan(prose(2000), known) == [] and licenses.scan(None, known) == []
    text, template = list("xabcdey"), list("abzde")
    assert licenses.align(text, template) == [(1, 0), (2, 1), (4, 3), (5, 4)]
    assert licenses.matches(docs).count() == len(rows) and licenses.matches(none).count() == 0


def test_neighbours(spark):
    random_ = np.random.default_rng(3)
    x = random_.standard_normal((1500, 24))
    x[700:900] = x[5]  # one vector, many ids
    data = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    data += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (2080, [1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "'x' as ids", "1 as list")
    got = ann.neighbours(table).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    real = np.array([row for _, row in data[:1500]])
    hit = 0
    for q in range(0, 1500, 20):
        near = sorted(by.pop(q), key=lambda r: r.rank)
        assert [r.rank for r in near] == list(range(1, 21))
        assert near == sorted(near, key=lambda r: (-r.score, r.vec_id)) and q not in {r.vec_id for r in near}
        best = sorted((-s, i) for i, s in enumerate(real @ real[q]) if i != q)[:20]
        hit += len({i for _, i in best} & {r.vec_id for r in near})
        assert all(abs(r.score - real[q] @ real[r.vec_id]) < 1e-9 for r in near)
    assert not by and hit >= 0.9 * 75 * 20
    assert ann.neighbours(table.limit(0)).count() == 0
    assert ann.neighbours(table.where("vec_id < 5")).count() == 4


def brute_copies(rows, seed):
    """Each id as often as it draws, by the distribution function of its source's mean."""
    sizes = Counter(source for _, _, source in rows)
    whole = sum(math.sqrt(n) for n in sizes.values())
    out = []
    for i, text, source in rows:
        mean = math.sqrt(sizes[source]) / whole * len(rows) / sizes[source]
        u = int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = upto = math.exp(-mean)
        n = 0
        while upto <= u and n < mean + 10 * math.sqrt(mean) + 30:
            n += 1
            p *= mean / n
            upto += p
        out += [(i, text)] * n
    return out


def test_pipeline_equals_brute_force(spark, tokenizer):
    """All five stages: SimHash over all pairs, draws one by one and the library's tokens.

    The classifier's verdicts and the passages that go are taken from their operators, which have tests of their own.
    """
    import corpus_pipeline
    from veilmill.llm import passages
    from veilmill.llm.queries import SEED

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in quality.predictions(docs, labels).where("predicted = 1").collect()}
    sources = {r.doc_id: r.source for r in docs.collect()}
    cut = [(r.doc_id, r.text) for r in passages.shortened(docs.where(docs.doc_id.isin(good))).collect()]
    prints = [brute_print(t) for _, t in cut]
    group = list(range(len(cut)))
    for i in range(len(cut)):
        for j in range(i):
            if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    first = {}
    for (i, _), g in zip(cut, group, strict=True):
        first[g] = min(i, first.get(g, i))
    kept = [(i, t, sources[i]) for i, t in cut if i in set(first.values())]
    want = []
    for i, text in brute_copies(kept, SEED):
        ids = tokenizer[1].encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted(want)
    assert len(kept) > 0.6 * len(sources)
