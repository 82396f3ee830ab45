"""Repeated passages against all windows of lines."""

import random

from veilmill.llm import linechunks, passages


def line(rnd, n):
    return " ".join(f"w{rnd.randrange(9000)}x" for _ in range(n))


def kept_repeats(texts):
    """Places (text, line) whose lines, with 50 words or more, also stand in an earlier text."""
    seen, found = set(), []
    for t, text in enumerate(texts):
        lines = (text or "").split("\n")
        own = set()
        for b in range(len(lines)):
            words = 0
            for e in range(b, min(len(lines), b + 60)):
                words += len(lines[e].split())
                if words >= 50:
                    run = tuple(lines[b : e + 1])
                    if run in seen:
                        found.append((t, b, e))
                    own.add(run)
        seen |= own
    return found


def test_runs_in_other_surroundings_go(spark):
    rnd = random.Random(6)
    texts = [None, "", "one line"]
    for lines in (2, 3, 4, 6, 8, 12, 20):
        for _ in range(5):
            run = [line(rnd, rnd.randrange(26, 45) if lines < 4 else rnd.randrange(13, 30)) for _ in range(lines)]
            if lines > 4:
                run[2:2] = [""]
            for _ in range(3):
                around = [line(rnd, rnd.randrange(1, 40)) for _ in range(6)]
                texts.append("\n".join([*around[:3], *run, *around[3:]]))
    short = [line(rnd, 9) for _ in range(3)]
    texts += ["\n".join([line(rnd, 20), s, line(rnd, 20)]) for s in short for _ in range(2)]
    texts.append("\n".join([line(rnd, 10)] * 40))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, texts[3])], "doc_id long, text string")
    assert kept_repeats([linechunks.without(t, None) for t in texts])
    got = passages.shortened(docs).collect()
    by = {r.doc_id: r for r in got}
    after = [by[i].text for i in range(len(texts))]
    assert kept_repeats(after[:-1]) == []
    # Each line is still somewhere, first texts and short repeats are whole, one copy within a text stays whole.
    assert {x for t in texts if t for x in t.split("\n")} == {x for t in after if t for x in t.split("\n")} | {""}
    assert after[:4] == texts[:4] and after[-7:-1] == texts[-7:-1]
    assert len(after[-1].split("\n")) == 5 and by[len(texts) - 1].n_removed == 1
    assert len(got) == len(texts) + 2 and by[None].text == ""
    assert passages.deduplicated(docs).drop("_n_removed").columns == docs.columns
    assert passages.shortened(docs.limit(0)).count() == 0
    before = {r.doc_id: r.text for r in linechunks.shortened(docs).collect()}
    assert len(kept_repeats([before[i] for i in range(len(texts))][:-1])) > 50


def test_only_texts_with_repeats_are_exchanged(spark, monkeypatch):
    run = "\n".join(f"line {i} " + "word " * 9 for i in range(8))
    rows = [(1, run), (2, "own start\n" + run), (2, "own start\n" + run), (None, run + "\nown end"), (4, "alone"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = passages.deduplicated(docs)
    assert "left_anti" in made._jdf.queryExecution().analyzed().toString().lower().replace("leftanti", "left_anti")
    light = sorted(map(str, made.collect()))
    monkeypatch.setattr(passages, "LIGHT_KEYS", 0)
    assert sorted(map(str, passages.deduplicated(docs).collect())) == light
    assert sum(r._n_removed for r in made.collect()) == 3
