"""Language identification: letters, few labelled rows, many languages, excerpts."""

import random

import pytest

from veilmill.llm import langid


def text_of(lang, n, seed):
    rnd = random.Random(f"{lang}{seed}")
    letters = random.Random(lang).sample("abcdefghijklmnopqrstuvwxyz", 6)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 8))) for _ in range(n))


@pytest.mark.parametrize("text", ["½", "²³ 12", "①", "Ⅳ", "٣", "", None, "12 !"])
def test_numerals_are_no_letters(text):
    model = langid.Dictionaries({"aa": b"some words of it", "bb": b"other terms there"}, 6, 0.01)
    assert langid.Classifier(model)(text) == ("und", 0.0, 0.0, False)


def test_excerpts_come_from_the_whole_text():
    text = " ".join(chr(97 + k) * 40 for k in range(26)) * 4
    got = langid.excerpt(text, 3000, 5)
    assert 2500 < len(got) <= 3000 and len(set(got)) > 20
    assert langid.excerpt(text, 3000, 5) == got != langid.excerpt(text, 3000, 6)
    assert langid.excerpt("Short Text 1", 3000, 5) == b"short text"


def test_few_rows_share_a_whole_dictionary(spark):
    rows = [(i, text_of("aa", 4000, i), "aa") for i in range(10)] + [(100 + i, text_of("bb", 60, i), "bb") for i in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.content["aa"]) > 0.9 * langid.DICTIONARY_BYTES and len(model.content["bb"]) > 20_000
    assert list(model.content) == ["bb", "aa"]


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(i, text_of(f"l{i % 9}", 30, i), f"l{i % 9}" if i % 9 < 3 or i < 9 else "l0") for i in range(90)]
    got = langid.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 90 and {r.lang_pred for r in got} <= {"l0", "l1", "l2"}
