"""Redraws of surrogates come to an end."""

from veilmill.llm import surrogates

KEY = b"0123456789abcdef"


def test_masked_and_short_secrets_end(spark):
    texts = ["password=*** x", "password=... x", "password=AKIA x", *(f"password={d} x" for d in range(10)), "_@a.com", *(f"_@{chr(97 + i)}.com" for i in range(26))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = surrogates.find("password=*** and password=7")
    assert [k for k, _, _ in found] == ["secret"]
    got = {r.doc_id: r.text for r in surrogates.replaced(docs, KEY).collect()}
    assert got[0] == texts[0] and got[1] == texts[1]
    secrets = [got[i].split()[0] for i in range(2, 13)]
    assert len(set(secrets)) == 11 and not set(secrets) & {t.split()[0] for t in texts}
    mails = {got[i] for i in range(14, 40)}
    assert len(mails) == 26 and not mails & set(texts)
