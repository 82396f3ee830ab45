"""Names mentioned again, longer names, IPv6 addresses and IBANs."""

import ipaddress

from veilmill.llm import surrogates

KEY = b"0123456789abcdef"


def shown(text):
    return [(k, text[b:e]) for k, b, e, _ in surrogates.mentions(text)]


def test_names_are_followed_through_a_text():
    text = "Smith came. Mr. John Smith came; John's car, SMITH's dog and smith work. Mrs. Anna Maria Lopez Garcia and Garcia"
    assert [x for _, x in shown(text)] == ["Smith", "John Smith", "John", "SMITH", "Anna Maria Lopez Garcia", "Garcia"]
    made = surrogates.replace(text, KEY, {})[0]
    last = made.split(" ")[0]
    assert f"{last} came;" in made and f"{last.upper()}'s dog and smith work" in made
    assert made.endswith(f"{made.split(' and ')[-2].split(' ')[-1]} and {made.split(' ')[-1]}")
    assert not any(x in made for x in ("Smith", "John", "Lopez", "Garcia"))


def test_titles_without_a_name():
    for text in ("Dr. Will you come?", "Miss the bus", "Mr. The", "Sir"):
        assert shown(text) == [] and surrogates.replace(text, KEY, {})[0] == text
    assert shown("Mr. Dr. Smith")[-1] == ("person", "Smith")


def test_ibans_keep_country_form_and_check_digits():
    text = "to GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432, not GB83 WEST 1234 5698 7654 32"
    assert [k for k, _ in shown(text)] == ["iban", "iban"]
    made, _, begins, ends = surrogates.replace(text, KEY, {})
    one, two = (made[b:e] for b, e in zip(begins, ends, strict=True))
    assert one.replace(" ", "") == two != "GB82WEST12345698765432" and two.startswith("GB")
    assert surrogates._iban_rest(two) == 1 and [len(x) for x in one.split(" ")] == [4, 4, 4, 4, 4, 2]
    # What is no IBAN may hold another entity.
    assert shown("AB12 4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]


def test_ipv6_in_any_form_is_one_entity():
    text = "2001:db8::ff00:42:8329 2001:0db8:0000:0000:0000:ff00:0042:8329 at 12:30:45, std::vector ::1 a::b 1::2::3"
    assert [k for k, _ in shown(text)] == ["ipv6", "ipv6"]
    made, _, begins, ends = surrogates.replace(text, KEY, {})
    one, two = (ipaddress.IPv6Address(made[b:e]) for b, e in zip(begins, ends, strict=True))
    assert one == two != ipaddress.IPv6Address("2001:db8::ff00:42:8329") and "::" in made[begins[0] : ends[0]]
    assert made.endswith("at 12:30:45, std::vector ::1 a::b 1::2::3")


def test_many_names_in_one_long_text():
    names = ["Q" + "".join("abcdefghij"[int(d)] for d in str(i)) + "x" for i in range(2000)]
    text = " ".join(f"Mr. {n} and {n}." for n in names)
    found = shown(text)
    assert [x for _, x in found] == [n for n in names for _ in "ab"]
    made = surrogates.replace(text, KEY, {})[0]
    assert all(a == b.rstrip(".") for a, b in zip(made.split(" ")[1::4], made.split(" ")[3::4], strict=True))
