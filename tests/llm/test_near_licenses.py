"""Licenses that differ in a word or a clause."""

import random

import pytest

from veilmill.llm import licenses

KNOWN = licenses.all_templates()
WHOLE = licenses._whole()


def names(text):
    return [x[0] for x in licenses.scan(text, KNOWN)]


@pytest.mark.parametrize(("text", "want"), [
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
    ("Licensed under CC BY-NC 2.5.", []),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("Released under the ISC License.", ["ISC"]), ("Released under the Foo License.", []),
    ("Licensed under the Apache License, Version 1.1.", []),
    (licenses.SHORT["MIT"][:180], []),
])
def test_notices(text, want):
    rnd = random.Random(1)
    around = " ".join(f"w{rnd.randrange(500)}x" for _ in range(90))
    assert names(text) == want and names(f"{around}\n{text}\n{around}") == want


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_texts(name):
    rnd = random.Random(2)
    words = WHOLE[name].split()
    for _ in range(len(words) // 50):
        words[rnd.randrange(len(words))] = "changed" if name not in licenses.TELLING else words[0]
    text = f"Copyright 2020 somebody\n{WHOLE[name]}\nend"
    assert names(text)[0] == name
    if name not in licenses.TELLING:
        assert names(" ".join(words))[0] == name


def test_relatives_of_whole_texts():
    known = licenses.all_templates()
    whole = licenses._whole()
    for name, old, new in (("GPL-3.0", "General", "Affero General"), ("LGPL-2.1", "Lesser", "Library")):
        text = whole[name]
        assert name in [x[0] for x in licenses.scan(text, known)]
        assert name not in [x[0] for x in licenses.scan(text.replace(old, new), known)]
    clause = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement. "
    four = whole["BSD-3-Clause"].replace("Neither", clause + "Neither", 1)
    assert four != whole["BSD-3-Clause"] and "BSD-3-Clause" not in [x[0] for x in licenses.scan(four, known)]


def test_short_notices_and_identifiers():
    known = licenses.all_templates()
    for text, name in (
        ("This package is distributed under the MIT License.", "MIT"), ("under the Apache 2.0 license", "Apache-2.0"),
        ("// SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"), ("# SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"),
        ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
    ):
        assert [x[0] for x in licenses.scan(f"some words before\n{text}\nand after", known)] == [name]
    assert licenses.scan("under the license of the city, and under the MIT dome", known) == []
