"""Licences: templates, notices and findings."""

import random

import pytest

from lodestrata.llm import licenses as L


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bit_parallel_distance_and_tree_match_brute_force():
    rng = random.Random(1)
    words = lambda n: tuple(rng.choice("abcdef") for _ in range(rng.randint(0, n)))
    stored = [words(9) for _ in range(80)]
    tree = L.MetricTree()
    for w in stored:
        tree.add(L.Pattern(w), frozenset([w]))
    for _ in range(60):
        q, bound = words(9), rng.randint(0, 4)
        assert all(L.Pattern(w).distance(q) == edit_distance(w, q) for w in stored[:10])
        got = sorted(next(iter(v)) for _, _, v in tree.within(q, bound))
        assert got == sorted(w for w in stored if edit_distance(w, q) <= bound)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Apache License, Version 2.0", "apache-2"), (" ASL 2.0", "apache-2"), ("GPL-3.0-OR-LATER", "gpl-3"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("Expat (MIT)", "mit"),
        ("MIT OR Apache-2.0", "apache-2|mit"), ("(MIT/ISC)", "isc|mit"), ("New BSD License", "bsd-3"), ("Simplified BSD License", "bsd-2"), ("NOASSERTION", ""), ("see terms", ""), ("", ""), ("LicenseRef-Proprietary", "proprietary"),
        ("GPLv2", "gpl-2"), ("GNU Affero General Public License version 3", "agpl-3"), ("Eclipse Public License 2.0", "epl-2"), ("other", ""),
    ],
)
def test_declared_values(text, want):
    assert "|".join(sorted(L.expression(text))) == want


@pytest.mark.parametrize(
    "text, language, want",
    [
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\nclass A {}", "java", [{"mit", "apache-2"}]),
        ("#!/usr/bin/env python3\n# Copyright (c) 2020 X\n# You may use, change and pass on this file only as far as\n# the MIT License\n# allows it; there is no warranty.\n", "python", [{"mit"}]),
        ('"""\nLicense: BSD 3-Clause\n"""\nx = "SPDX-License-Identifier: MIT"', "python", [{"bsd-3"}]),
        ("/*\n * Copyright X. All rights reserved.\n * See the LICENSE file at the top for the terms.\n */", "go", []),
        ("// We dropped the GPL dependency in spring.", "go", []),
        ('const s = "// License: MIT";', "javascript", []),
        ("// License: MIT\nint a;\n// License: ISC", "java", [{"mit"}, {"isc"}]),
        ("", "java", []),
    ],
)
def test_notices(text, language, want):
    assert {frozenset(w) for w in want} == L.file_licences(text, language)


FILES = "file_id bigint, project string, relative string, language string, content string, one string, n int, sets string"


def test_findings(spark):
    f = lambda i, p, c: (i, p, "a.java", "java", c, "x", 1, "x")
    mit = "// License: MIT\n"
    files = [f(1, "m", mit), f(2, "m", "// License: ISC\n"), f(3, "m", ""), f(4, "none", ""), f(5, "none", mit), f(6, "two", "int a;"), f(7, "two", mit + "\nint a;\n// License: ISC\n"), f(8, "m", None), f(1, "m", mit), f(9, None, "int a;"), f(10, "dual", mit)]
    declared = [("m", "MIT", None), ("m", " mit", None), ("m", "see terms", "nothing here"), ("two", "MIT", None), ("two", "FILE", "The owners place this work under the ISC licence. Thanks."), ("dual", "MIT OR ISC", None), (None, "MIT", None), ("only", None, None)]
    packages = [("p1", ["MIT", "Expat"]), ("p1", None), ("p2", ["MIT"]), ("p2", ["ISC"]), ("p3", []), ("p4", None), (None, ["MIT"])]
    got = L.licence_findings(
        spark.createDataFrame(files, FILES), spark.createDataFrame(declared, "project string, value string, license_text string"), spark.createDataFrame(packages, "node string, licenses array<string>")
    ).collect()
    assert {tuple(r) for r in got} == {
        ("repo", "two", "conflict"), ("repo", "none", "unknown"), ("repo", "only", "unknown"), ("package", "p2", "conflict"), ("package", "p3", "unknown"), ("package", "p4", "unknown"),
        ("file", "2", "conflict"), ("file", "4", "unknown"), ("file", "6", "unknown"), ("file", "7", "conflict"), ("file", "9", "unknown"),
    }


def test_empty(spark):
    none = L.licence_findings(spark.createDataFrame([], FILES), spark.createDataFrame([], "project string, value string, license_text string"), spark.createDataFrame([], "node string, licenses array<string>"))
    assert none.count() == 0


def _as_comment(text, width, rng, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words) // 2, len(words))] = rng.choice(["ACME", "Foo", "the", "Contributors"])
    lines, line = ["Copyright (c) 2019-2023 ACME Works and others.", ""], ""
    for w in words:
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "/*\n" + "\n".join(f" * {x}" for x in [*lines, line]) + "\n */\nint a;\n"


def test_standard_texts_with_changed_holders_and_wrapping():
    rng = random.Random(2)
    right = wrong = n = 0
    for family, texts in L.BODIES.items():
        for text in texts:
            for width, changes in ((60, 0), (78, 0 if len(text.split()) < 40 else 2), (100, len(text.split()) // 25)):
                n += 1
                got = L.file_licences(_as_comment(text, width, rng, changes), "java")
                right += got == {frozenset([family])}
                wrong += bool(got - {frozenset([family])})
    assert len(L.BODIES) + len(set(L.MORE_NAMES) - set(L.BODIES)) > 45
    assert right / n > 0.95 and wrong / n < 0.02, (right, wrong, n)


def test_whole_licence_file_and_other_prose():
    mit = "MIT License\n\nCopyright (c) 2020 X\n\n" + L.BODIES["mit"][0].replace(". ", ".\n\n").replace("DEALINGS", "USES")
    assert L.text_licences(mit.split("\n")) == {frozenset(["mit"])}
    bsd = L.BODIES["bsd-3"][0].replace("the copyright holder nor", "Foo Bar Inc nor")
    assert L.text_licences(["Some library.", "", *bsd.split(". "), "", "Other remarks."]) == {frozenset(["bsd-3"])}
    assert L.text_licences(["Everyone may read the terms and the conditions of use in the portal."] * 50) == set()


def test_prefilter_lets_every_template_through():
    for text in [n.format(x) for n in L.NOTICES for names in (L.NAMES | L.MORE_NAMES).values() for x in names] + list(L.WHOLE) + [t for ts in L.BODIES.values() for t in ts]:
        assert L._SIGNAL.search(text), text


def test_more_declared_values():
    for text, want in [("MPL-1.1", "mpl-1.1"), ("LGPL-2.0", "lgpl-2"), ("GPL-1.0", "gpl-1"), ("0BSD", "0bsd"), ("CC-BY-4.0", "cc-by-4"), ("PSF-2.0", "psf-2"), ("Artistic-2.0", "artistic-2"), ("GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2"), ("Apache-2.0 WITH LLVM-exception", "apache-2")]:
        assert "|".join(L.expression(text)) == want, text
