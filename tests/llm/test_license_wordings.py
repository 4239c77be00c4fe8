"""License wordings that were not looked at while the scan was written: names, clauses, exceptions, denials and layouts."""

from __future__ import annotations

import textwrap

import pytest

from tradelake.llm import license_scan, license_texts

SCANNER = license_scan.Scanner()
TWO, THIRD, AD = license_texts._TWO_CLAUSES, license_texts._THIRD_CLAUSE, license_texts._AD_CLAUSE
MIT = license_scan.TEMPLATES[2][1]


def confirmed(text):
    return [x["license"] for x in SCANNER.scan(text) if x["confirmed"]]


def wrapped(text, width=78):
    return "Copyright (c) 2019, Example Widgets, Inc.\nAll material here belongs to it.\n\n" + textwrap.fill(text, width, break_on_hyphens=False) + "\n\nint main;\n"


COMPANY = THIRD.replace("the copyright holder", "Example Widgets, Inc.")
LISTED = TWO.replace("Redistributions of source", "\n\n1. Redistributions of source").replace("Redistributions in binary", "\n\n2. Redistributions in binary")


@pytest.mark.parametrize(
    ("text", "name"),
    [
        (wrapped(TWO), "BSD-2-Clause"),
        (wrapped(TWO + THIRD), "BSD-3-Clause"),
        (wrapped(TWO + COMPANY), "BSD-3-Clause"),
        (wrapped(TWO + COMPANY, 60), "BSD-3-Clause"),
        (TWO + COMPANY, "BSD-3-Clause"),
        (LISTED + "\n\n3." + COMPANY, "BSD-3-Clause"),
        (wrapped(TWO + AD + THIRD), "BSD-4-Clause"),
        (wrapped(TWO + AD.replace("the organization", "Example Widgets") + COMPANY), "BSD-4-Clause"),
        (wrapped(MIT, 50), "MIT"),
        (wrapped(MIT.replace("free of charge", "gratis")), "MIT"),
        ("Content available under CC BY 4.0", "CC-BY-4.0"),
        ("Content available under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
        ("Released under the Modified MIT License", None),
        ("MIT License with the Commons Clause", None),
        ("Licensed under the MIT License with the Commons Clause.", None),
        ("Licensed under the BSD 3-Clause Clear License.", None),
        ("BSD 3-Clause Clear License", None),
        ("Do not assume that this file is licensed under the MIT License", None),
        ("It is no longer in any way, licensed under the MIT License.", None),
        ("This was previously licensed under the Apache License, Version 2.0.", None),
        ("Formerly released under the MIT License.", None),
        ("Neither this file nor that one is licensed under the Apache License, Version 2.0.", None),
        ("Licensed under the GNU General Public License, version 2 or later, with the Classpath exception", None),
        ("Licensed under the Apache License, Version 2.0, with LLVM exceptions.", None),
        ("Licensed under the Apache License, Version 2.0 with additional restrictions.", None),
        ("Licensed under the Mozilla Public License, version 2.0. With thanks to all, see the exceptions list.", "MPL-2.0"),
        ("Licensed under the Apache License, Version 2.0.\nExceptions are listed below with the clause.", "Apache-2.0"),
        ("This is not new.\nReleased under the MIT License.", "MIT"),
        ("We do not know why\nReleased under the MIT License.", "MIT"),
        ("this file, which nobody should think is not\nlicensed under the MIT License", None),
        ("LICENSED UNDER THE MIT LICENSE.", "MIT"),
        ("Released under the\n    MIT License.", "MIT"),
        ("Licensed under the GNU General Public License, version 3 or later.", "GPL-3.0"),
        ("Licensed under the GNU Library Public License, version 3 or later.", None),
        ("Licensed under the Apache Software License, Version 2.0.", "Apache-2.0"),
        ("Licensed under the Academic Free License, Version 2.0.", None),
        ("Licensed under the Eclipse Public License, version 2.0.", None),
        ("Licensed under CC BY-NC 4.0 with no further conditions of any kind known.", None),
        ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", None),
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("SPDX-License-Identifier: MIT-Modern-Variant", None),
        ("All rights reserved.", "all-rights-reserved"),
        ("Not all rights reserved.", None),
    ],
)
def test_wordings(text, name):
    assert confirmed(text) == ([name] if name else []), [(x["license"], x["confirmed"], x["changes"]) for x in SCANNER.scan(text)]


def test_decision_against_all_templates():
    """A confirmed passage has, among all templates whose whole wording is tried on it word for word, none with fewer differences."""
    for i, (name, wording) in enumerate(license_scan.TEMPLATES):
        found = [x for x in SCANNER.scan("Title\n\n" + textwrap.fill(wording, 70, break_on_hyphens=False) + "\n\nprose of the day\n") if x["confirmed"]]
        assert [x["license"] for x in found] == [name], (i, found)
        text = "Title\n\n" + textwrap.fill(wording, 70, break_on_hyphens=False) + "\n\nprose of the day\n"
        passage = text[found[0]["start"] : found[0]["end"]]
        differences = [len(SCANNER.differences(passage, k)[1]) for k in range(len(license_scan.TEMPLATES))]
        assert found[0]["n_changes"] == min(differences)
