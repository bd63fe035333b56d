"""Licenses declared by name: wordings as they are met in the wild, none of them made from the scanner's own notices."""

import pytest

from cuelattice.llm import licenses

FOUND = [
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "MIT,Apache-2.0"),
    ("License: Apache 2.0", "Apache-2.0"),
    ("License: EPL-2.0", "EPL-2.0"),
    ("License: BSD-3-Clause", "BSD-3-Clause"),
    ("This project is available under the MIT license", "MIT"),
    ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("The code is distributed under the terms of the GNU General Public License v3.0.", "GPL-3.0"),
    ("Distributed under the GNU GPL v2 license, see COPYING.", "GPL-2.0"),
    ("Contents are licensed under CC BY-SA 4.0 unless stated otherwise.", "CC-BY-SA-4.0"),
    ("Copyright (c) 2019 A. Author. MIT licensed.", "MIT"),
    ("This crate is licensed under the MPL 2.0.", "MPL-2.0"),
    ("Released under the ISC license by its authors", "ISC"),
    ("The font comes under a 3-clause BSD license.", "BSD-3-Clause"),
    ("You can use it under the terms of the Mozilla Public License 2.0", "MPL-2.0"),
    ("Licence: see below.\nThis is free to use under the Eclipse Public License 2.0.", "EPL-2.0"),
    ("All data here is under the CC0 license", "CC0-1.0"),
    ("Published under the GNU Affero General Public License, version 3", "AGPL-3.0"),
]
CLEAN = [
    "She studied at MIT and kept the copyright of her thesis.",
    "License: see the LICENSE file in the root directory.",
    "The driving license was renewed under the new rules.",
    "Apache helicopters need permission to land at 2.0 km.",
    "Copyright 2020 The Authors. All rights reserved.",
    "The licence fee is under review, version 3 of the report says.",
    "zlib is used for compression; permission denied errors were fixed.",
    "He sold two licenses: one to MIT, one to the GNU project.",
]


@pytest.mark.parametrize(("text", "names"), FOUND)
def test_declared(text, names):
    scanner = licenses.Scanner()
    got = {f.license for a, b in scanner.blocks(text) for f in scanner.findings(text[a:b])}
    assert got == set(names.split(","))
    long = "Plain words come first here. " * 200 + "\n" + text + "\n" + "And plain words come after it. " * 200
    places = [(a + f.start, a + f.end) for a, b in scanner.blocks(long) for f in scanner.findings(long[a:b])]
    assert places and all(6000 > long.index(text) - 1 >= 0 and long.index(text) <= a < b <= long.index(text) + len(text) for a, b in places)


@pytest.mark.parametrize("text", CLEAN)
def test_not_declared(text):
    scanner = licenses.Scanner()
    assert [f for a, b in scanner.blocks(text) for f in scanner.findings(text[a:b])] == []
