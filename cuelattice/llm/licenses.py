"""License notices found by conditional compression.

Blocks of lines that a cue word marks are compressed with zstandard, alone and with each notice as raw dictionary; how much of
the notice's own compressed size a block saves ranks the notices. Those that save enough are confirmed by exact wording: the
notice's and the block's words are aligned, and what is missing or put in between must be little and must not be a word that decides
which license it is. Declarations in a line (tags, "License: ...", "under the ... license") are notices too, made for the names that a block holds.

Defined cases: null and empty texts have no blocks; a document may have several notices, each reported with its place; the
same notice twice in a block is reported once; repeated rows keep a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flushed, rows_of

# Wordings of public license notices, by SPDX identifier.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "Released under the terms of the MIT License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
# Names under which licenses are declared in a line, by SPDX identifier; those of the GNU family follow a rule.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "MIT/X11", "Expat"),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache 2", "Apache v2", "Apache License 2.0", "Apache License v2.0", "Apache License, Version 2.0", "Apache Software License 2.0"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause", "2-clause BSD", "simplified BSD"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause", "3-clause BSD", "new BSD", "modified BSD"),
    "ISC": ("ISC",),
    "Zlib": ("Zlib", "zlib/libpng"),
    "Unlicense": ("Unlicense",),
    "BSL-1.0": ("BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0", "MPL v2", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "Mozilla Public License, version 2.0"),
    "EPL-1.0": ("EPL-1.0", "EPL 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("EPL-2.0", "EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"),
    "Artistic-2.0": ("Artistic-2.0", "Artistic License 2.0"),
    "WTFPL": ("WTFPL",),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0", "CC0"),
    "CC-BY-4.0": ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    **{
        f"{short}-{v}": tuple(n for w in (v, v.removesuffix(".0")) for n in (f"{short}-{v}", f"{short}-{v}-only", f"{short}-{v}-or-later", f"{short}-{v}+", f"{short} {w}", f"{short}v{w}", f"{short} v{w}", f"{short} version {w}", *(f"GNU {x}" for x in (f"{short} v{w}", f"{short}v{w}", f"{short} {w}")), f"{full} {w}", f"{full} v{w}", f"{full} version {w}", f"{full}, version {w}"))
        for short, full, versions in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",)))
        for v in versions
    },
}
#: How a line declares a license by name; names that end with a license word of their own take no other.
DECLARED = ("License: {n}", "Licensed under {n}", "under the {n} license", "under an {n} license", "under a {n} license", "under the terms of the {n} license", "under the terms of the {n}", "under the {n}", "licensed as {n}", "{n} licensed", "License: {n} license")
_TAG = re.compile(r"spdx-license-identifier\s*:\s*([^\n]*?[A-Za-z0-9.+)-])(?=[^A-Za-z0-9.+()-]*(?:\n|$))", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[A-Za-z0-9.+-]+")
_BARE = re.compile(r"^(?:mit|isc|zlib|expat|unlicense|cc0|new bsd|modified bsd|simplified bsd)$")
CUES = re.compile(r"licen[cs]|copyright|©|permission|redistribut|warrant|public domain|creative commons|unencumbered|\bcc[ -]?by|\bcc0|spdx", re.IGNORECASE)
#: Lines without a cue that may lie within a block.
GAP_LINES = 2
#: Characters around a cue that make up its block at least, where a line is longer than twice that; more where a notice is that long.
REACH = 1200
#: Longest line that may be part of a wrapped notice without a cue of its own.
WRAPPED = 100
#: Least share of a notice's compressed size that a block must save. In long blocks a short notice saves little; wording decides.
MIN_SAVED = 0.15
MAX_MISSING, MAX_ADDED = 0.1, 0.15
_WORD = re.compile(r"\w+(?:[.'-]\w+)*")
_DECISIVE = re.compile(r"\d|^(?:not|no|non|nc|nd|sa|by|by-\w+|lesser|affero|noncommercial|sharealike|noderivatives|mit|apache|gnu|mozilla)$")
_REMEMBERED = 20_000


@dataclass(frozen=True)
class Finding:
    license: str
    saved: float
    missing: tuple[str, ...]
    added: tuple[str, ...]
    start: int
    end: int


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


class Scanner:
    """Notices prepared for comparison; blocks seen before are remembered, up to a number."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, level: int = 9) -> None:
        frame = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        make = lambda d=None: zstandard.ZstdCompressor(dict_data=d, compression_params=zstandard.ZstdCompressionParameters.from_level(level, **frame))
        self.alone, self.make = make(), make
        self.prepared: dict[str, tuple] = {}
        self.notices = [(name, *self._prepared(text)) for name, text in notices]
        quoted = {name: [re.escape(_plain(n)) for n in names] for name, names in NAMES.items()}
        self.named = {name: re.compile(rf"(?<![\w-])(?:{'|'.join(sorted(q, key=len, reverse=True))})(?![\w-]|\.\d)") for name, q in quoted.items()}
        # no word of a notice is farther from the notice's cue
        self.reach = max([REACH, *(3 * len(text) // 2 for _, text in notices)])
        self.seen: dict[str, list[Finding]] = {}

    def _prepared(self, text: str) -> tuple[list[str], int, zstandard.ZstdCompressor]:
        """Words of a wording, its compressed size, and a compressor that knows it."""
        plain = _plain(text)
        if plain not in self.prepared:
            if len(self.prepared) >= _REMEMBERED:
                self.prepared.clear()
            raw = plain.encode("utf-8", "replace")
            known = zstandard.ZstdCompressionDict(raw if len(raw) >= 8 else raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.prepared[plain] = _WORD.findall(plain), len(self.alone.compress(raw)), self.make(known)
        return self.prepared[plain]

    def declarations(self, block: str) -> list[tuple]:
        """Wordings by which a block may declare a license in a line: those of the names that occur in it, and its tags as they stand."""
        plain, found = _plain(block), []
        for name, pattern in self.named.items():
            for alias in {m[0] for m in pattern.finditer(plain)}:
                # a name without a number is a common word too, so it needs the word license beside it
                forms = [f for f in DECLARED if "licen" in f.replace("{n}", "")] if _BARE.match(alias) else DECLARED
                found += [(name, *self._prepared(f.format(n=alias))) for f in forms]
        for tag in _TAG.finditer(block):
            told = [i.lower() for i in _IDENTIFIER.findall(tag[1])]
            found += [(name, *self._prepared(tag[0])) for name in NAMES if any(i in (n.lower() for n in NAMES[name]) for i in told)]
        return found

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of candidate blocks, disjoint and in order: a cue's line and short lines next to it."""
        now: tuple[int, int] | None = None
        for cue in CUES.finditer(text):
            start, end = text.rfind("\n", 0, cue.start()) + 1, text.find("\n", cue.end())
            before = text.rfind("\n", 0, max(0, start - 1)) + 1
            if 0 < start - before <= WRAPPED:  # a notice may be wrapped, so short lines before and after belong to the block
                start = before
            if end >= 0:
                after = text.find("\n", end + 1)
                after = len(text) if after < 0 else after
                if after - end <= WRAPPED:
                    end = after
            start = max(start, cue.start() - self.reach)
            end = min(len(text) if end < 0 else end, cue.end() + self.reach)
            if now and (start <= now[1] or text.count("\n", now[1], start) <= GAP_LINES + 1 and start - now[1] <= self.reach):
                now = (now[0], max(end, now[1]))
            else:
                if now:
                    yield now
                now = (start, end)
        if now:
            yield now

    def findings(self, block: str) -> list[Finding]:
        """All notices in a block, each with its own place in it; a notice that occurs again is found again."""
        if block in self.seen:
            return self.seen[block]
        plain, placed = _plain(block), list(_WORD.finditer(block))
        raw, words = plain.encode("utf-8", "replace"), [m[0].lower() for m in placed]
        size = len(self.alone.compress(raw))
        notices = [*self.notices, *self.declarations(block)]
        ranked = sorted((((size - len(with_it.compress(raw))) / own, k) for k, (_, _, own, with_it) in enumerate(notices)), reverse=True)
        found: list[Finding] = []
        for saved, k in ranked:
            if saved < MIN_SAVED:
                break
            name, wanted, _, _ = notices[k]
            left = list(words)
            while (differs := self._wording(wanted, left)) is not None:
                missing, added, first, last = differs
                start, end = placed[first].start(), placed[last - 1].end()
                if not any(f.license == name and f.start < end and start < f.end for f in found):
                    found.append(Finding(name, round(saved, 4), missing, added, start, end))
                left[first:last] = [""] * (last - first)
        found.sort(key=lambda f: (f.start, f.license))
        if len(self.seen) >= _REMEMBERED:
            self.seen.clear()
        self.seen[block] = found
        return found

    @staticmethod
    def _wording(wanted: list[str], words: list[str]) -> tuple[tuple[str, ...], tuple[str, ...], int, int] | None:
        """Words missing from the notice, words put between its own, and the place of both in ``words``, if they may differ so."""
        same = [m for m in difflib.SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        missing: list[str] = []
        added: list[str] = []
        at_wanted, at_words = 0, same[0].b
        for m in same:
            missing += wanted[at_wanted : m.a]
            added += words[at_words : m.b]
            at_wanted, at_words = m.a + m.size, m.b + m.size
        missing += wanted[at_wanted:]
        if len(missing) > MAX_MISSING * len(wanted) or len(added) > MAX_ADDED * len(wanted) or any(map(_DECISIVE.search, missing + added)):
            return None
        return tuple(missing), tuple(added), same[0].b, at_words


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """``(id_col, n_blocks, findings array<struct<license,start,end,saved,missing,added>>)`` for each row; places in characters."""
    bounded_batches(docs.sparkSession)
    texts = pa.list_(pa.string())
    found = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.float64()), ("missing", texts), ("added", texts)]))
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("findings", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)

        def each() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                places = list(scanner.blocks(text or ""))
                yield doc_id, len(places), [{"license": f.license, "start": a + f.start, "end": a + f.end, "saved": f.saved, "missing": list(f.missing), "added": list(f.added)} for a, b in places for f in scanner.findings(text[a:b])]

        return flushed(out, each())

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    kind = "array<struct<license:string,start:int,end:int,saved:double,missing:array<string>,added:array<string>>>"
    return read.mapInArrow(run, f"id long, n long, findings {kind}").select(F.col("id").alias(id_col), F.col("n").alias("n_blocks"), "findings")
