"""License scan by conditional compression.

Lines with a license cue, and the paragraphs around them, are candidate blocks.
A block is compressed alone and with each license template, of whose words it has
enough, as a raw zstandard dictionary; the templates are ranked by the bytes that
they save.  In this order each is confirmed by the exact differences in wording
between the template and the stretches of the block that start with one of its
first words: the words of the template that the stretch lacks and the words that
it adds in between, where placeholders may stand for versions, years and names.
A stretch is a hit if the differences are at most ``DIFFERENT`` of the template's
words and every key word is there.  Nothing is cut off by rank, since a short
notice saves little of a long block; of hits that overlap, the one whose stretch
the template makes smallest wins, and a block has all its winners.

Defined cases: null and empty texts have no hits; texts of any length are read
whole; of overlapping hits that save equally the one with fewer differences and
the smaller block stays; rows with null ids are
reported under null; repeated rows are reported each; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a template's words that may differ.
DIFFERENT = 0.15
#: Longest block looked at as one; longer paragraphs are cut into overlapping ones.
BLOCK_WORDS = 400

CUE = re.compile(rb"licen[cs]e|copyright|spdx|permission is hereby|redistribution and use|creative commons|\bcc[ -]by|\bcc0|public domain|warrant(?:y|ies)", re.I)
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*|\{\w\}")

# License notices.  {v} stands for a version, {y} for years and names.
TEMPLATES = {
    "AGPL-notice": "This work is licensed under the GNU Affero General Public License, version {v}.",
    "AGPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
    "Apache-notice": "Licensed under the Apache License, Version {v}.",
    "Apache-header": "Licensed under the Apache License, Version {v} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-notice": "Released under the BSD License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-notice": "Licensed under CC BY {v}.",
    "CC-BY-NC-notice": "Licensed under CC BY-NC {v}.",
    "CC-BY-NC-ND-notice": "Licensed under CC BY-NC-ND {v}.",
    "CC-BY-NC-SA-notice": "Licensed under CC BY-NC-SA {v}.",
    "CC-BY-ND-notice": "Licensed under CC BY-ND {v}.",
    "CC-BY-SA-notice": "Licensed under CC BY-SA {v}.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution {v} International License.",
    "CC-BY-NC-text": "This work is licensed under a Creative Commons Attribution-NonCommercial {v} International License.",
    "CC-BY-SA-text": "This work is licensed under a Creative Commons Attribution-ShareAlike {v} International License.",
    "CC0-text": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Released under CC0 {v}.",
    "GPL-notice": "This work is licensed under the GNU General Public License, version {v}.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-notice": "This work is licensed under the GNU Lesser General Public License, version {v}.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Reserved": "Copyright {y}. All rights reserved.",
    "SPDX-tag": "SPDX-License-Identifier: {v}",
    "AGPL-head": "GNU AFFERO GENERAL PUBLIC LICENSE Version {v}, {y} Copyright (C) {y} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "Apache-head": "Apache License Version {v}, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "Boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "GPL-head": "GNU GENERAL PUBLIC LICENSE Version {v}, {y} Copyright (C) {y} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-head": "GNU LESSER GENERAL PUBLIC LICENSE Version {v}, {y} Copyright (C) {y} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "PostgreSQL-text": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
# Words that tell one license from the next and may not differ.
TELLING = {"affero", "apache", "attribution", "bsd", "by", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa", "cc", "cc0", "gnu", "isc", "lesser", "mit", "mozilla", "mpl", "noncommercial", "attribution-noncommercial", "attribution-sharealike", "reserved", "sharealike", "spdx-license-identifier", "unencumbered"}

NOTHING = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)


def _compressor(text: str) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        self.templates = templates or TEMPLATES
        self.packers = {name: _compressor(text) for name, text in sorted(self.templates.items())}
        self.words = {name: WORD.findall(text.lower()) for name, text in self.templates.items()}

    def saved(self, block: bytes, name: str) -> int:
        """Bytes that the template saves."""
        return len(NOTHING.compress(block)) - len(self.packers[name].compress(block))

    def share_saved(self, block: bytes, name: str) -> float:
        return self.saved(block, name) / len(NOTHING.compress(block))

    def ranked(self, block: bytes, bag: set[str]) -> list[str]:
        """The templates of whose words the block has enough, by the bytes that they save."""
        able = []
        for name, want in self.words.items():
            fixed = [w for w in want if w[0] != "{"]
            if sum(w not in bag for w in fixed) <= DIFFERENT * len(want) and TELLING & set(fixed) <= bag:
                able.append((-self.saved(block, name), name))
        return [name for _, name in sorted(able)]

    def differences(self, have: list[str], name: str) -> tuple[list[str], list[str], int, int]:
        """(words of the template that are lacking, words added in between, first matching word, word after the last), by a longest common subsequence."""
        want, first, end = self.words[name], 0, 0
        same = lambda w, h: w == h or w == "{v}" and any(c.isdigit() for c in h) or w == "{v}" and want[0].startswith("spdx") or w == "{y}"
        best = [[0] * (len(have) + 1) for _ in range(len(want) + 1)]
        for i in range(len(want) - 1, -1, -1):
            for j in range(len(have) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if same(want[i], have[j]) else max(best[i + 1][j], best[i][j + 1])
        i, j, lacking, added, started = 0, 0, [], [], False
        while i < len(want) and j < len(have):
            if same(want[i], have[j]) and best[i][j] == best[i + 1][j + 1] + 1:
                first = first if started else j
                i, j, started, end = i + 1, j + 1, True, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                lacking.append(want[i])
                i += 1
            else:
                if started:
                    added.append(have[j])
                j += 1
        return lacking + want[i:], added, first, end

    def notices(self, block: bytes) -> Iterator[tuple[int, int, str, list[str], list[str]]]:
        """(start and end in bytes, template, lacking, added) of each stretch that has a template's wording; they may overlap."""
        text = block.decode("utf-8", "surrogateescape")
        places = list(WORD.finditer(text))
        have = [m[0].lower() for m in places]
        for name in self.ranked(block, set(have)):
            want = self.words[name]
            most = DIFFERENT * len(want)
            slack = max(most, 6 * ("{y}" in want))
            fixed = [w for w in want if w[0] != "{"]
            firsts, size = set(want[: int(most) + 1]), len(want) + int(slack)
            for j, h in enumerate(have):
                stretch = have[j : j + size]
                if h not in firsts and not firsts & {"{v}", "{y}"} or len(fixed) - len(set(fixed) & set(stretch)) - (len(fixed) - len(set(fixed))) > most:
                    continue
                lacking, added, first, end = self.differences(stretch, name)
                if end and not TELLING & {*lacking, *added} and len(lacking) <= most and len(added) <= slack:
                    cut = lambda k: len(text[:k].encode("utf-8", "surrogateescape"))
                    yield cut(places[j + first].start()), cut(places[j + end - 1].end()), name, lacking, added

    def blocks(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(byte offset, block): paragraphs with a cue, and where they have several lines or sentences also those with a cue."""
        at = 0
        for paragraph in re.split(rb"(\n[ \t\r]*\n)", text):
            if paragraph.strip() and CUE.search(paragraph):
                words = [m.span() for m in re.finditer(rb"\S+", paragraph)]
                for k in range(0, max(1, len(words) - BLOCK_WORDS // 2), BLOCK_WORDS // 2):
                    piece = words[k : k + BLOCK_WORDS]
                    yield at + piece[0][0], paragraph[piece[0][0] : piece[-1][1]]
                for m in re.finditer(rb"[^\n]+", paragraph):
                    if CUE.search(m[0]):
                        if m[0] != paragraph:
                            yield at + m.start(), m[0]
                        parts = re.split(rb"(?<=[.!?])\s+", m[0])
                        place = m.start()
                        for part in parts if len(parts) > 1 else ():
                            place = paragraph.index(part, place)
                            if CUE.search(part):
                                yield at + place, part
                            place += len(part)
            at += len(paragraph)

    def scan(self, text: bytes | None) -> list[tuple[int, int, str, float, str, str]]:
        """(start, end, template, share saved, lacking, added) of each hit; of overlapping ones the longest template."""
        hits = []
        if text and CUE.search(text):
            for at, block in self.blocks(text):
                for start, end, name, lacking, added in self.notices(block):
                    hits.append((-self.saved(block[start:end], name), len(lacking) + len(added), len(block), name, at + start, at + end, at, block, lacking, added))
        kept: list[tuple] = []
        for h in sorted(hits):
            if all(h[5] <= k[4] or h[4] >= k[5] for k in kept):
                kept.append(h)
        return sorted((at, at + len(block), name, self.share_saved(block, name), " ".join(lacking), " ".join(added)) for _, _, _, name, _, _, at, block, lacking, added in kept)


HIT = "doc_id bigint, start bigint, end bigint, license string, saved double, lacking string, added string"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string())
    for b in batches:
        rows = [(k, *hit) for k, t in enumerate(b.column(1)) for hit in scanner.scan(t.as_py())]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        ids = b.column(0).take(pa.array(columns[0], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True))], names=[x.split()[0] for x in HIT.split(", ")])


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license notice found: doc_id, start and end in bytes, license, share saved, lacking and added words."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_scan_batches, HIT)
