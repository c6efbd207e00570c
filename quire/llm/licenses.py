"""Operator 3, license scans: which licenses the blocks of a document state, and in what wording.

Method: conditional compression. A candidate block (a line that speaks of licensing; for long templates with the lines after it, as
far as the template reaches, over blank lines too; of a line of over WINDOW words, what a template reaches from each cue) is compressed with
each template as a zstandard raw dictionary, and without one. Templates rank by how many bytes they save, and the first in that order whose
exact wording is confirmed wins; nothing is left out beforehand but what can't be confirmed, templates of whose words more are missing than
may differ. To confirm, the words of template and block are aligned and the differences are given: a template holds if they are one word or
a tenth of its words at most (none in templates of three words, SPDX identifiers, headings, and further licenses after "or" and "and") and
touch none of its telling words (versions and variants). Short templates are held against the line alone and with the lines after it up to a
blank one. The words before and after a statement are searched on until no template holds; the place given is that of the lines that a
statement stands in.

Every line of the whole text is looked at. A null text has none. Rows are judged one by one (repeated rows give repeated
results, a null doc_id stays null); a document without license lines gives no row, nor does an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Wordings of public licenses and of the notices that name them. <...> stands for up to eight words.
WORDINGS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Proprietary", "Copyright (c) <year and holder>. All rights reserved."),
    ("Proprietary", "All rights reserved."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <number> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <number> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <number> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <number> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <number> Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
)
# SPDX identifiers beside the license that they name, and names of licenses as texts write them.
IDENTIFIERS = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "0BSD": "0BSD", "ISC": "ISC", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "Unlicense": "Unlicense", "WTFPL": "WTFPL",
    "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0", "EUPL-1.2": "EUPL-1.2", "Artistic-2.0": "Artistic-2.0", "PostgreSQL": "PostgreSQL", "CDDL-1.0": "CDDL-1.0", "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0",
    **{f"{n}{e}": n for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for e in ("", "-only", "-or-later")},
}
NAMES = (
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("GPL-2.0", "GNU General Public License, Version 2"), ("GPL-3.0", "GNU General Public License, Version 3"),
    ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-3.0", "GNU General Public License v3.0"), ("LGPL-2.1", "GNU Lesser General Public License, Version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, Version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, Version 3"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("EPL-2.0", "Eclipse Public License, Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Artistic-2.0", "Artistic License 2.0"), ("PostgreSQL", "PostgreSQL License"), ("EUPL-1.2", "European Union Public Licence 1.2"),
)
LEADS = ("Licensed under the", "Licensed under the terms of the", "Released under the", "Distributed under the", "Available under the", "Licensed under either of", "Dual licensed under the")
#: What a template may be: a statement; the heading of a license, which must be a line's whole wording; or a further license
#: ("or the ...", "AND ..."), which must follow a statement at once. Those of the last two kinds must stand as they are.
STATEMENT, HEADING, FURTHER = range(3)


def all_templates() -> tuple[tuple[str, str, int], ...]:
    """license, wording, kind: the given wordings, then what identifiers and names make; of equal wordings the first."""
    made = [(n, x, STATEMENT) for n, x in WORDINGS]
    made += [(n, f"SPDX-License-Identifier: {i}", STATEMENT) for i, n in IDENTIFIERS.items()]
    made += [(n, f"{lead} {x}", STATEMENT) for lead in LEADS for n, x in NAMES]
    made += [(n, x, HEADING) for n, x in NAMES]
    made += [(n, f"{by} {i}", FURTHER) for by in ("or", "and") for i, n in IDENTIFIERS.items()]
    made += [(n, f"{by} {x}", FURTHER) for by in ("or", "and", "or the", "and the") for n, x in NAMES]
    first: dict[tuple[str, int], tuple[str, str, int]] = {}
    for n, x, kind in made:
        first.setdefault((normal(x), kind), (n, x, kind))
    return tuple(first.values())


CUES = ("licen", "copyright", "©", "spdx", "permission", "redistribut", "public domain", "creative commons", "reserved")
#: Words that tell licenses and their variants apart, besides all with digits.
TELLING = frozenset("mit apache gnu general lesser affero mozilla bsd isc cc cc0 by sa nc nd sharealike attribution noncommercial only later proprietary public domain gpl lgpl agpl mpl epl eupl bsl cddl zlib boost eclipse artistic postgresql unlicense wtfpl 0bsd software european union either dual".split())
#: From so many words on a template is long: it is held against lines together.
LONG = 30
DIFFERENCE = 0.1
#: Words of a line (with the lines that a template reaches) up to which it is searched as a whole; a longer one is searched around each of its cues.
WINDOW = 2000
#: Templates of so few words must stand as they are.
BRIEF = 3
WORD = re.compile(r"<[^>]*>|[^\W_]+(?:\.\d+)*")
SCHEMA = "doc_id long, start long, end long, license string, template int, reduction double, n_differences long, differences array<string>, exact boolean"


class Template(NamedTuple):
    license: str
    kind: int
    words: tuple[str, ...]
    squeeze: zstandard.ZstdCompressor


def normal(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


TEMPLATES = all_templates()


@lru_cache(1)
def templates() -> tuple[list[Template], zstandard.ZstdCompressor]:
    options = {"level": 19, "write_content_size": False, "write_dict_id": False}
    made = []
    for name, text, kind in TEMPLATES:
        words = normal(text)
        own = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append(Template(name, kind, tuple(words.split(" ")) if "<" not in words else tuple(WORD.findall(words)), zstandard.ZstdCompressor(dict_data=own, **options)))
    return made, zstandard.ZstdCompressor(**options)


def allowance(t: Template) -> float:
    """How many words may differ."""
    return max(1, DIFFERENCE * len(t.words)) if len(t.words) > BRIEF and t.kind == STATEMENT and t.words[0] != "spdx" else 0


def differences(template: tuple[str, ...], words: list[str]) -> tuple[list[str], int, tuple[int, int]] | None:
    """Differences (-gone +new), how many words they touch, and the span of words that answers the template; None if telling words differ."""
    ops = [o for o in SequenceMatcher(None, template, words, autojunk=False).get_opcodes()]
    if not any(o[0] == "equal" for o in ops):
        return None
    if ops[0][0] == "insert":  # what stands before and after is no difference
        ops = ops[1:]
    if ops[-1][0] == "insert":
        ops = ops[:-1]
    found, touched = [], 0
    for kind, a, b, c, d in ops:
        if kind == "equal":
            continue
        gone, new = template[a:b], words[c:d]
        if len(gone) == 1 and gone[0][0] == "<" and len(new) <= 8:
            continue
        if any(w in TELLING or any(map(str.isdigit, w)) for w in (*gone, *new)):
            return None
        found.append(" ".join([*(f"-{w}" for w in gone), *(f"+{w}" for w in new)]))
        touched += max(len(gone), len(new))
    return found, touched, (ops[0][3], ops[-1][4])


def matched(line: list[str], near: list[str], more: list[str], whole: bool, follows: bool) -> tuple | None:
    """The template that words answer from within line on: short ones in the line or with what stands near, long ones in the line with more.

    Templates rank by how many bytes they save of the words, and the first in rank that holds wins. One of whose words more are missing than may differ can't hold, wherever
    it ranks, and isn't tried. whole: the words begin a line and are all of it; follows: they follow a statement."""
    made, plain = templates()
    tries = [(False, line), (False, near), (True, more)] if len(near) > len(line) else [(False, line), (True, more)]
    ranked = []
    for long, words in tries:
        text, held = " ".join(words).encode(), set(words)
        size = None
        for i, t in enumerate(made):
            if (len(t.words) >= LONG) != long or not (t.kind == STATEMENT or t.kind == HEADING and whole and len(line) <= len(t.words) or t.kind == FURTHER and follows):
                continue
            if sum(w not in held for w in t.words if w[0] != "<") > allowance(t):
                continue
            size = len(plain.compress(text)) if size is None else size
            saved = size - len(t.squeeze.compress(text))
            ranked.append((-saved, -len(t.words), i, saved / size, words))
    for _, _, i, reduction, words in sorted(ranked, key=lambda x: x[:3]):
        told = differences(made[i].words, words)
        if told and told[1] <= allowance(made[i]) and told[2][0] < (len(line) if made[i].kind == STATEMENT else 1):
            return None, i, reduction, told
    return None


def cue_places(words: list[str]) -> list[int]:
    """Where cues are among words, of two words the first."""
    pairs = [f"{a} {b}" for a, b in zip(words, [*words[1:], ""], strict=False)]
    return [i for i, p in enumerate(pairs) if any(c in p for c in CUES)]


def lines_of(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def scan(text: str) -> Iterator[tuple]:
    """start, end, license, template, reduction, differences, exact of the license statements of a text."""
    low = text.lower()
    if not any(c in low for c in CUES):
        return
    longest = max(len(t.words) for t in templates()[0]) * 1.2
    lines, used = lines_of(text), {}
    cued = [any(c in line.lower() for c in CUES) for _, line in lines] + [False]
    for i, (start, _) in enumerate(lines):
        if not (cued[i] or cued[i + 1]):  # a statement may begin on the line before its telling words
            continue
        block = WORD.findall(lines[i][1].lower())[used.get(i, 0) :]
        own, ends, near, k = len(block), [len(block)], None, i + 1
        while own and k < len(lines) and len(block) - own < longest:
            words = WORD.findall(lines[k][1].lower())
            if near is None and (not words or len(block) - own >= LONG * 1.2):
                near = len(block)
            block += words
            ends.append(len(block))
            k += 1
        near = len(block) if near is None else near
        todo, found = [(0, len(block), False)], []
        places = cue_places(block)
        while todo:
            a, b, follows = todo.pop()
            first = bisect_left(places, a)
            cue = places[first] if first < len(places) and places[first] < b else None
            if a >= min(b, own) or not follows and cue is None:
                continue
            end = b
            if b - a > WINDOW:  # a statement of the first cue is within its reach; those of the next cues have their turn
                if follows or cue - a <= longest:
                    end = math.ceil(min(b, (a if cue is None or follows else cue) + longest))
                else:
                    todo.append((math.ceil(cue - longest), b, False))
                    continue
            best = matched(block[a : min(end, own)], block[a : min(end, near)], block[a:end], a == 0 and end >= own and not used.get(i), follows)
            if best is None and end < b:
                todo.append((a, b, False) if follows else (cue + 1, b, False))
            if best:
                _, at, reduction, (told, touched, (c, d)) = best
                found.append((a + c, a + d, at, reduction, touched, told))
                todo += [(a, a + c, False), (a + d, b, True)]
        for _, to, at, reduction, touched, told in sorted(found, key=lambda x: x[:2]):
            j = next(n for n, e in enumerate(ends) if e >= to)
            for n in range(1, j + 1):
                used[i + n] = min(to, ends[n]) - ends[n - 1]
            yield start, lines[i + j][0] + len(lines[i + j][1]), TEMPLATES[at][0], at, round(reduction, 6), touched, told


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.bool_())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for b in batches:
        rows = [(i, *r, not r[5]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for r in scan(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for each license statement of docs (doc_id, text): its place in characters, license, template, size reduction, differences."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scanned, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
