"""Licence statements in take transcripts and notes, by conditional compression.

Stretches around licence vocabulary are candidate blocks. Each block is compressed alone and with every template as a
raw zstandard dictionary; what a template saves ranks it. Winners are confirmed by their exact wording: the fewest words
by which the template differs from a stretch of the block. The library's records have no licence field; any text will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from cutlake.llm.common import others, small_batches

# Wordings of public licences, (licence, text).
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("reserved", "All rights reserved."),
]

#: A unit (line or sentence) with one of these belongs to a candidate block. Every template has one in its first units.
VOCABULARY = ("licen", "copyright", "permission", "permitted", "redistribut", "rights reserved", "public domain", "free software", "spdx", "creative commons", "warrant")
UNIT = re.compile(r"\n|(?<=[.!?;])[\x20\t\r]")
WORD = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*")
#: Units without licence vocabulary that may stand between two with it in one block.
GAP = 2
SPARE = 2.0  # bytes a template saves at least


def blocks(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidate blocks of a text, code points."""
    low = (text or "").casefold() if text else ""
    if not any(v in low for v in VOCABULARY):
        return
    start = end = None
    at = gap = 0
    for m in [*UNIT.finditer(text), None]:
        stop = m.start() if m else len(text)
        unit = text[at:stop].casefold()
        if any(v in unit for v in VOCABULARY):
            start, end, gap = (at if start is None else start), stop, 0
        elif start is not None:
            gap += 1
            if gap > GAP:
                yield start, end
                start = None
        at = m.end() if m else at
    if start is not None:
        yield start, end


class Templates:
    """Compressors with each template as dictionary, and the templates' words."""

    def __init__(self, templates: list[tuple[str, str]], level: int = 3):
        options = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.alone = zstandard.ZstdCompressor(compression_params=options)
        self.all = []
        for name, text in templates:
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.all.append((name, text, [w.casefold() for w in WORD.findall(text)], zstandard.ZstdCompressor(dict_data=raw, compression_params=options)))

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(bytes saved, template), best first, of those that save anything."""
        data = block.encode("utf-8", "surrogatepass")
        plain = len(self.alone.compress(data))
        saved = [(plain - len(packer.compress(data)), k) for k, (_, _, _, packer) in enumerate(self.all)]
        return sorted(((s / max(1, plain), k) for s, k in saved if s >= SPARE), key=lambda x: (-x[0], x[1]))

    def found(self, block: str) -> list[dict]:
        """Confirmed statements of a block, apart from each other: at most a tenth of a template's words differ."""
        spots = [(m.start(), m.end(), m[0].casefold()) for m in WORD.finditer(block)]
        words = [w for _, _, w in spots]
        hits = []
        for rank, (saved, k) in enumerate(self.ranked(block), 1):
            name, _, own, _ = self.all[k]
            for first, last, wrong in matches(own, words, len(own) // 10):
                hits.append((wrong / len(own), -len(own), rank, k, first, last, saved, wrong))
        hits.sort()
        out, taken = [], []
        for _, _, rank, k, first, last, saved, wrong in hits:
            if any(first < t and s < last for s, t in taken):
                continue
            taken.append((first, last))
            missing, added = differences(self.all[k][2], words[first:last])
            out.append({
                "start": spots[first][0], "end": spots[last - 1][1], "licence": self.all[k][0], "template": k, "saved": saved, "rank": rank,
                "n_differing": wrong, "missing": " ".join(missing), "added": " ".join(added),
            })
        return sorted(out, key=lambda x: x["start"])


def matches(own: list[str], words: list[str], most: int) -> list[tuple[int, int, int]]:
    """Stretches [first, last) of ``words`` within ``most`` word edits of ``own``, with their edits; the best of each neighbourhood.

    Bit-parallel approximate search: one pass over the words, whatever their number.
    """
    ends = _ends(own, words, most)
    out: list[tuple[int, int, int]] = []
    for last, wrong in ends:
        back = _ends(own[::-1], words[max(0, last - len(own) - most) : last][::-1], most, anchored=True)
        best = min(back, key=lambda x: (x[1], x[0]), default=None)
        if best is None:
            continue
        first = last - best[0]
        if out and out[-1][1] > first:
            if wrong < out[-1][2]:
                out[-1] = (first, last, wrong)
            continue
        out.append((first, last, wrong))
    return out


def _ends(own: list[str], words: list[str], most: int, anchored: bool = False) -> list[tuple[int, int]]:
    """(end, edits) wherever ``own`` ends within ``most`` edits; ``anchored``: it starts at the first word."""
    m = len(own)
    if not m:
        return []
    full, top = (1 << m) - 1, 1 << (m - 1)
    mask: dict[str, int] = {}
    for k, w in enumerate(own):
        mask[w] = mask.get(w, 0) | 1 << k
    plus, minus, score, out = full, 0, m, []
    for j, w in enumerate(words, 1):
        eq = mask.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | int(anchored)) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score <= most:
            out.append((j, score))
    return out


def differences(own: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the stretch misses, and words that it has instead or besides."""
    missing, added = [], []
    for op, i, j, s, t in SequenceMatcher(None, own, words, autojunk=False).get_opcodes():
        if op != "equal":
            missing += own[i:j]
            added += words[s:t]
    return missing, added


FOUND = ArrayType(
    StructType().add("start", IntegerType()).add("end", IntegerType()).add("licence", StringType()).add("template", IntegerType()).add("saved", DoubleType())
    .add("rank", IntegerType()).add("n_differing", IntegerType()).add("missing", StringType()).add("added", StringType())
)


def licence_statements(takes: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per confirmed statement: the columns of ``takes`` but the text, and ``start``, ``end`` (code points), ``licence``,
    ``template`` (its number), ``saved`` (share of the block's compressed size), ``rank`` by saving, ``n_differing``, ``missing``, ``added``.

    ``takes``: text and any further columns (those named like a result are replaced). ``templates``: (licence, text)
    pairs, a parameter of bounded size. A statement is confirmed if at most a tenth of its template's words differ, so short
    templates must stand word by word. Null and empty texts have none; repeated rows have theirs each.
    """
    pairs = list(TEMPLATES if templates is None else templates)
    made = FOUND.elementType.fieldNames()

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Templates(pairs)
        for texts in batches:
            rows = []
            for text in texts:
                hits = []
                for start, end in blocks(text):
                    for hit in known.found(text[start:end]):
                        hits.append(hit | {"start": start + hit["start"], "end": start + hit["end"]})
                rows.append(hits)
            yield pd.Series(rows, dtype=object)

    rest = others(takes, ["text"], made)
    return small_batches(takes).select(*rest, F.explode(scan("text")).alias("__f")).select(*rest, "__f.*")
