"""License scans by conditional compression.

A notice is confirmed by its words: at most MISSING of a template's words may be absent, at most EXTRA as many others may stand between them, and
no number (its version) may be absent. So any notice holds one of a template's *anchors*, its longest words, taken until there are more
than may be absent. Words around anchors, as far as a notice can reach, are the candidate blocks; line ends play no part, and no
other text can hold a notice. Each block is compressed, in lower case, with every template that has an anchor in it as a zstandard raw
dictionary, and templates are ranked by how much that shrinks the block against compressing it alone. In that order their words are
aligned with the words around each anchor (least number of absent and extra words); what the alignment confirms is a notice,
whatever its rank. Of notices that overlap the one with the fewest differences stays, then the longer wording, then the better rank.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, prepare

# Short public notices of well-known licences; a licence may have several wordings.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
]
#: Shares of a template's words that may be absent, and that others may add.
MISSING, EXTRA = 0.15, 0.25
#: Words after which a block ends where windows go on overlapping.
BLOCK_WORDS = 512
_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W_]+")
_RESULT = "doc_id long, licenses array<struct<license: string, start: int, end: int, reduction: double, share: double, missing: string, extra: string>>"


class Template:
    """A wording: its words, how many may be absent or added, and its anchors with their places."""

    def __init__(self, name: str, wording: str):
        self.name = name
        self.words = [w.lower() for w in _WORD.findall(wording)]
        n = len(self.words)
        self.missing, self.extra = int(MISSING * n), int(EXTRA * n)
        self.counts = Counter(self.words)
        self.anchors: dict[str, list[int]] = {}
        held = 0
        for w in sorted(self.counts, key=lambda w: (-len(w), w)):
            if held > self.missing:
                break
            self.anchors[w] = [i for i, x in enumerate(self.words) if x == w]
            held += self.counts[w]

    def align(self, have: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """(low, high, absent, extra words) of the range of have with the fewest absent and extra words; None if they are too many.

        Among equals the fewest absent words decide, then the earliest end, then the latest start.
        """
        want, never = self.words, 10**6
        if sum((self.counts & Counter(have)).values()) < len(want) - self.missing:
            return None
        price = [never if w[0].isdigit() else 1 for w in want]
        # cost[i][j]: of the first i words of the template against a range that ends at j, as (differences, absent, -start)
        cost = [[(0, 0, -j) for j in range(len(have) + 1)]]
        for i, w in enumerate(want):
            above, p = cost[-1], price[i]
            row = [(above[0][0] + p, above[0][1] + 1, above[0][2])]
            for j, h in enumerate(have):
                d, a, s = above[j + 1]
                best = (d + p, a + 1, s)
                d, a, s = row[j]
                best = min(best, (d + 1, a, s))
                if h == w:
                    best = min(best, above[j])
                row.append(best)
            cost.append(row)
        last = cost[-1]
        high = min(range(len(have) + 1), key=lambda j: (last[j][0], last[j][1], j))
        total, absent, start = last[high]
        if absent > self.missing or total - absent > self.extra:
            return None
        i, j, gone, more = len(want), high, [], []
        while i:
            here = cost[i][j]
            if j and have[j - 1] == want[i - 1] and cost[i - 1][j - 1] == here:
                i, j = i - 1, j - 1
            elif j and (cost[i][j - 1][0] + 1, *cost[i][j - 1][1:]) == here:
                more.append(have[j - 1])
                j -= 1
            else:
                gone.append(want[i - 1])
                i -= 1
        return -start, high, gone[::-1], more[::-1]


class _Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        import zstandard

        self.templates = [Template(*t) for t in templates]
        self.alone = zstandard.ZstdCompressor(level=9)
        self.with_template = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            for w, places in t.anchors.items():
                self.owners[w] += [(k, p) for p in places]
        self.gate = "(?i)" + "|".join(sorted(map(re.escape, self.owners)))

    def windows(self, have: list[str]) -> list[tuple[int, int, int]]:
        """(low, high, template): the words that a notice with an anchor of have can reach, by place."""
        out = set()
        for i, w in enumerate(have):
            for k, p in self.owners.get(w, ()):
                t = self.templates[k]
                slack = t.missing + t.extra
                out.add((max(0, i - p - slack), min(len(have), i - p + len(t.words) + slack), k))
        return sorted(out)

    def blocks(self, windows: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        """Runs of overlapping windows, a new one after BLOCK_WORDS."""
        run: list[tuple[int, int, int]] = []
        high = 0
        for w in windows:
            if run and (w[0] >= high or w[0] - run[0][0] >= BLOCK_WORDS):
                yield run
                run, high = [], 0
            run.append(w)
            high = max(high, w[1])
        if run:
            yield run

    def ranked(self, block: str, templates: set[int]) -> list[tuple[float, int]]:
        """(size reduction, template), the largest first; equal ones by the templates' order."""
        raw = block.lower().encode()
        base = len(self.alone.compress(raw))
        return sorted((((base - len(self.with_template[k].compress(raw))) / base, k) for k in templates), key=lambda x: (-x[0], x[1]))

    def scan(self, text: str) -> list[dict]:
        spans = [m.span() for m in _WORD.finditer(text)]
        have = [text[a:b].lower() for a, b in spans]
        found = []
        for block in self.blocks(self.windows(have)):
            low, high = block[0][0], max(w[1] for w in block)
            by_template = defaultdict(list)
            for a, b, k in block:
                by_template[k].append((a, b))
            for place, (gain, k) in enumerate(self.ranked(text[spans[low][0] : spans[high - 1][1]], set(by_template))):
                for a, b in by_template[k]:
                    got = self.templates[k].align(have[a:b])
                    if got is not None:
                        found.append((len(got[2]) + len(got[3]), -len(self.templates[k].words), place, a + got[0], a + got[1], k, gain, got[2], got[3]))
        out = []
        for _, _, _, a, b, k, gain, missing, extra in _apart(found):
            t = self.templates[k]
            share = 1 - len(missing) / len(t.words)
            out.append({"license": t.name, "start": spans[a][0], "end": spans[b - 1][1], "reduction": gain, "share": share, "missing": " ".join(missing), "extra": " ".join(extra)})
        return sorted(out, key=lambda x: (x["start"], x["end"], x["license"]))


def _apart(found: list[tuple]) -> list[tuple]:
    """The best of those that overlap: fewest differences, longest wording, best rank, first place."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for f in sorted(found):
        i = bisect_right(starts, f[3])
        if (i and ends[i - 1] > f[3]) or (i < len(starts) and starts[i] < f[4]):
            continue
        starts.insert(i, f[3])
        ends.insert(i, f[4])
        out.append(f)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = _Scanner()
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("reduction", pa.float64()), ("share", pa.float64()), ("missing", pa.string()), ("extra", pa.string())])
    )
    for batch in batches:
        texts = pc.fill_null(column(batch, "text"), "")
        maybe = pc.match_substring_regex(texts, scanner.gate).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array([scanner.scan(t.as_py()) if m else [] for t, m in zip(texts, maybe)], type=kind)], names=["doc_id", "licenses"]
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_licenses, license_ids, licenses: one row per row of docs, each whole text.

    licenses: for each confirmed notice its name, code point range, its block's size reduction, share of the template's words, and the words missing from
    and added to the wording; license_ids: the distinct names, sorted and comma-joined. Null and empty texts have none, repeated rows are scanned each. Equal
    ranks go to the earlier template. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    return docs.mapInArrow(_scan, _RESULT).select("doc_id", F.size("licenses").alias("n_licenses"), names.alias("license_ids"), "licenses")
