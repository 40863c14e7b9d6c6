"""License scan: MinHash bands over overlapping text windows, then exact containment.

Templates are short and documents that quote them long, so similarity is taken on windows about as
long as the template. Templates of like length form a size class (up to ``SPREAD`` times its shortest);
its windows start every quarter of the shortest template and are that much longer than the longest, so
any quotation lies whole inside one. A class has one table from band values to templates: each
window looks its band values up there, whatever the number of templates. A pair found is verified by the
exact share of the template's word shingles that the window holds.

Band settings are derived, not guessed: a window that holds the wanted share of a template has
a least Jaccard similarity s, and the number of bands of ``rows`` rows is the smallest that
misses such a window with a chance of at most ``miss``; a class takes the most that one of its
templates needs.

One narrow stage. The templates are a stated set that the caller holds in memory.

Defined cases: a null or empty text has no words and matches nothing; a template without words
is an argument error, one of fewer words than a shingle is one shingle; repeated rows are
scanned each; other columns pass through (one called ``licenses`` is replaced); an empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.circulant_minhash import _WordHash
from docflow.llm.fm_index import words_of

#: Notices as licences ask for them, and wordings that their texts have; short enough that
#: another version or a sister licence holds less than the wanted share of their shingles.
NOTICES = {
    "0BSD-text": "copy, modify, and/or distribute this software",
    "AGPL-3.0": "GNU Affero General Public License version 3",
    "AGPL-text": "of the GNU Affero General Public License as published by",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Artistic-2.0": "licensed under the Artistic License 2.0",
    "BSD": "Released under the BSD license",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                "provided that the following conditions are met",
    "BSD-3-text": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-text": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-text": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "EUPL-1.2": "Licensed under the European Union Public Licence",
    "GFDL": "under the terms of the GNU Free Documentation License",
    "GPL-2.0": "GNU General Public License version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "GPL-text": "of the GNU General Public License as published by",
    "ISC-text": "copy, modify, and distribute this software",
    "LGPL-2.1": "Lesser General Public License version 2.1",
    "LGPL-3.0": "Lesser General Public License version 3",
    "LGPL-text": "of the GNU Lesser General Public License as published by",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                "and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "WTFPL": "Do What The Fuck You Want To Public License",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
                 "be held liable for any damages",
    "all-rights-reserved": "All rights reserved.",
}
#: Identifiers that stand in a line SPDX-License-Identifier.
SPDX = ("0BSD AFL-3.0 AGPL-3.0 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 "
        "EUPL-1.2 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense WTFPL Zlib").split()
NOTICES |= {f"SPDX:{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}
#: How much longer than the shortest the longest template of a size class may be.
SPREAD = 1.5
HIT = "array<struct<license:string,start:bigint,end:bigint,containment:double>>"
NONE = np.uint64(2**64 - 1)


def bands_needed(similarity: float, rows: int, miss: float) -> int:
    """Fewest bands of ``rows`` rows that miss a pair of this similarity at most that often."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-similarity**rows)))


class Template:
    def __init__(self, name: str, text: str, size: int, cache: dict):
        words = words_of(text)
        if not words:
            raise ValueError(f"template {name} has no words")
        self.name, self.n, self.size = name, len(words), min(size, len(words))
        self.hashes = np.unique(shingles(np.array([cache[w] for w in words], np.uint64), self.size))


class SizeClass:
    """Templates of like length and equal shingle size, their windows, bands and table."""

    def __init__(self, templates: list[Template], least: float, rows: int, miss: float):
        self.templates, self.size = templates, templates[0].size
        self.stride = max(1, min(t.n for t in templates) // 4)
        self.window = max(t.n for t in templates) + self.stride - self.size  # shingles that start in a window
        held = [math.ceil(least * len(t.hashes) - 1e-9) for t in templates]
        self.bands = max(bands_needed(h / (self.window + len(t.hashes) - h), rows, miss) for h, t in zip(held, templates, strict=True))


def size_classes(templates: list[Template], least: float, rows: int, miss: float) -> list[SizeClass]:
    out: list[list[Template]] = []
    for t in sorted(templates, key=lambda t: (t.size, t.n, t.name)):
        if out and out[-1][0].size == t.size and t.n <= SPREAD * out[-1][0].n:
            out[-1].append(t)
        else:
            out.append([t])
    return [SizeClass(ts, least, rows, miss) for ts in out]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position; NONE where they don't fit or end."""
    out = np.full(len(words), NONE)
    n = len(words) - size + 1
    if n <= 0:
        return out[:0]
    h = np.zeros(n, np.uint64)
    bad = np.zeros(n, bool)
    for i in range(size):
        bad |= words[i:i + n] == NONE
        h = (h ^ words[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    out[:n] = np.where(bad, NONE, np.minimum(h, NONE - np.uint64(1)))
    return out if size == 1 else out[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position (``x`` is padded at its end)."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Scanner:
    def __init__(self, templates: dict[str, str], size: int = 3, least: float = 0.8, rows: int = 1, miss: float = 1e-6):
        self.cache, self.least, self.rows = _WordHash(), least, rows
        made = [Template(k, v, size, self.cache) for k, v in sorted(templates.items())]
        self.classes = size_classes(made, least, rows, miss)
        most = max((c.bands for c in self.classes), default=0) * rows
        r = np.random.default_rng(3)
        self.mul = (r.integers(1, 2**62, most, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.pad = max((c.window + c.size for c in self.classes), default=1)
        # Per class and band: the templates' band values, sorted, and whose they are.
        self.tables = [[self._table(c, b) for b in range(c.bands)] for c in self.classes]

    def _table(self, c: SizeClass, band: int) -> tuple[np.ndarray, np.ndarray]:
        value = self._band([np.array([self._coordinate(k, t.hashes).min() for t in c.templates], np.uint64) for k in self._rows(band)])
        order = np.argsort(value, kind="stable")
        return value[order], order

    def _rows(self, band: int) -> range:
        return range(band * self.rows, (band + 1) * self.rows)

    @staticmethod
    def _band(coordinates: list) -> np.ndarray:
        """One value of a band's coordinates."""
        out = coordinates[0]
        for c in coordinates[1:]:
            out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def _coordinate(self, k: int, h: np.ndarray) -> np.ndarray:
        mixed = h * self.mul[k]
        mixed ^= mixed >> np.uint64(32)
        return np.where(h == NONE, NONE, mixed * self.mul[k])

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        rows = [words_of(t) for t in texts]
        size = np.array([len(r) + self.pad for r in rows], np.int64)
        words = np.full(int(size.sum()) + self.pad, NONE)
        first = np.cumsum(size) - size
        for r, a in zip(rows, first.tolist(), strict=True):
            words[a:a + len(r)] = np.fromiter(map(self.cache.__getitem__, r), np.uint64, len(r))
        doc = np.repeat(np.arange(len(rows)), size)
        offset = np.arange(len(doc)) - first[doc]
        found: dict[str, list[tuple]] = {}
        own: dict[int, np.ndarray] = {}
        for c, tables in zip(self.classes, self.tables, strict=True):
            h = own.get(c.size)
            if h is None:
                h = own[c.size] = shingles(words, c.size)
            starts = np.flatnonzero((offset % c.stride == 0) & (offset < (size - self.pad)[doc]))
            starts = starts[starts + c.window <= len(h)]
            pairs: set[tuple[int, int]] = set()
            for b, (value, whose) in enumerate(tables):
                mine = self._band([sliding_min(self._coordinate(k, h), c.window)[starts] for k in self._rows(b)])
                at = np.searchsorted(value, mine)
                for i in np.flatnonzero(value[np.minimum(at, len(value) - 1)] == mine).tolist():
                    for j in range(at[i], np.searchsorted(value, mine[i], "right")):
                        pairs.add((int(whose[j]), int(starts[i])))
            for j, s in sorted(pairs):
                t = c.templates[j]
                at = np.flatnonzero(np.isin(h[s:s + c.window], t.hashes))
                share = len(np.unique(h[s + at])) / len(t.hashes)
                if share >= self.least - 1e-12:
                    a = int(first[doc[s]])
                    found.setdefault(t.name, []).append((int(doc[s]), s + int(at[0]) - a, s + int(at[-1]) + t.size - a, share))
        out: list[list[dict]] = [[] for _ in texts]
        for name in sorted(found):
            for d, start, end, share in found[name]:
                self._add(out[d], name, start, end, share)
        return out

    @staticmethod
    def _add(hits: list[dict], name: str, start: int, end: int, share: float) -> None:
        """Overlapping windows of one template are one hit with the best share."""
        if hits and hits[-1]["license"] == name and start <= hits[-1]["end"]:
            hits[-1]["end"] = max(end, hits[-1]["end"])
            hits[-1]["containment"] = max(share, hits[-1]["containment"])
        else:
            hits.append({"license": name, "start": start, "end": end, "containment": share})


def scan(docs: DataFrame, templates: dict[str, str] | None = None, size: int = 3, least: float = 0.8,
         rows: int = 1, miss: float = 1e-6) -> DataFrame:
    """``docs`` plus ``licenses``: hits in the whole ``text`` (word offsets), by template."""
    stated = NOTICES if templates is None else templates

    def run(batches):
        scanner = Scanner(stated, size, least, rows, miss)
        for batch in batches:
            field, found, held, chars = batch.schema.field("licenses"), [], [], 0
            for text in [*batch.column("text").to_pylist(), ...]:
                if text is ... or chars > 2_000_000:
                    found += scanner.scan(held)
                    held, chars = [], 0
                if text is not ...:
                    held.append(text)
                    chars += len(text or "")
            yield batch.set_column(batch.schema.get_field_index("licenses"), field, pa.array(found, field.type))

    out = docs.drop("licenses").withColumn("licenses", F.lit(None).cast(HIT))
    return out.mapInArrow(run, out.schema)
