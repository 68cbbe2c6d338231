"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are runs of letters and digits, lower-cased; shingles are runs of three words. For each class of template
lengths, windows of a fixed number of words overlap by three quarters, so that one window holds the whole of
a template's copy of up to three quarters of its length. With one row a band, a window retrieves a template of
Jaccard similarity j with probability 1 - (1 - j) ** bands; `bands` is set so that this is at least `sure` at
the least similarity that a copy in its window can have, the template's missing shingles counted in the union. A retrieved template counts where the window
and its neighbours hold at least `contained` of the template's shingles, compared as text. Where templates of
several licenses count at the same place (BSD-2 within BSD-3, versions of one notice), the one with most
shingles there is taken and those with half of their places inside it are not.

Window signatures come from block minima: every shingle is hashed once for each band, each window's minimum is
that of its four blocks; blocks of a longer class are made from those of a shorter one.

Defined results: null, empty and short texts have no license; a template that occurs several times is one
entry with its best containment and that place; a null doc_id and repeated rows are rows as any other.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, mix, shingles, word_hashes

#: Usual notices of the public licenses; full texts are in license_texts, one file a license.
GNU = "This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, {version} of the License"
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Names that stand in the sentences 'licensed under', 'released under' and 'distributed under'.
CALLED = {
    "MIT": ["the MIT License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 License", "Apache License 2.0", "the Apache-2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"],
    "ISC": ["the ISC License"],
    "Zlib": ["the zlib License"],
    "Unlicense": ["the Unlicense"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "EPL-1.0": ["the Eclipse Public License v1.0", "the Eclipse Public License 1.0"],
    "EPL-2.0": ["the Eclipse Public License v2.0", "the Eclipse Public License 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    **{f"{short}-{v}": [f"the GNU {long} Public License, version {v.removesuffix('.0')}", f"the GNU {long} Public License v{v}", f"{short} v{v.removesuffix('.0')}", f"the {short}v{v.removesuffix('.0')}", f"{short}-{v}"] for short, long, vs in (("GPL", "General", ("2.0", "3.0")), ("LGPL", "Lesser General", ("2.1", "3.0")), ("AGPL", "Affero General", ("3.0",))) for v in vs},
    **{f"CC-{k}-4.0": [f"CC {k} 4.0", f"a Creative Commons {v} 4.0 International License"] for k, v in CC.items()},
}


def _templates() -> list[tuple[str, str]]:
    """Names and texts: notices, names in sentences, SPDX lines and full texts."""
    full = sorted((p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in resources.files(__package__).joinpath("license_texts").iterdir() if p.name.endswith(".txt"))
    out = [
        ("MIT", "Released under the MIT License."),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
        ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
        ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
        ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
        ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
        ("Unlicense", "This is free and unencumbered software released into the public domain."),
        ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ]
    for short, kind, versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("LGPL", "Library ", ("2",)), ("AGPL", "Affero ", ("3",))):
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            for what in ("program", "library"):
                out.append((f"{name}-or-later", GNU.format(what=what, sign=":", kind=kind, version=f"either version {v}") + ", or (at your option) any later version."))
                out.append((f"{name}-only", GNU.format(what=what, sign=";", kind=kind, version=f"version {v}")))
            out.append((f"{name}-only", f"under the terms of the GNU {kind}General Public License version {v} as published by the Free Software Foundation"))
            out += [(f"{name}{end}", f"SPDX-License-Identifier: {name}{end}") for end in ("", "-only", "-or-later")]
    out += [(f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.") for k, v in CC.items()]
    out += [(name, f"{verb} under {called}") for name, names in CALLED.items() for called in names for verb in ("licensed", "released", "distributed")]
    spdx = dict.fromkeys([n for n, _ in full if "GPL" not in n] + [n for n in CALLED if "GPL" not in n])
    out += [(name, f"SPDX-License-Identifier: {name}") for name in spdx]
    seen: dict[tuple[str, ...], tuple[str, str]] = {}
    for name, text in out + full:
        seen.setdefault(tuple(re.findall(r"[^\W_]+", text.lower())), (name, text))
    return list(seen.values())


TEMPLATES = _templates()
WORD = re.compile(r"[^\W_]+")
SHINGLE = 3
#: Hashes held at once.
CELLS = 1 << 20
LOW = np.uint64(0xFFFF)


class Scanner:
    """matches(text) -> (license, containment, first word, words) of each license found."""

    def __init__(self, templates: list[tuple[str, str]], sure: float = 0.9999, contained: float = 0.9):
        self.contained, self.templates = contained, []
        self.hashes = word_hashes()
        classes: dict[int, list[int]] = {}
        for k, (name, text) in enumerate(templates):
            words = WORD.findall(text.lower())
            if len(words) < SHINGLE:
                raise ValueError(f"the template of {name} is shorter than a shingle")
            self.templates.append((name, len(words), {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}))
            size = 8
            while size * 3 < len(words) * 4:
                size *= 2
            classes.setdefault(size, []).append(k)
        least = min(math.ceil(t * contained) / (size + math.floor(t * (1 - contained))) for size, ks in classes.items() for t in (len(self.templates[k][2]) for k in ks))
        #: The fewest shingles of a text in which a class can be found.
        self.fewest = {size: min(math.ceil(len(self.templates[k][2]) * contained) for k in ks) for size, ks in classes.items()}
        self.bands = math.ceil(math.log(1 - sure) / math.log(1 - least))
        self.seeds = mix(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        #: For each class, sorted minima of its templates, their numbers, and which low bits occur. Bands hash apart, so that a minimum tells its band.
        self.tables = {}
        for size, ks in classes.items():
            keys = [(self._hash(shingles(self.hashes(WORD.findall(templates[k][1].lower())), SHINGLE), band).min(), k) for k in ks for band in range(self.bands)]
            keys.sort()
            known = np.array([x for x, _ in keys], np.uint64)
            likely = np.zeros(1 << 16, bool)
            likely[known & LOW] = True
            self.tables[size] = known, np.array([k for _, k in keys]), likely

    def _hash(self, s: np.ndarray, band: int) -> np.ndarray:
        return mix(s ^ self.seeds[band])

    def _retrieved(self, s: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, size) of the windows that share a band with a template; several bands at a time, as far as CELLS goes."""
        found: set[tuple[int, int, int]] = set()
        rows = max(1, CELLS // len(s))
        for lo in range(0, self.bands, rows):
            seeds = self.seeds[lo : lo + rows, None]
            h = mix(s[None, :] ^ seeds)
            block, step = h, 1
            for size, (keys, owners, likely) in sorted(self.tables.items()):
                if len(s) < self.fewest[size]:
                    continue
                while step < size // 4:
                    halves = block[:, ::2].copy()
                    halves[:, : block.shape[1] // 2] = np.minimum(halves[:, : block.shape[1] // 2], block[:, 1::2])
                    block, step = halves, step * 2
                low = block.copy()
                for j in range(1, min(4, block.shape[1])):
                    low[:, :-j] = np.minimum(low[:, :-j], block[:, j:])
                key = low.ravel()
                near = np.flatnonzero(likely[key & LOW])
                at = np.searchsorted(keys, key[near])
                for w, first in zip(near.tolist(), at.tolist(), strict=True):
                    for i in range(first, len(keys)):
                        if keys[i] != key[w]:
                            break
                        found.add((int(owners[i]), w % low.shape[1] * step, size))
        return found

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        words = WORD.findall((text or "").lower())
        if len(words) < SHINGLE:
            return []
        s = shingles(self.hashes(words), SHINGLE)
        passed = []
        for k, start, size in sorted(self._retrieved(s)):
            name, _, need = self.templates[k]
            lo, hi = max(0, start - size // 4), min(len(words), start + size + size // 4 + SHINGLE)
            there = [i for i in range(lo, hi - SHINGLE + 1) if tuple(words[i : i + SHINGLE]) in need]
            n = len({tuple(words[i : i + SHINGLE]) for i in there})
            if n >= self.contained * len(need):
                passed.append((-n, -n / len(need), name, there))
        best: dict[str, tuple[float, int, int]] = {}
        taken: dict[int, str] = {}
        for _, share, name, there in sorted(passed):
            if 2 * sum(taken.get(i, name) != name for i in there) >= len(there):
                continue
            for i in there:
                taken.setdefault(i, name)
            if name not in best or -share > best[name][0]:
                best[name] = -share, there[0], there[-1] + SHINGLE - there[0]
        return [(name, *got) for name, got in sorted(best.items())]


@lru_cache(1)
def _scanner() -> Scanner:
    return Scanner(TEMPLATES)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted names) and matches of each document, in one pass without exchange."""

    def start():
        scanner = _scanner() if templates is None else Scanner(templates)

        def row(doc_id, text):
            got = scanner.matches(text)
            return doc_id, len(got), [g[0] for g in got], [f"{name}@{at}+{n}={share:.3f}" for name, share, at, n in got]

        return row

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_licenses long, licenses array<string>, matches array<string>", start)
