"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.

Words are runs of letters and digits, lower case; shingles are five words. For each size p = 1, 2, 4, ... windows of 2 p
shingles start every p shingles over the whole text, so a template of at most p shingles lies whole within one of them and
covers a quarter of it at least. With at least CONTAINED of the template there, their Jaccard similarity is 0.19 or more,
and one of BANDS one-row bands agrees with a probability over 0.9997 (1 - 0.81 ** 40).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text
from ._spark import blocks

BANDS, CONTAINED = 40, 0.8
_U = np.uint64
_FACTORS = np.random.default_rng(3).integers(1, 1 << 63, BANDS, dtype=np.uint64) * _U(2) + _U(1)
_WORDS = bytes(c if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127) else 32 for c in range(256))

#: Wording of common license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


#: Characters of templates that the driver takes from a table.
MOST_TEMPLATES = 64 << 20


def templates_of(table: DataFrame) -> dict[str, list[str]]:
    """A table (license, text) of templates, such as full license texts, for scan_licenses; ValueError over MOST_TEMPLATES."""
    rows = table.select(F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text")).where("license is not null and text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MOST_TEMPLATES:
        raise ValueError(f"{size} characters of templates; scan with several tables of at most {MOST_TEMPLATES}")
    out: dict[str, list[str]] = {}
    for r in sorted(rows.collect()):
        out.setdefault(r["license"], []).append(r["text"])
    return out


def _plain(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_WORDS)


class Templates:
    """Shingle sets of the templates and, for each window size, the band values that lead to them."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.sets = [], []
        for name in sorted(templates):
            for text in templates[name]:
                h, first, *_ = _text.words([_plain(text)])
                if first[-1] >= 5:
                    self.names.append(name)
                    self.sets.append(np.unique(_text.shingles(h, first)[0]))
        #: size p -> (sorted band values, the template of each), band by band
        self.bands: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size in sorted({self._size(k) for k in range(len(self.sets))}):
            own = [k for k in range(len(self.sets)) if self._size(k) == size]
            rows = []
            for f in _FACTORS:
                value = np.array([(self.sets[k] * f).min() for k in own])
                order = np.argsort(value)
                rows.append((value[order], np.array(own)[order]))
            self.bands[size] = rows

    def _size(self, k: int) -> int:
        return 1 << int(len(self.sets[k]) - 1).bit_length()

    def find(self, texts: list[str | None]) -> list[dict[str, float]]:
        """For each text: license -> share of a template's shingles, at most over its templates and places."""
        found: list[dict[str, float]] = [{} for _ in texts]
        h, first, *_ = _text.words([_plain(t) for t in texts])
        s, at = _text.shingles(h, first)
        if not len(s):
            return found
        hits: set[tuple[int, int]] = set()
        largest = max(self.bands)
        for band, factor in enumerate(_FACTORS):
            low, size = s * factor, 1
            while True:
                if size in self.bands:
                    window = np.minimum(low[:-1], low[1:]) if len(low) > 1 else low
                    values, owner = self.bands[size][band]
                    near = np.flatnonzero((window >= values[0]) & (window <= values[-1]))
                    k = np.searchsorted(values, window[near])
                    same = values[np.minimum(k, len(values) - 1)] == window[near]
                    for w, v in zip(near[same].tolist(), k[same].tolist(), strict=True):
                        while v < len(values) and values[v] == window[w]:
                            hits.add((int(owner[v]), w * size))
                            v += 1
                if size >= largest:
                    break
                if len(low) % 2:
                    low = np.append(low, _U(0xFFFFFFFFFFFFFFFF))
                low = low.reshape(-1, 2).min(axis=1)
                size *= 2
        for k, start in hits:
            size, own = self._size(k), self.sets[k]
            region = s[max(0, start - size) : start + 3 * size]
            lo = max(0, start - size)
            doc_of = np.searchsorted(at, lo + np.arange(len(region)), "right") - 1
            for doc in np.unique(doc_of).tolist():
                share = float(np.isin(own, region[doc_of == doc]).sum() / len(own))
                if share >= CONTAINED and share > found[doc].get(self.names[k], 0.0):
                    found[doc][self.names[k]] = round(share, 6)
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, license, contained) for every license a document holds a template of.

    contained: the share of the template's shingles, CONTAINED at least. Null, empty and short texts hold none; templates
    of fewer than five words are not searched for. Texts of any length are whole; of several templates of a license the
    share of the one that is held most is told. Repeated rows give rows each; extra columns are not read; an empty table
    gives an empty table. templates travel with the tasks: the list above, or what templates_of() takes from a table.
    """
    np.seterr(over="ignore")
    known = Templates(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in blocks(batches):
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[k], name, share) for k, own in enumerate(known.find(b.column("text").to_pylist())) for name, share in sorted(own.items())] if known.sets else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "license", "contained"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, contained double")
