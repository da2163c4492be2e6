"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are compared without ASCII case and without punctuation around them, in shingles of
five words (of a template's own length, if it is shorter). A document carries a license if
some window of it holds ``CONTAINED`` of the template's distinct shingles; the window is as long
as the template and a quarter longer.

Windows of the lengths 1, 2, 3, 4, 6, 8, 12, ... begin at every quarter of their power of two.
A template is looked up in the shortest kind that holds such an occurrence at every place,
which is at most 2.5 times as long as the template. So an occurrence and its window have a
Jaccard similarity of 0.8 / 2.7 at least, and with ``BANDS`` bands of one row the chance that
none agrees is below 1.4e-5, for the worst lengths. A window of one shingle is its shingle,
and one band is exact. Whatever a band retrieves is verified on the words.

Everything happens within a text, so the scan is one pass without a shuffle. Templates are a
small fixed set, checked against ``MAX_TEMPLATE_WORDS``.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.common import bounded, split_words

WIDTH, CONTAINED, SLACK = 5, 0.8, 1.25
BANDS = 32
MAX_TEMPLATE_WORDS = 100_000
EDGES = string.punctuation

# notices and headers of public licenses, fixed values
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_PLACES, _SALTS, _FACTORS = _odd(WIDTH, 31), _odd(BANDS, 32), _odd(BANDS, 33)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def plain_words(text: str) -> list[str]:
    """The words of a text as they are compared."""
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = (w.decode().translate(lower).strip(EDGES) for w in text.encode().split())
    return [w for w in words if w]


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out += hashes[k:k + n] * _PLACES[k]
    return out


class Scanner:
    """The templates, prepared for look-ups."""

    def __init__(self, templates: Mapping[str, str]):
        if sum(len(t.split()) for t in templates.values()) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        self.names = sorted(n for n, t in templates.items() if plain_words(t))
        self.shingles: list[frozenset[str]] = []
        self.width: list[int] = []
        #: window length by width: templates and their minimum per band
        self.kinds: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, name in enumerate(self.names):
            words = plain_words(templates[name])
            width = min(WIDTH, len(words))
            self.width.append(width)
            self.shingles.append(frozenset(" ".join(words[k:k + width]) for k in range(len(words) - width + 1)))
            hashes = _shingle_hashes(_word_hashes(words), width)
            least = ((hashes[None, :] ^ _SALTS[:, None]) * _FACTORS[:, None]).min(axis=1)
            self.kinds[width, self._window(len(self.shingles[i]))].append((i, least))

    @staticmethod
    def span(n_shingles: int) -> int:
        """Shingles of a window in which the containment counts."""
        return int(np.ceil(SLACK * n_shingles))

    def _window(self, n_shingles: int) -> int:
        """The shortest kind of window that holds such a span at every place."""
        if n_shingles == 1:
            return 1
        j = 0
        while True:
            for length in (1 << j, 3 << j - 1) if j else (1,):
                if length - self._stride(j) + 1 >= self.span(n_shingles):
                    return length
            j += 1

    @staticmethod
    def _stride(j: int) -> int:
        return max(1, 1 << j >> 2)

    def candidates(self, shingles: np.ndarray, width: int) -> dict[int, set[tuple[int, int]]]:
        """By template, the windows (first shingle, length) that share a band with it."""
        found: dict[int, set[tuple[int, int]]] = defaultdict(set)
        kinds = {length: of for (w, length), of in self.kinds.items() if w == width}
        longest = max(kinds, default=0)
        for band in range(BANDS if longest > 1 else 1):
            least, j, stride = (shingles ^ _SALTS[band]) * _FACTORS[band], 0, 1
            while len(least):
                for length in (1 << j, 3 << j - 1) if j else (1,):
                    if length not in kinds or length == 1 and band:
                        continue
                    shift = (length - (1 << j)) // stride
                    windows = np.minimum(least[:len(least) - shift], least[shift:]) if shift else least
                    for template, minima in kinds[length]:
                        for at in np.flatnonzero(windows == minima[band]).tolist():
                            found[template].add((at * stride, length))
                if 3 << j >= 2 * longest:
                    break
                reach, new = (1 << j) // stride, self._stride(j + 1)
                wide = np.minimum(least[:len(least) - reach], least[reach:]) if len(least) > reach else least[:0]
                least, stride, j = wide[::new // stride], new, j + 1
        return found

    def best(self, template: int, words: list[str], regions: list[tuple[int, int]]) -> tuple[int, int, float] | None:
        """(first word, number of words, containment) of the fullest window that begins in the regions, the first of equals."""
        width, wanted = self.width[template], self.shingles[template]
        span, last = self.span(len(wanted)), len(words) - width
        best = None
        for low, high in regions:
            hits = [(p, s) for p in range(max(0, low), min(high, last) + 1) if (s := " ".join(words[p:p + width])) in wanted]
            held: dict[str, int] = defaultdict(int)
            stop = 0
            for start, (p, s) in enumerate(hits):
                while stop < len(hits) and hits[stop][0] < p + span:
                    held[hits[stop][1]] += 1
                    stop += 1
                share = len(held) / len(wanted)
                if share >= CONTAINED and (best is None or share > best[2]):
                    best = (p, hits[stop - 1][0] + width - p, share)
                held[s] -= 1
                if not held[s]:
                    del held[s]
        return best

    def scan(self, texts: pa.Array) -> list[tuple[int, str, int, int, float]]:
        """(text, license, first word, number of words, containment) of a batch; words count without those of punctuation alone."""
        words, offsets = split_words(texts)
        if not len(words):
            return []
        coded = words.dictionary_encode()
        plain = pc.utf8_trim(pc.ascii_lower(coded.dictionary), characters=EDGES).to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False)
        real = np.array([w != "" for w in plain])[index]
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))[real]
        index = index[real]
        hashes = _word_hashes(plain)[index]
        edges = np.searchsorted(text, np.arange(len(texts) + 1))
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for width in sorted(set(self.width)):
            shingles = _shingle_hashes(hashes, width)
            if not len(shingles):
                continue
            # padded, so that windows may reach beyond the end; shingles across texts are verified away
            padded = np.concatenate([shingles, np.full(max(length for w, length in self.kinds if w == width), _NONE)])
            for template, windows in self.candidates(padded, width).items():
                span = self.span(len(self.shingles[template]))
                for at, length in windows:
                    inside = text[min(at, len(text) - 1):min(at + length + span, len(text))]
                    for t in np.unique(inside).tolist():
                        found[t, template].append((at - span - edges[t], at + length + span - edges[t]))
        rows = []
        for (t, template), regions in sorted(found.items()):
            merged: list[list[int]] = []
            for low, high in sorted(regions):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            best = self.best(template, [plain[i] for i in index[edges[t]:edges[t + 1]]], merged)
            if best:
                rows.append((t, self.names[template], *best))
        return rows


@lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, license, first_word, n_words, containment) of every license in every whole text of docs (doc_id, text).

    Per document and license the window of the highest containment, the first of equals.
    Null and empty texts have none; repeated rows are scanned each; templates without words
    are left out. Other columns are ignored.
    """
    fixed = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("license", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("containment", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(fixed)
        for batch in bounded(batches, "text"):
            rows = scanner.scan(batch.column("text"))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64()),
            ], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
