"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut into word k-grams; of every window of k-grams the least hash is kept
(winnowing), and an inverted index maps it to template and place.  The index is small and
goes to every task.  Each place of a text whose k-gram is in the index votes for a template
and a shift; around the shifts that are close to one another (within half a template) the template is aligned with
the text in a band, which gives the share of its words that match, in order, and the span.
A notice or header that differs from its neighbours by a word also needs one of its
identifying phrases, unbroken, in the span.  Of overlapping spans the best matched template stays.
"""

from __future__ import annotations

from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import hashed, mix64, slices, table, words_of

GRAM, WINNOW = 3, 4
MIN_COVERAGE = 0.75
STRIP = ".,;:!?\"'()[]{}<>*#/-“”‘’"

DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Public notices, headers and whole short licences.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "bsd-notice": "Released under the BSD License.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the
        GNU General Public License along with this program. If not, see""",
    "lgpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have
        received a copy of the GNU Lesser General Public License along with this program. If not, see""",
    "agpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have
        received a copy of the GNU Affero General Public License along with this program. If not, see""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. """ + DISCLAIMER,
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright
        holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission. """ + DISCLAIMER,
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
        and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
        to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
        present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
_GNU = ["version {}", "version {}.0", "v{}", "v{}.0"]
#: Of these one phrase must stand in the span, word by word (the name, its variant and its version).
PHRASES = {
    "mit-notice": ["MIT License", "MIT Licence"],
    "bsd-notice": ["BSD License", "BSD Licence"],
    "apache-2.0-notice": ["Apache License Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License Version 2"],
    "apache-2.0-header": ["Apache License Version 2.0"],
    "mpl-2.0-notice": ["Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "Mozilla Public License v. 2.0"],
    "mpl-2.0-header": ["Mozilla Public License v. 2.0"],
    "gpl-3.0-notice": [f"GNU General Public License {v.format(3)}" for v in _GNU],
    "gpl-2.0-notice": [f"GNU General Public License {v.format(2)}" for v in _GNU],
    "lgpl-3.0-notice": [f"GNU Lesser General Public License {v.format(3)}" for v in _GNU],
    "lgpl-2.1-notice": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1"],
    "agpl-3.0-notice": [f"GNU Affero General Public License {v.format(3)}" for v in _GNU],
    "gpl-header": ["GNU General Public License"],
    "lgpl-header": ["GNU Lesser General Public License"],
    "agpl-header": ["GNU Affero General Public License"],
    "cc-by-4.0-notice": ["CC BY 4.0", "CC-BY 4.0"],
    "cc-by-sa-4.0-notice": ["CC BY-SA 4.0", "CC-BY-SA 4.0"],
    "cc-by-nc-4.0-notice": ["CC BY-NC 4.0", "CC-BY-NC 4.0"],
}


def _clean(names: list[str]) -> np.ndarray:
    return hashed([w.strip(STRIP) or w for w in names])


def grams(w: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(w) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM if len(out) else 0):
        out = mix64(out + w[i : len(w) - GRAM + 1 + i])
    return out


def winnowed(g: np.ndarray) -> list[int]:
    """Places of the kept k-grams: the last of the least in every window (a short text: of all)."""
    size = min(WINNOW, len(g))
    return sorted({int(i + size - 1 - np.argmin(g[i : i + size][::-1])) for i in range(len(g) - size + 1)}) if len(g) else []


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names, self.words, rows = list(templates), [], []
        # An own template of a known name has its own words.
        own = [PHRASES.get(n, []) if templates[n] == TEMPLATES.get(n) else [] for n in self.names]
        self.phrases = [[_clean(p.lower().split()) for p in ps] for ps in own]
        for t, text in enumerate(templates.values()):
            flat, _ = words_of(pa.array([text]), lower=True)
            w = _clean(flat.to_pylist())
            self.words.append(w)
            g = grams(w)
            rows += [(int(g[i]), t, i) for i in (winnowed(g) if len(g) > WINNOW else range(len(g)))]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.at = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)


def slack(template: np.ndarray) -> int:
    """Words that a copy may have more, or fewer, than the template in one place."""
    return len(template) // 2


def aligned(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first place, end) of the best in-order match of the template, shifted by ``low`` to ``high``.

    Of equally good matches the shortest, then the first.  A cell of a row is one number:
    matched words, then the place where the match began (late is better), then its end.
    """
    m, width = len(template), high - low + 1
    k = m + width + 2
    best = np.zeros(width, np.int64)
    found = (0, 0, 0, 0)
    for i in range(m):
        first = max(0, -(i + low))  # places before the text
        own = text[i + low + first : i + high + 1] if i + high >= 0 else text[:0]
        on = first + np.flatnonzero(own == template[i])
        row = np.append(best[1:], 0)  # the template word is skipped
        if len(on):
            place, before = i + on, best[on]
            new = np.where(before > 0, before // k * k + k * k, k * k + place * k) + (k - 2 - place)
            n, start = new // (k * k), new // k % k
            at = np.lexsort((start, place + 1 - start, -n))[0]
            found = max(found, (int(n[at]), int(start[at] - place[at] - 1), int(-start[at]), int(place[at] + 1)))
            row[on] = np.maximum(row[on], new)
        best = np.maximum.accumulate(row)  # text words are skipped
    n, _, start, end = found
    return n, low - start, low + end


def _holds(w: np.ndarray, phrases: list[np.ndarray]) -> bool:
    return not phrases or any((w[i : i + len(p)] == p).all() for p in phrases for i in range(len(w) - len(p) + 1))


def matches(w: np.ndarray, index: Index):
    """(template, matched, start, end) of every copy in one text; of overlapping spans the one
    with the most matched over unmatched template words, and of the others what still matches beside it."""
    kept: list[tuple[int, int, int, int]] = []
    for t, n, start, end, low, high in sorted(_copies(w, index), key=lambda x: (len(index.words[x[0]]) - 2 * x[1], x[2], x[0])):
        at = bisect(kept, start, key=lambda x: x[2])
        left = kept[at - 1][3] if at else 0
        right = kept[at][2] if at < len(kept) else len(w)
        if start < left or end > right:  # what is between its neighbours, aligned anew
            if left >= right or not (own := _copy(w[left:right], index, t, low - left, high - left)):
                continue
            n, start, end = own[0], own[1] + left, own[2] + left
        kept.insert(at, (t, n, start, end))
    yield from kept


def _copy(w: np.ndarray, index: Index, t: int, low: int, high: int) -> tuple[int, int, int] | None:
    n, start, end = aligned(index.words[t], w, low, high)
    # One more word: a version written otherwise than in the template ends after the last match.
    return (n, start, end) if n >= MIN_COVERAGE * len(index.words[t]) and _holds(w[start : end + 1], index.phrases[t]) else None


def _copies(w: np.ndarray, index: Index):
    """(template, matched, start, end, lowest and highest shift) of every copy in one text."""
    g = grams(w)
    if not len(g) or not len(index.hash):
        return
    lo, hi = np.searchsorted(index.hash, g, "left"), np.searchsorted(index.hash, g, "right")
    on = np.flatnonzero(hi > lo)
    votes = sorted({(int(t), int(p - i)) for p in on for t, i in index.at[lo[p] : hi[p]]})
    group: list[tuple[int, int]] = []
    for vote in [*votes, (-1, 0)]:
        if group and (vote[0] != group[0][0] or vote[1] - group[0][1] > slack(index.words[group[0][0]])):
            t = group[0][0]
            more = slack(index.words[t])
            low, high = group[0][1] - more, group[-1][1] + more
            if own := _copy(w, index, t, low, high):
                yield t, *own, low, high
            group = []
        group.append(vote)


def _scanned(index: Index, key: str):
    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                flat, counts = words_of(b.column(1), lower=True)
                enc = flat.dictionary_encode()
                w = _clean(enc.dictionary.to_pylist())[enc.indices.to_numpy()]
                ends = np.cumsum(counts)
                g = grams(w)
                hit = np.isin(g, index.hash)
                rows = []
                for r in np.unique(np.searchsorted(ends, np.flatnonzero(hit), side="right")).tolist():
                    own = w[ends[r] - counts[r] : ends[r]]
                    rows += [(r, index.names[t], n, len(index.words[t]), s, e) for t, n, s, e in matches(own, index)]
                r, name, n, size, s, e = zip(*rows) if rows else [()] * 6
                n, size = np.array(n, np.int64), np.array(size, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r, pa.int64())), pa.array(name, pa.string()), pa.array(n), pa.array(size), pa.array(n / size if len(n) else [], pa.float64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], [key, "license", "matched_words", "template_words", "coverage", "start_word", "end_word"])

    return run


def license_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each copy of a template in a text: key, license, matched_words,
    template_words, coverage, start_word, end_word (words are numbered from 0).

    Null and wordless texts give no rows; a null key stays null, repeated rows are scanned
    one by one, texts of any length whole; other columns, whatever their names, are not read.
    A template of fewer than three words never matches.  Of equally good spans the shortest
    counts, then the first.  No row moves between machines.
    """
    index = Index(TEMPLATES if templates is None else templates)
    schema = f"`{key}` long, license string, matched_words long, template_words long, coverage double, start_word long, end_word long"
    return docs.select(docs[key].cast("long").alias(key), text).mapInArrow(_scanned(index, key), schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op7_licenses": op7_licenses}
