"""License scans: stretches of normalised text against licence templates by the Dice coefficient over word bigrams.

Dice(W, T) = 2 |W n T| / (|W| + |T|) over multisets of bigrams. A stretch can reach the threshold t only if its size is
within [t / (2 - t), (2 - t) / t] times the template's, and only if it holds at least t / (2 - t) of the template's bigrams.
These bounds prune templates for short texts and nearly all positions; what is left is measured exactly.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .streams import small_batches

#: Licence id, template name, text (public licence notices).
TEMPLATES = (
    ("MIT", "statement", "Released under the MIT License."),
    ("MIT", "statement-2", "Licensed under the MIT License."),
    ("MIT", "permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "disclaimer", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("Apache-1.1", "statement", "Licensed under the Apache License, Version 1.1."),
    ("Apache-2.0", "statement", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "statement", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "statement", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("Zlib", "permission", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "statement", "Distributed under the Boost Software License, Version 1.0."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "statement", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "sentence", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "statement", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "sentence", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "statement", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "sentence", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "sentence", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "sentence", "This is free and unencumbered software released into the public domain."),
)

#: What follows the conditions in whole licences (public texts).
BSD_DISCLAIMER = "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
ISC_DISCLAIMER = "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
ZLIB_WARRANTY = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
ZLIB_RESTRICTIONS = "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."


def _whole() -> tuple:
    """Whole bodies of the short licences, so that one of them is one stretch and not a stretch for each paragraph."""
    text = {(licence, name): t for licence, name, t in TEMPLATES}
    return (
        ("MIT", "whole", f"{text['MIT', 'permission']} {text['MIT', 'disclaimer']}"), ("BSD-3-Clause", "whole", f"{text['BSD-3-Clause', 'conditions']} {BSD_DISCLAIMER}"),
        ("BSD-2-Clause", "whole", f"{text['BSD-2-Clause', 'conditions']} {BSD_DISCLAIMER}"), ("ISC", "whole", f"{text['ISC', 'permission']} {ISC_DISCLAIMER}"),
        ("Zlib", "whole", f"{ZLIB_WARRANTY} {text['Zlib', 'permission']} {ZLIB_RESTRICTIONS}"))


TEMPLATES += _whole()

WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def normalise(text: str) -> list[re.Match]:
    """Words of a text: runs of letters and digits, numbers with their decimals; lower-cased by the caller."""
    return list(WORDS.finditer(text))


class Templates:
    """The vocabulary and bigrams of a list of templates."""

    def __init__(self, templates=TEMPLATES, least: float = 0.8):
        self.least, self.ids = least, {}
        words = [WORDS.findall(t.lower()) for _, _, t in templates]
        for w in words:
            for x in w:
                self.ids.setdefault(x, len(self.ids) + 1)
        self.side = len(self.ids) + 1
        self.items = []
        for (licence, name, _), w in zip(templates, words, strict=True):
            have = Counter(a * self.side + b for a, b in zip(map(self.ids.get, w), map(self.ids.get, w[1:]), strict=False))
            size = sum(have.values())
            need = math.ceil(least * size / (2 - least) - 1e-9)
            span = math.floor((2 - least) * size / least + 1e-9)
            of = np.zeros(self.side * self.side, bool)
            of[list(have)] = True
            self.items.append((licence, name, have, size, need, span, of))
        self.any = np.logical_or.reduce([x[-1] for x in self.items])

    def stretches(self, bigrams: np.ndarray) -> Iterator[tuple[str, str, float, int, int]]:
        """(licence, template, Dice, first bigram, last bigram): of overlapping stretches over the threshold the best, ties to the
        leftmost and shortest; of templates that claim the same place the one with the highest Dice, ties to the longest and then to the first listed.
        A stretch that contains several of those taken, all of its own licence, replaces them: a whole licence with a name put in is one."""
        at = np.flatnonzero(self.any[bigrams])
        found = []
        for rank, (licence, name, have, size, need, span, of) in enumerate(self.items):
            if len(at) < need:
                continue
            p = at[of[bigrams[at]]]
            if len(p) < need:
                continue
            for i in np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] < span):
                left, common = dict(have), 0
                for j in range(i, len(p)):
                    width = int(p[j] - p[i]) + 1
                    if width > span:
                        break
                    b = int(bigrams[p[j]])
                    if left[b]:
                        left[b] -= 1
                        common += 1
                        dice = 2 * common / (width + size)
                        if dice >= self.least - 1e-12:
                            found.append((-dice, -size, rank, int(p[i]), int(p[j])))
        found.sort()
        starts: list[int] = []  # of what is taken, ascending, and the ends beside them: these stretches don't overlap
        ends: list[int] = []
        held: list[tuple[int, float]] = []
        for dice, _, rank, a, b in found:
            k = bisect_left(starts, a)
            if (k == len(starts) or starts[k] > b) and (k == 0 or ends[k - 1] < a):
                starts.insert(k, a)
                ends.insert(k, b)
                held.insert(k, (rank, -dice))
        for dice, _, rank, a, b in found:
            lo, hi = bisect_left(ends, a), bisect_right(starts, b)
            if hi - lo > 1 and a <= starts[lo] and ends[hi - 1] <= b and all(self.items[r][0] == self.items[rank][0] for r, _ in held[lo:hi]):
                starts[lo:hi], ends[lo:hi], held[lo:hi] = [a], [b], [(rank, -dice)]
        for (rank, dice), a, b in zip(held, starts, ends, strict=True):
            yield *self.items[rank][:2], dice, a, b


def scan(docs: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, license_id, template, dice, start, end: one row per stretch found.

    start and end are code points of the whole text, end exclusive. Documents without a stretch, and null or empty texts, give no row;
    null doc_ids and repeated rows are scanned like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        get = known.ids.get
        for b in batches:
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or ""
                low = text.lower()
                if len(low) != len(text):
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                ids = np.array([get(w, 0) for w in WORDS.findall(low)], np.int64)
                if len(ids) < 2:
                    continue
                pairs = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * known.side + ids[1:], 0)
                if not known.any[pairs].any():
                    continue
                found = sorted(known.stretches(pairs), key=lambda x: x[3:])
                if found:
                    words = normalise(low)
                    out += [(doc, lic, name, dice, words[i].start(), words[j + 1].end()) for lic, name, dice, i, j in found]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "license_id", "template", "dice", "start", "end"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, license_id string, template string, dice double, start long, end long")
