"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

A text is compared as a whole and in windows of a template's length, so that a notice inside other
text is found.  Sizes bound the coefficient: with a and b bigrams it is at most 2 min(a, b) / (a + b),
which leaves out templates that are too long or too short for a text.  Windows are looked at only
where enough of their bigrams belong to the template, counted for all windows at once.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from codemem.llm.common import Words, ascii_lower, over_texts, windows

# Wording of common licences and notices, and of the conditions that stand without their disclaimer.
TEMPLATES = {
    "MIT-notice": 'Released under the MIT License.',
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-notice": 'This work is licensed under the GNU General Public License, version 3.',
    "GPL-3.0": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "GPL-2.0": 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "LGPL-3.0": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "LGPL-2.1": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "AGPL-3.0": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
    "CC-BY-NC-4.0-notice": 'Licensed under CC BY-NC 4.0.',
    "CC-BY-4.0-notice": 'Licensed under CC BY 4.0.',
    "CC-BY-4.0": 'This work is licensed under a Creative Commons Attribution 4.0 International License.',
    "CC-BY-SA-4.0": 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    "CC-BY-NC-4.0": 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
    "CC-BY-NC-SA-4.0": 'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.',
    "CC0-1.0": 'To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.',
    "BSD-conditions": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-permission": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MPL-2.0": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    "EPL-2.0": 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
}
LEAST_DICE = 0.8


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """Lower-case letters, digits and bytes of other characters; anything else is a space."""
    table = ascii_lower().copy()
    keep = np.zeros(256, bool)
    keep[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    table[~keep[table]] = 32
    return table


def normalised(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(_plain()[data], offsets)


class Templates:
    """Bigrams of the templates; each distinct bigram knows, by bits, the templates that hold it."""

    def __init__(self, texts: dict[str, str]):
        self.names, self.grams, holders = [], [], {}
        for name, text in texts.items():
            data = np.frombuffer(text.encode(), np.uint8)
            h, _ = windows(normalised(data, np.array([0, len(data)])), 2)
            if len(h):
                for g in np.unique(h).tolist():
                    holders[g] = holders.get(g, 0) | 1 << len(self.names)
                self.names.append(name)
                self.grams.append(Counter(h.tolist()))
        if len(self.names) > 63:
            raise ValueError("at most 63 templates in one scan")
        self.sizes = [sum(g.values()) for g in self.grams]
        self.keys = np.array(sorted(holders), np.uint64)
        self.holders = np.array([holders[k] for k in sorted(holders)], np.int64)
        # A table of their first bits says at once that most bigrams are in no template.
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.first[(hashes >> np.uint64(48)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.keys, hashes[maybe]), max(0, len(self.keys) - 1))
        same = self.keys[spot] == hashes[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
        out[maybe[same]] = self.holders[spot[same]]
        return out


def dice(a: Counter, b: Counter) -> float:
    return 2 * (a & b).total() / max(1, a.total() + b.total())


def find(h: np.ndarray, masks: np.ndarray, templates: Templates, least: float) -> list[tuple[str, float, int, int]]:
    """``name, coefficient, first word, end word`` of the best match of each template in one text, none over another."""
    out = []
    n = len(h)
    any_ = int(np.bitwise_or.reduce(masks)) if n else 0
    for t, (name, grams, size) in enumerate(zip(templates.names, templates.grams, templates.sizes)):
        if not any_ >> t & 1 or 2 * min(n, size) < least * (n + size) and n < size:
            continue
        best = None
        if 2 * min(n, size) >= least * (n + size):
            d = dice(Counter(h.tolist()), grams)
            if d >= least:
                best = (d, 0, n + 1)
        width = min(n, size)
        hits = np.concatenate([[0], np.cumsum(masks >> t & 1)])
        inside = hits[width:] - hits[:-width]
        for i in np.flatnonzero(2 * inside >= least * (width + size)).tolist():
            d = dice(Counter(h[i : i + width].tolist()), grams)
            if d >= least and (best is None or d > best[0]):
                best = (d, i, i + width + 1)
        if best:
            out.append((name, *best))
    # Of templates that were found in the same place the nearest one counts, of equal ones the longest.
    chosen = []
    for x in sorted(out, key=lambda x: (-x[1], x[2] - x[3], x[0])):
        if all(x[3] <= y[2] or y[3] <= x[2] for y in chosen):
            chosen.append(x)
    return chosen


def scan(docs: DataFrame, texts: dict[str, str] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """``doc_id, licence, dice, first_word, end_word``: the best place of each template found in a text.

    Where the places of several templates overlap, only the one with the largest coefficient counts.

    Words are runs of letters, digits and non-ASCII characters, in lower case (A-Z); ends are
    exclusive; of equal coefficients the whole text and then the first window count.  Null and
    empty texts and those of one word have no bigrams and give no rows; repeated rows give theirs
    each; further columns are not read.
    """
    texts = TEMPLATES if texts is None else texts
    cache: list[Templates] = []

    def work(part, data, offsets):
        if not cache:
            cache.append(Templates(texts))
        templates = cache[0]
        words = normalised(data, offsets)
        h, at = windows(words, 2)
        masks = templates.masks(h)
        bounds = np.searchsorted(words.row[at], np.arange(part.num_rows + 1))
        hits = np.concatenate([[0], np.cumsum(masks != 0)])
        few = least * min(templates.sizes, default=1) / 2
        ids, out = part.column(0).to_pylist(), []
        for i in np.flatnonzero(hits[bounds[1:]] - hits[bounds[:-1]] >= max(1, few)).tolist():
            a, b = bounds[i], bounds[i + 1]
            out += [(ids[i], *x) for x in find(h[a:b], masks[a:b], templates, least)]
        columns = list(zip(*out)) or [[]] * 5
        return dict(zip(("doc_id", "licence", "dice", "first_word", "end_word"), columns))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return over_texts(rows, work, "doc_id long, licence string, dice double, first_word int, end_word int")
