"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

For each template length, every window of as many 5-word shingles as the template has is sketched by MinHash. Windows
start at every word for short templates and at an eighth of the length for longer ones, so some window overlaps any copy
almost whole. A window that agrees with a template in all rows of one band is a candidate, and the best window less than a step
away from it counts. A window that holds a share c of a template's shingles has similarity c / (2 - c) with it, 2 / 3 at
the least containment of 0.8; the window that is tried may lie half a step, a sixteenth of the length, off and hold that
much less: 0.7375, similarity 0.584. With 16 bands of 2 rows it collides with probability 1 - (1 - 0.584 ** 2) ** 16 > 0.998,
and each further window of a copy is another chance. Punctuation at the edges of words counts on neither side, nor do words of punctuation only, such as
comment marks.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, words_of

WIDTH = 5
_U = np.uint64
_EDGES = string.punctuation.encode()
_CURLY = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"'}

# License notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}

# Public license texts and the notices that their publishers ask for, by SPDX identifier and part.
FULL_TEXTS = {
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-third": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "Zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0-full": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor.""",
    "Unlicense-full": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication
to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "GPL-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "LGPL-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to
the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
    "AGPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more
details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License
2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC0-1.0-notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring
rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have
received a copy of the CC0 Public Domain Dedication along with this software.""",
    "CC-BY-4.0-notice": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of
this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain
View, CA 94042, USA.""",
    "CC-BY-SA-4.0-notice": """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To
view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box
1866, Mountain View, CA 94042, USA.""",
}


def bare_words(text: str | None) -> tuple[list[bytes], list[int]]:
    """The words of a text without punctuation at their edges, and the place of each among all its words."""
    if text and not text.isascii():
        for curly, plain in _CURLY.items():
            text = text.replace(curly, plain)
    words = [w.strip(_EDGES) for w in words_of(text)]
    if all(words):
        return words, list(range(len(words)))
    places = [k for k, w in enumerate(words) if w]
    return [words[k] for k in places], places


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """A hash for each 5-word window in order; none for fewer words."""
    if len(words) < WIDTH:
        return np.zeros(0, _U)
    w = np.array(list(map(xxhash.xxh3_64_intdigest, words)), _U)
    out = w[: len(w) - WIDTH + 1].copy()
    for k in range(1, WIDTH):
        out = _mixed(out) + w[k : k + len(out)] * _U(0x9E3779B97F4A7C15)
    return _mixed(out)


@dataclass(frozen=True)
class Bands:
    bands: int = 16
    rows: int = 2

    def hashed(self, found: np.ndarray) -> np.ndarray:
        """One row for each hash function, one column for each shingle: 32 bits, as candidates are verified."""
        salts = _mixed(np.arange(1, self.bands * self.rows + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))
        out = found[None, :] ^ salts[:, None]
        out *= _U(0x9E3779B97F4A7C15)
        out >>= _U(32)
        return out.astype(np.uint32)

    def collide(self, minima: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """For each window (columns of ``minima``) whether it agrees with a sketch in all rows of a band."""
        same = minima == sketch[:, None]
        return same.reshape(self.bands, self.rows, -1).all(axis=1).any(axis=0)


class Scanner:
    """Templates by length, with their sketches."""

    def __init__(self, templates: dict[str, str], bands: Bands = Bands(), least: float = 0.8):
        self.bands, self.least = bands, least
        self.by_length: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}
        for name in sorted(templates):
            found = shingles(bare_words(templates[name])[0])
            if not len(found):
                raise ValueError(f"{name}: a template needs {WIDTH} words")
            self.by_length.setdefault(len(found), []).append((name, np.unique(found), bands.hashed(found).min(axis=1)))

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, containment) of each match; of overlapping ones of a template the best."""
        words, places = bare_words(text)
        found = shingles(words)
        out: list[tuple[str, int, int, float]] = []
        if not len(found):
            return out
        hashed = self.bands.hashed(found)
        minima, width = hashed, 1
        for length in sorted(self.by_length):
            if len(found) < self.least * length:
                break
            size = min(length, len(found))
            while width * 2 <= size:  # minima over windows of twice the width
                minima = np.minimum(minima[:, :-width], minima[:, width:])
                width *= 2
            step, last = max(1, length // 8), len(found) - size
            starts = np.arange(0, last + 1, step)
            if starts[-1] != last:
                starts = np.append(starts, last)
            if step == 1:
                windows = minima[:, : last + 1] if size == width else np.minimum(minima[:, : last + 1], minima[:, size - width :][:, : last + 1])
            else:
                windows = np.minimum(minima.take(starts, axis=1), minima.take(starts + (size - width), axis=1))
            for name, wanted, sketch in self.by_length[length]:
                best: list[tuple[int, float]] = []
                for start in starts[self.bands.collide(windows, sketch)]:
                    near = range(max(0, start - step + 1), min(last, start + step - 1) + 1)
                    inside, at = max((np.isin(wanted, found[x : x + size]).mean(), -x) for x in near)
                    at = -at
                    if inside < self.least:
                        continue
                    if best and at < best[-1][0] + size:
                        if inside > best[-1][1]:
                            best[-1] = (int(at), float(inside))
                    else:
                        best.append((int(at), float(inside)))
                out += [(name, places[at], places[at + size + WIDTH - 2] + 1, inside) for at, inside in best]
        return sorted(out, key=lambda m: (m[1], m[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: Bands = Bands(), least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, first_word, end_word, containment): each place of a whole text that holds at least ``least`` of a
    template's distinct shingles within a window of its length.

    Of overlapping places of one template the best has a row, of equally good ones the first; overlapping templates have
    a row each. Null, empty and short texts have no rows; very long ones are scanned whole; repeated rows are scanned each;
    null ids are kept; other columns of ``docs`` are not read, whatever their names; an empty table gives no rows. Templates
    (by default ``TEMPLATES`` and ``FULL_TEXTS``) are a short configured list that goes with the code; documents stay where
    they are.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES | FULL_TEXTS, bands, least))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            at, made = [], []
            for k, t in enumerate(batch.column("text")):
                got = scanner.value.matches(t.as_py())
                at += [k] * len(got)
                made += got
            columns = [batch.column("id").take(pa.array(at, pa.int64()))]
            columns += [pa.array([m[c] for m in made], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "license", "first_word", "end_word", "containment"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, license string, first_word long, end_word long, containment double").withColumnRenamed("id", doc_id)
