"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the template positions of the same hash. A copy of a template stretch gives hits
that share the offset (document position - template position): a diagonal. Hits are counted per document, template and diagonal; diagonals at most
GAP apart whose stretches follow each other closely are merged, as words put in or left out move the rest by a few
places. A merged span is verified in order: its score is the share of the template's k-grams in the longest chain of hits that rises in the document and in the
template, so words that merely occur, in another order, don't make a license.

Templates are a fixed table of a few thousand k-grams, checked against MAX_TEMPLATE_ROWS before it is broadcast; the join drops all other k-grams where they are made.
A document's hits are counted with partial aggregation. Base labels come from exact phrases and don't depend on the votes.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; they are hashed to 64 bits. Null and empty texts
have no words and no labels. Repeated rows are labelled alike, and of equal spans any gives the same label and score. Very long texts cost time and memory in proportion to their length. An empty
table gives an empty table. Only doc_id and the text are read, so extra columns can't clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartograph.llm.expr import attach, row_key

K = 3
GAP = 3  # words put in or left out between neighbouring diagonals
MAX_TEMPLATE_ROWS = 100_000

# Phrases and the labels they give.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)

# Wording of public licenses and usual notices, by label.
TEMPLATES = {
    "mit": [
        MIT_GRANT,
        f"{MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {WARRANTY}",
        "Released under the MIT License.",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd-2": [f"{BSD_HEAD} {BSD_TAIL}", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3": [
        f"{BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_TAIL}",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "bsl": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "gpl-2": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "agpl-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl-2": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "cc0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "cc-by-nc-sa": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "all-rights-reserved": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means", "All rights reserved."],
}

#: Letters in lower case, digits and non-ASCII bytes as they are, anything else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCANNED = "_id {kind}, _tx long, n_words long, n_base long, first_word long, last_word long, base array<string>"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbouring words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def template_table(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES, k: int = K) -> DataFrame:
    """label, template, n_grams, at, h of every template position."""
    rows = []
    for label, texts in templates.items():
        for i, text in enumerate(texts):
            h = gram_hashes(word_hashes(split_words(text.encode())), k).tolist()
            rows += [(label, f"{label}/{i}", len(h), j, x) for j, x in enumerate(h)]
    if len(rows) > MAX_TEMPLATE_ROWS:
        raise ValueError(f"{len(rows)} template k-grams are more than may be broadcast")
    return spark.createDataFrame(rows, "label string, template string, n_grams int, at int, h long")


def phrase_scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row a document, as SCANNED: base holds the labels of the phrases that stand in the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = [(p.encode().split(), label) for p, label in phrases.items()]
    first = {p[0] for p, _ in wanted}

    def one(t: bytes) -> tuple:
        w = split_words(t)
        starts = np.flatnonzero(np.fromiter(map(first.__contains__, w), bool, len(w))).tolist()
        hits = [(i, label) for i in starts for p, label in wanted if w[i : i + len(p)] == p]
        at = [i for i, _ in hits]
        return len(w), len(hits), min(at, default=None), max(at, default=None), sorted({x for _, x in hits})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
        for b in batches:
            found = list(zip(*[one(t or b"") for t in b.column(2).to_pylist()], strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, y) for x, y in zip(found, kinds, strict=True)]], ["_id", "_tx", "n_words", "n_base", "first_word", "last_word", "base"])

    return docs.select(*row_key(text=text), F.col(text).cast("binary")).mapInArrow(run, SCANNED.format(kind=kind))


def gram_scan(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """_id, _tx, pos, h of every word k-gram."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [gram_hashes(word_hashes(split_words(t or b"")), k) for t in b.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), each], ["_id", "_tx", "grams"])

    listed = docs.select(*row_key(text=text), F.col(text).cast("binary")).mapInArrow(run, f"_id {kind}, _tx long, grams array<long>")
    return listed.select("_id", "_tx", F.posexplode("grams").alias("pos", "h"))


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (pos, at) that rises strictly in both."""
    tails: list[int] = []
    last: list[int] = []
    before = []
    pairs = sorted(set(pairs), key=lambda p: (p[0], -p[1]))
    for n, (_, at) in enumerate(pairs):
        i = bisect_left(tails, at)
        before.append(last[i - 1] if i else -1)
        if i == len(tails):
            tails.append(at)
            last.append(n)
        else:
            tails[i], last[i] = at, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def spans(grams: DataFrame, templates: DataFrame, least: float = 0.8) -> DataFrame:
    """_id, _tx, label, template, first_word, last_word, score of the verified spans."""
    hits = grams.join(F.broadcast(templates), "h")
    doc = ["_id", "_tx", "label", "template", "n_grams"]
    diagonals = hits.groupBy(*doc, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_list(F.struct("pos", "at")).alias("hits")
    )
    # Neighbouring diagonals: in the order of their places, each joins the one before if it is near in both ways.
    order = Window.partitionBy("_id", "_tx", "template").orderBy("lo", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= GAP) & (F.col("lo") - F.lag("hi").over(order) <= F.col("n_grams"))
    merged = diagonals.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("span", F.sum("new").over(order))
    held = merged.groupBy(*doc, "span").agg(F.sum("votes").alias("votes"), F.flatten(F.collect_list("hits")).alias("hits")).where(F.col("votes") >= least * F.col("n_grams"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chains = [chain([(x["pos"], x["at"]) for x in h]) for h in b.column(5).to_pylist()]
            score = [len(c) / n for c, n in zip(chains, b.column(4).to_pylist(), strict=True)]
            columns = [*(b.column(i) for i in range(4)), pa.array([c[0][0] for c in chains], pa.int32()), pa.array([c[-1][0] for c in chains], pa.int32()), pa.array(score, pa.float64())]
            out = pa.RecordBatch.from_arrays(columns, ["_id", "_tx", "label", "template", "first_word", "last_word", "score"])
            yield out.filter(pa.array([x >= least for x in score], pa.bool_()))

    kind = grams.schema["_id"].dataType.simpleString()
    return held.select(*doc, "hits").mapInArrow(verify, f"_id {kind}, _tx long, label string, template string, first_word int, last_word int, score double")


def best_of_places(found: DataFrame) -> DataFrame:
    """The spans that are the best, by score, then length, on at least half of their words.

    Templates that differ in a version number match one place together; only the nearest one names its license. Equals stay.
    """
    span = ["_id", "_tx", "label", "template", "first_word", "last_word", "score"]
    worth = F.struct("score", (F.col("last_word") - F.col("first_word")).alias("length"))
    at = found.select(*span, worth.alias("worth"), F.explode(F.sequence("first_word", "last_word")).alias("at"))
    best = at.withColumn("best", F.max("worth").over(Window.partitionBy("_id", "_tx", "at")))
    won = best.groupBy(*span).agg(F.count_if(F.col("worth") == F.col("best")).alias("won"), F.count("*").alias("all"))
    return won.where("2 * won >= all").select(*span)


def license_labels(docs: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    verified = best_of_places(spans(gram_scan(docs, text), template_table(docs.sparkSession), least))
    voted = verified.groupBy("_id", "_tx").agg(F.collect_set("label").alias("voted"), F.max("score").alias("top"))
    joined = attach(phrase_scan(docs, text), voted)
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base"), F.coalesce(F.col("voted"), F.array().cast("array<string>")))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.col("top"), F.lit(0.0)))
    return joined.select(
        F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
