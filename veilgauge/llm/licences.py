"""Licence scan: sparse TF-IDF cosine of headers and whole files to templates, inherited along directories.

Document frequencies are counted for the words of the templates over all files. Each
sentence or line of a text, each block of consecutive ones up to the length of a header,
and the text as a whole is a sparse vector; the best cosine to a template decides. A file without a licence of its own takes that of the licence file
in its nearest ancestor directory, found by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.llm.common import columns_or_raise
from veilgauge.session import materialise

#: Names of files that hold the licence of their directory.
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-].*)?$"
THRESHOLD = 0.6
#: A block of sentences or lines has at most so many times the words of the longest template.
LONGER = 1.5

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.")
#: Customary notices per licence, as people write them.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at apache org licenses LICENSE-2.0"],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
                "SPDX-License-Identifier: GPL-3.0-only",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
                "SPDX-License-Identifier: GPL-2.0-or-later",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
                 "SPDX-License-Identifier: LGPL-2.1-or-later",
                 "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only",
                 "SPDX-License-Identifier: LGPL-3.0-or-later",
                 "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
                 "SPDX-License-Identifier: AGPL-3.0-or-later",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
                     _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright to this work."],
}
#: Per licence, what the words of a match (joined by blanks) have to hold, and what they may not: the terms that
#: tell it from its neighbours and other versions. Without them a near text gives no licence.
_COPYLEFT = r"(?:version|v|gplv?|licen[cs]e) ?"
TELLING = {
    "MIT": (r"\bmit\b|free of charge", r"(?!)"),
    "ISC": (r"\bisc\b|with or without fee is hereby granted provided", r"(?!)"),
    "Apache-2.0": (r"\b(?:version|v|apache|licen[cs]es?) ?(?:licen[cs]e )?2\b(?! [1-9])", r"(?!)"),
    "GPL-3.0": (rf"{_COPYLEFT}3\b(?! [1-9])", r"\b(?:lesser|library general|affero|lgpl\w*|agpl\w*)\b"),
    "GPL-2.0": (rf"{_COPYLEFT}2\b(?! [1-9])", r"\b(?:lesser|library general|affero|lgpl\w*|agpl\w*)\b"),
    "LGPL-2.1": (rf"\A(?=.*\b(?:lesser|lgpl\w*)\b).*{_COPYLEFT}2 1\b", r"(?!)"),
    "LGPL-3.0": (rf"\A(?=.*\b(?:lesser|lgpl\w*)\b).*{_COPYLEFT}3\b(?! [1-9])", r"(?!)"),
    "AGPL-3.0": (rf"\A(?=.*\b(?:affero|agpl\w*)\b).*{_COPYLEFT}3\b(?! [1-9])", r"(?!)"),
    "MPL-2.0": (r"\b(?:version|v|mpl|licen[cs]e) ?2\b(?! [1-9])", r"(?!)"),
    "BSD-3-Clause": (r"\b3 clause|neither the names? ", r"\ball advertising materials\b"),
    "BSD-2-Clause": (r"\b2 clause|redistributions in binary form must reproduce", r"\b[34] clause|neither the names? |\ball advertising materials\b"),
    "CC-BY-4.0": (r"\b4 0\b", r"\b(?:sa|sharealike|share alike|nc|noncommercial|nd|noderiv\w*)\b"),
    "CC-BY-SA-4.0": (r"\A(?=.*\b(?:sa|sharealike|share alike)\b).*\b4 0\b", r"\b(?:nc|noncommercial|nd|noderiv\w*)\b"),
    "CC-BY-NC-4.0": (r"\A(?=.*\b(?:nc|noncommercial)\b).*\b4 0\b", r"\b(?:sa|sharealike|share alike|nd|noderiv\w*)\b"),
    "CC0-1.0": (r"\bcc0\b|waived all copyright", r"(?!)"),
}
_TELLING = {licence: (re.compile(need), re.compile(never)) for licence, (need, never) in TELLING.items()}
_ANY = (re.compile(""), re.compile(r"(?!)"))
#: Clauses beside a match that make it a part of another licence, looked for as far as a block may reach.
_BESIDE = {"BSD-2-Clause", "BSD-3-Clause"}
_TERM = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"\n+|(?<=[.!?;])\s+")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Weights:
    """TF-IDF vectors of the templates, and what a text must hold to come near one."""

    def __init__(self, files: int, frequency: dict[str, int], threshold: float,
                 templates: dict[str, list[str]] | None = None) -> None:
        self.idf = {w: math.log((files + 1) / (n + 1)) + 1 for w, n in frequency.items()}
        self.other = math.log(files + 1) + 1  # a word of no template counts as rare
        self.threshold = threshold
        self.vectors, self.core = [], set()
        self.longest = 0
        for licence, notices in sorted((templates or TEMPLATES).items()):
            for notice in notices:
                vector = {w: n * self.idf[w] for w, n in Counter(terms(notice)).items()}
                norm = math.sqrt(sum(x * x for x in vector.values()))
                self.vectors.append((licence, {w: x / norm for w, x in vector.items()}))
                self.longest = max(self.longest, int(LONGER * len(terms(notice))))
                # Without the heaviest words the rest of the template is too light for the threshold.
                rest = 1.0
                for w, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
                    if rest < threshold * threshold:
                        break
                    self.core.add(w)
                    rest -= (x / norm) ** 2
        self.place = {w: i for i, w in enumerate(sorted(frequency))}
        self.matrix = np.zeros((len(self.vectors), len(self.place)))
        for t, (_, vector) in enumerate(self.vectors):
            for w, x in vector.items():
                self.matrix[t, self.place[w]] = x
        self.squares = np.ascontiguousarray(self.matrix ** 2)

    def best(self, words: list[str], beside: list[str] | None = None) -> tuple[float, str] | None:
        """Largest cosine at the threshold or above, and its licence; ties go to the first name.

        Licences whose telling terms the words lack are passed over. `beside`: the words
        with what stands before and after them.
        """
        counts = Counter(words)
        if self.core.isdisjoint(counts):
            return None
        vector = {w: n * self.idf.get(w, self.other) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        found = said = None
        for licence, template in self.vectors:
            cosine = sum(x * vector[w] for w, x in template.items() if w in vector) / norm
            if cosine >= self.threshold and (found is None or cosine > found[0] + 1e-12):
                said = said or " ".join(words)
                need, never = _TELLING.get(licence, _ANY)
                if need.search(said) and not never.search(" ".join(beside) if beside and licence in _BESIDE else said):
                    found = (cosine, licence)
        return found

    def blocks(self, units: list[list[str]]) -> Iterator[tuple[int, int]]:
        """First and last (exclusive) unit of the blocks of two or more consecutive units that can come near a template.

        A cosine is at most the norm of the template's part whose words occur, so most
        blocks need no vector. A block begins and ends with a unit that has a word of a
        template that it can reach.
        """
        held = [[self.place[w] for w in set(u) if w in self.place] for u in units]
        names = sorted({k for h in held for k in h})
        squares = self.squares[:, names]
        least = self.threshold * self.threshold - 1e-9
        reach = squares.sum(axis=1) >= least
        if not reach.any():
            return
        squares = squares[reach]
        at = {k: i for i, k in enumerate(names)}
        sums = np.zeros((len(units) + 1, len(names)), dtype=np.int32)
        for i, h in enumerate(held):
            sums[i + 1, [at[k] for k in h]] = 1
        has = sums[1:].astype(bool)
        np.cumsum(sums, axis=0, out=sums)
        lengths = np.concatenate([[0], np.cumsum([len(u) for u in units])])
        last = np.searchsorted(lengths, lengths[:-1] + self.longest, side="right") - 1  # a block ends before it
        for first in np.flatnonzero(((sums[last] - sums[:-1] > 0) @ squares.T >= least).any(axis=1) & (last - np.arange(len(units)) > 1)).tolist():
            ends = np.arange(first + 2, last[first] + 1)
            near = (sums[ends] - sums[first] > 0) @ squares.T >= least
            near &= (has[first] @ (squares > 0).T) & (has[ends - 1] @ (squares > 0).T)
            for end in ends[near.any(axis=1)].tolist():
                yield first, end

    def scan(self, text: str | None) -> tuple[tuple[float, str] | None, tuple[float, str] | None]:
        """Best match of any sentence or block of sentences, and of the whole text."""
        words = terms(text or "")
        if self.core.isdisjoint(words):
            return None, None
        units = [u for s in _SENTENCE.split(text) if (u := terms(s))]
        lengths = [0, *accumulate(map(len, units))]
        found = []
        for first, end in chain(((i, i + 1) for i in range(len(units))), self.blocks(units)):
            a, b = lengths[first], lengths[end]
            if not self.core.isdisjoint(words[a:b]) and (m := self.best(words[a:b], words[max(0, a - self.longest):b + self.longest])):
                found.append(m)
        return max(found, key=lambda m: m[0], default=None), self.best(words)


def frequencies(files: DataFrame, vocabulary: frozenset[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and in how many of them each word of the vocabulary occurs; bounded by the vocabulary."""
    kind = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            counts = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(terms(text or "")))
            yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), batch.num_rows], pa.int64())], kind.names)

    rows = files.select("text").mapInArrow(batches, kind).groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.pop(None, 0), {w: found.get(w, 0) for w in vocabulary}


def scan(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """`files` without text, with `licence`, `cosine`, `origin` and `from_path`.

    `files` has path and text. `origin` is "header" (a sentence matched), "file" (the
    whole text did), "inherited" (from the licence file `from_path` of the nearest
    ancestor directory, the file's own directory first) or "none". A licence file is
    one with a customary name and any match, or one whose whole text matches. Of
    several in a directory the best cosine counts, then the smallest path. A null path
    inherits nothing; null and empty texts match nothing; repeated rows stay. Columns
    named like an added one are replaced.
    """
    columns_or_raise(files, "path", "text")
    files = files.drop("licence", "cosine", "origin", "from_path", "_licence", "_cosine", "_whole", "_directory", "best", "ancestor")
    templates = templates or TEMPLATES
    vocabulary = frozenset(w for notices in templates.values() for n in notices for w in terms(n))
    weights = Weights(*frequencies(files, vocabulary), threshold, templates)
    kept = [c for c in files.columns if c != "text"]
    kind = T.StructType([*files.select(*kept).schema.fields, T.StructField("_licence", T.StringType()), T.StructField("_cosine", T.DoubleType()),
                         T.StructField("_whole", T.BooleanType())])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                sentence, whole = weights.scan(text)
                best = max((m for m in (sentence, whole) if m), key=lambda m: m[0], default=None)
                found.append((best[1], round(best[0], 9), whole is not None) if best else (None, None, False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, t) for x, t in zip(
                zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.float64(), pa.bool_()), strict=True))], kind.names)

    own, _ = materialise(files.select(*kept, "text").mapInArrow(batches, kind).withColumn(
        "_directory", F.regexp_replace("path", "/?[^/]*$", "")))
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_NAME), F.lit(False))
    declared = (own.where(F.col("_licence").isNotNull() & F.col("path").isNotNull() & (F.col("_whole") | named)).groupBy("_directory")
                .agg(F.min(F.struct((-F.col("_cosine")).alias("order"), F.col("path").alias("of"), "_licence", "_cosine")).alias("best"))
                .select(F.col("_directory").alias("ancestor"), "best"))
    steps = F.split("_directory", "/")
    ancestors = F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("ancestor"))), F.when(
        F.col("_directory") != "", F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(
            n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("ancestor")))).otherwise(F.array()))
    above = own.where(F.col("_directory").isNotNull()).select("_directory").distinct().select("_directory", F.inline(ancestors))
    nearest = (above.join(declared, "ancestor").groupBy("_directory")
               .agg(F.max_by("best", "depth").alias("best")))
    joined = own.join(nearest, "_directory", "left")
    has = F.col("_licence").isNotNull()
    return joined.select(
        *[F.col(c) for c in kept],
        F.coalesce("_licence", "best._licence").alias("licence"), F.coalesce("_cosine", "best._cosine").alias("cosine"),
        F.when(has & F.col("_whole"), "file").when(has, "header").when(F.col("best").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("best.of")).alias("from_path"))
