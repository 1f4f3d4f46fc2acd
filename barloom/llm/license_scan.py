"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm import align as A
from barloom.llm import text as T
from barloom.llm.decontaminate import grams, item_words

# Notices by which public licenses ask to be named, as their publishers word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "Apache-2.0-text",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "BSD-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
)
SCHEMA = "_id long, license string, coverage double, matched int, score int, start_char long, end_char long"


def winnow(keys: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Sorted indices of fingerprints: the least hash (rightmost of equals) of every `window` n-grams of one owner.

    An owner with fewer n-grams gives its least one.
    """
    n = len(keys)
    if not n:
        return np.empty(0, np.int64)
    best = np.arange(n)
    for k in range(1, window):
        other = np.minimum(np.arange(n) + k, n - 1)
        same = owner[other] == owner
        take = same & (keys[other] <= keys[best])
        best = np.where(take, other, best)
    full = owner[np.minimum(np.arange(n) + window - 1, n - 1)] == owner
    full &= np.arange(n) + window <= n
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    return np.unique(best[full | first])


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    min_coverage: float = 0.8,
    width: int = 3,
    window: int = 2,
    band: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, license, coverage, matched, score, start_char, end_char): every aligned stretch of a template.

    Words are runs of letters and digits in lower case. Texts and templates are winnowed alike, so a
    shared run of window + width - 1 words has a common fingerprint. Stretches around fingerprints
    are aligned within a band of `band` words about their diagonals, and reported if `min_coverage`
    of the template's words match. Each stretch counts, so a license that stands twice gives two
    rows. Spans are character positions in the text, the end exclusive. Null and empty texts match
    nothing; null ids are reported with a null id; repeated rows are reported each; templates
    shorter than `width` words never match; an empty table gives an empty result. Texts are read
    whole, without a shuffle. Other columns of the input are not read. `templates` is a parameter, so
    what is shipped to tasks does not grow with the data.
    """
    d = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    names = [n for n, _ in templates]
    words = item_words([t for _, t in templates])
    keys, owner, place = grams(words, width)
    keep = winnow(keys, owner, window)
    index = A.Index(words, width, keys[keep], owner[keep], place[keep])
    size = np.array([len(w) for w in words], np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(1)):
                w, h = A.plain_words(s)
                at = T.window_rows(w, width)
                k = T.window_hash(h, width)[at]
                picked = winnow(k, w.row[at], window)
                hit, seed = index.hits(k[picked])
                row, owner_, start, end, lo, hi = A.candidates(index, w, at[picked[hit]], seed, 0.25)
                got = A.align_all(index, h, owner_, start, end, lo, hi, band)
                ok = np.flatnonzero(got.matches >= min_coverage * size[owner_])
                chars = A.char_offsets(s.data)
                base = chars[s.offsets[row[ok]]]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(row[ok] + s.first)),
                        pa.array([names[k] for k in owner_[ok]], pa.string()),
                        pa.array(got.matches[ok] / size[owner_[ok]]),
                        pa.array(got.matches[ok].astype(np.int32)),
                        pa.array(got.score[ok].astype(np.int32)),
                        pa.array(chars[w.start[got.b_start[ok]]] - base),
                        pa.array(chars[w.end[got.b_end[ok] - 1]] - base),
                    ],
                    ["_id", "license", "coverage", "matched", "score", "start_char", "end_char"],
                )

    return d.mapInArrow(search, SCHEMA).withColumnRenamed("_id", id_col)
