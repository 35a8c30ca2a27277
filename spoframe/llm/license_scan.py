"""License notices in documents, by MinHash over overlapping text windows.

Templates are grouped by length: a class of width ``w`` holds the templates of
more than ``w/2`` and up to ``w`` words, and texts are cut into windows of
``2w`` words every ``w`` words, so a notice of the class lies wholly in some
window.  A window that contains a share ``containment`` of such a template's
shingles has a Jaccard similarity of at least :func:`least_similarity` to it.
There is one band a hash (one row each), and :func:`bands_for` takes as many
as make a collision at that similarity as likely as ``recall``.  Every window
that collides in any band is then held against the template's exact shingle
set.  Windows are minima of minima, so a class costs one pass over the one
below it.

Work is local to a document: no shuffle, and no document meets another.  The
templates are a fixed, small list that every task carries.

Words are lower-cased runs of letters and digits.  Defined results: NULL and
empty texts match nothing; a template is reported once a document, where its
containment is highest (the earliest such window); repeated rows are scanned
as rows of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.llm.common import quoted
from spoframe.llm.hashing import mixed, word_hashes
from spoframe.llm.tokens import slices

#: License notices, in their usual words.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "mit-short": "Released under the MIT License.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-short": "To the extent possible under law, the author has waived all copyright and related rights.",
    "public-domain": "This work is in the public domain.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
}

SCHEMA = "doc_id long, license string, containment double, start_word long, end_word long, n_windows long"
_WORD = re.compile(r"[^\W_]+")
LEAST_WIDTH = 4


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def width_of(n_words: int) -> int:
    """The class of a template: the power of two from 4 up that holds it."""
    return max(LEAST_WIDTH, 1 << (n_words - 1).bit_length())


def least_similarity(width: int, shingle: int, containment: float, n_words: int) -> float:
    """Jaccard similarity of a template to a window with that share of its shingles, at least."""
    own = max(1, n_words - shingle + 1)
    common = math.ceil(containment * own)
    return common / (own - common + 2 * width - shingle + 1)


def bands_for(similarity: float, recall: float) -> int:
    """Bands of one row that make a collision as likely as ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity))


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    out = hashes[: len(hashes) - size + 1].copy()
    for j in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
    return mixed(out)


class _Scanner:
    """Templates with their signatures, for one worker."""

    def __init__(self, templates: tuple[tuple[str, str], ...], shingle: int, containment: float, recall: float):
        self.shingle, self.containment = shingle, containment
        self.templates = []  # name, words, width, shingle set
        similarity = 1.0
        for name, text in templates:
            words = words_of(text)
            if len(words) < shingle:
                raise ValueError(f"template {name!r} has fewer than {shingle} words")
            width = width_of(len(words))
            similarity = min(similarity, least_similarity(width, shingle, containment, len(words)))
            grams = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}
            self.templates.append((name, len(words), width, grams, _shingles(word_hashes(words), shingle)))
        self.widths = sorted({t[2] for t in self.templates})
        self.bands = bands_for(similarity, recall)
        seeds = mixed(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self.factors = seeds | np.uint64(1)
        # per width: template numbers and their signatures (template x band)
        self.signed = {
            w: (
                np.array([i for i, t in enumerate(self.templates) if t[2] == w]),
                np.array([[self._hashed(t[4], f).min() for f in self.factors] for t in self.templates if t[2] == w]),
            )
            for w in self.widths
        }

    @staticmethod
    def _hashed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
        h = x * factor
        return h ^ (h >> np.uint64(29))

    def candidates(self, grams: np.ndarray) -> np.ndarray:
        """Rows (window's first shingle, template number) that collide in some band."""
        found = [np.zeros((0, 2), np.int64)]
        top = np.full(1, 0xFFFFFFFFFFFFFFFF, np.uint64)
        for b, factor in enumerate(self.factors):
            low, size = self._hashed(grams, factor), 1
            while size < self.widths[-1]:
                # minima over blocks of 2 * size shingles, from the pairs below
                if len(low) % 2:
                    low = np.concatenate([low, top])
                low, size = np.minimum(low[::2], low[1::2]), size * 2
                if size in self.signed:
                    numbers, signatures = self.signed[size]
                    window = low.copy()
                    np.minimum(low[:-1], low[1:], out=window[:-1])
                    for t, signature in zip(numbers, signatures[:, b], strict=True):
                        at = np.flatnonzero(window == signature)
                        if len(at):
                            found.append(np.stack([at * size, np.full(len(at), t)], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def scan(self, texts: list[str]) -> Iterator[tuple[int, str, float, int, int, int]]:
        """(text number, template, containment, first word, end, windows) of each match.

        Shingles of all texts stand in one array, each text padded to whole
        blocks; a window that reaches into the next text is judged by the
        words of its own.
        """
        block, words, parts, starts, at = self.widths[-1], [], [], [], 0
        for text in texts:
            own = words_of(text)
            grams = _shingles(word_hashes(own), self.shingle) if len(own) >= self.shingle else np.zeros(0, np.uint64)
            pad = np.full(-len(grams) % block, 0xFFFFFFFFFFFFFFFF, np.uint64)
            words.append(own)
            starts.append(at)
            parts += [grams, pad]
            at += len(grams) + len(pad)
        if not at:
            return
        found = self.candidates(np.concatenate(parts))
        owner = np.searchsorted(np.array(starts), found[:, 0], side="right") - 1
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for (place, t), k in zip(found.tolist(), owner.tolist(), strict=True):
            _, _, width, wanted, _ = self.templates[t]
            first = place - starts[k]
            part = words[k][first : first + 2 * width + self.shingle - 1]
            got = [i for i in range(len(part) - self.shingle + 1) if tuple(part[i : i + self.shingle]) in wanted]
            share = len({tuple(part[i : i + self.shingle]) for i in got}) / len(wanted)
            if share >= self.containment:
                old = best.get((k, t), (0.0, 0, 0, 0))
                new = (share, first + got[0], first + got[-1] + self.shingle, old[3] + 1)
                best[k, t] = new if share > old[0] else (*old[:3], old[3] + 1)
        for k, t in sorted(best):
            yield (k, self.templates[t][0], *best[k, t])


@lru_cache(maxsize=4)
def _scanner(templates, shingle, containment, recall) -> _Scanner:
    return _Scanner(templates, shingle, containment, recall)


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 2,
    containment: float = 0.85,
    recall: float = 0.999,
) -> DataFrame:
    """Rows of :data:`SCHEMA`: the templates that each document contains."""
    wanted = tuple((templates or TEMPLATES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(wanted, shingle, containment, recall)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for rows in batches:
            ids, texts = rows.column(0).to_pylist(), [x or "" for x in rows.column(1).to_pylist()]
            for a, b in slices(texts, 1_000_000):
                found = [(ids[a + k], *m) for k, *m in scanner.scan(texts[a:b])]
                columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    whole = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return whole.mapInArrow(run, SCHEMA)
