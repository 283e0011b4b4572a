"""License scans: winnowed template index, then banded alignment."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS

#: One-sentence notices by licence.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "mpl-2.0": ["This file is subject to the Mozilla Public License, version 2.0."],
    "bsd-3-clause": ["Use of this source code is governed by a BSD-style license."],
    "cc-by-4.0": ["Licensed under CC BY 4.0."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
    "proprietary": ["All rights reserved."],
}
#: Whole texts of the long licences, as published.
WHOLE = {p.stem: [p.read_text("utf-8")] for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
#: Notices, bodies and standard headers, whole texts; a deployment passes its own, of any length.
TEMPLATES = {name: [*NOTICES.get(name, []), *TEXTS.get(name, []), *WHOLE.get(name, [])] for name in dict.fromkeys([*NOTICES, *TEXTS, *WHOLE])}
#: Words of a k-gram; k-grams in a window of a template of at least SHORT words (shorter ones keep all); words beside the diagonal.
GRAM, WINDOW, SHORT, BAND = 3, 2, 20, 6
#: Least share of a template's words that must be matched in order.
COVERAGE = 0.85
#: Kept k-grams a word of a long template that are intact at least: of COVERAGE - 2 * (1 - COVERAGE) one in two is kept.
SEEDS = 0.25
_TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass
class Index:
    """Inverted index: k-gram key -> (template, position) of its winnowed occurrences."""

    names: list[str]
    templates: list[np.ndarray]
    vocabulary: dict[str, int]
    keys: np.ndarray
    places: dict[int, list[tuple[int, int]]]


def _grams(ids: np.ndarray, base: int) -> np.ndarray:
    """Keys of all k-grams; -1 where a word is unknown."""
    m = len(ids) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    key, known = np.zeros(m, np.int64), np.ones(m, bool)
    for j in range(GRAM):
        part = ids[j : j + m]
        key, known = key * base + part, known & (part >= 0)
    return np.where(known, key, -1)


def build_index(templates: dict[str, list[str]]) -> Index:
    """Winnow each template: of every WINDOW k-grams the least mixed key is kept.

    A run of GRAM + WINDOW - 1 words in common, or of GRAM words in a template of
    fewer than SHORT, always finds it.
    """
    vocabulary: dict[str, int] = {}
    names, ids = [], []
    for name, texts in templates.items():
        for text in texts:
            names.append(name)
            ids.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens_of(text)], np.int64))
    if len(vocabulary) ** GRAM >= 1 << 62:
        raise ValueError("the templates have too many words for exact keys")
    places: dict[int, list[tuple[int, int]]] = {}
    for t, x in enumerate(ids):
        keys = _grams(x, len(vocabulary))
        mixed = (keys * np.int64(-7046029254386353131)) ^ (keys >> 7)
        width = min(WINDOW if len(x) >= SHORT else 1, max(1, len(keys)))
        kept = {i + int(np.argmin(mixed[i : i + width])) for i in range(max(0, len(keys) - width + 1))}
        for i in sorted(kept):
            places.setdefault(int(keys[i]), []).append((t, i))
    return Index(names, ids, vocabulary, np.array(sorted(places), np.int64), places)


def align(template: np.ndarray, ids: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(matched words, start, stop) of the best placing of a template near `diagonal`.

    The whole template is aligned with some run of words, within BAND words of
    the diagonal: a match scores 2, a substitution, insertion or omission -1.
    """
    low = diagonal - BAND
    width = 2 * BAND + 1
    best = [(0, 0, max(0, min(len(ids), low + b))) for b in range(width)]  # (score, matched, start) before word low + b
    for i, word in enumerate(template):
        row: list[tuple[int, int, int]] = []
        for b in range(width):
            j = low + i + b
            score, matched, start = best[b]
            if 0 <= j < len(ids):
                hit = ids[j] == word
                here = (score + 2, matched + 1, start if matched else j) if hit else (score - 1, matched, start)
            else:
                here = (score - 1, matched, start)
            if b + 1 < width:  # template word left out
                s, k, a = best[b + 1]
                here = max(here, (s - 1, k, a), key=lambda x: x[0])
            if b:  # word of the text left out
                s, k, a = row[b - 1]
                here = max(here, (s - 1, k, a), key=lambda x: x[0])
            row.append(here)
        best = row
    b = max(range(width), key=lambda x: (best[x][0], -abs(x - BAND)))  # of equals, the one on the diagonal
    stop = max(0, min(len(ids), low + len(template) + b))
    return best[b][1], best[b][2], stop


def _diagonals(hits: Counter[int], n: int) -> list[int]:
    """Diagonals that a template of `n` words is aligned on: all that were hit, or of a longer one the best in reach.

    With a share of 1 - COVERAGE of its words replaced, at least SEEDS * n of its
    kept k-grams lie within BAND of one diagonal.
    """
    d = np.array(sorted(hits), np.int64)
    if n < SHORT:
        return d.tolist()
    total = np.concatenate([[0], np.cumsum([hits[x] for x in d.tolist()])])
    near = total[np.searchsorted(d, d + BAND, "right")] - total[np.searchsorted(d, d - BAND, "left")]
    keep: list[int] = []
    for i in np.argsort(-near, kind="stable").tolist():
        if near[i] < SEEDS * n - 2:
            break
        at = bisect_left(keep, int(d[i]))
        if all(abs(x - int(d[i])) > BAND for x in keep[max(0, at - 1) : at + 1]):
            insort(keep, int(d[i]))
    return keep


def scan(text: str, index: Index) -> list[tuple[str, float, int, int]]:
    """(licence, coverage, start, stop) of the notices in a text, by place; spans are character offsets.

    Of notices that overlap the one with more matched words counts.
    """
    lowered = text.lower()
    same = len(lowered) == len(text)  # else some letter became two, and words are cut before they are folded
    words = _TOKEN.findall(lowered) if same else [w.lower() for w in _TOKEN.findall(text)]
    get = index.vocabulary.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    keys = _grams(ids, max(1, len(index.vocabulary)))
    at = np.flatnonzero(np.isin(keys, index.keys)) if len(keys) else []
    seen: dict[int, Counter[int]] = {}
    for i in at:
        for t, p in index.places[int(keys[i])]:
            seen.setdefault(t, Counter())[int(i) - p] += 1
    if not seen:
        return []
    found = []
    for t, d in ((t, d) for t in sorted(seen) for d in _diagonals(seen[t], len(index.templates[t]))):
        # No placing can match more words than are in reach, nor a template word that they lack.
        template = index.templates[t]
        reach = ids[max(0, d - BAND) : max(0, d + len(template) + BAND)]
        if len(reach) < COVERAGE * len(template) or np.isin(template, reach).sum() < COVERAGE * len(template):
            continue
        matched, start, stop = align(template, ids, d)
        coverage = matched / len(template)
        if coverage >= COVERAGE and stop > start:
            found.append((-matched, -coverage, start, stop, t))
    spans = [m.span() for m in _TOKEN.finditer(lowered if same else text)]
    taken: list[tuple[int, int]] = []  # in order, none overlaps another
    out = []
    for _, coverage, start, stop, t in sorted(found):
        i = bisect_left(taken, (start, stop))
        if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= stop):
            insort(taken, (start, stop))
            out.append((index.names[t], -coverage, spans[start][0], spans[stop - 1][1]))
    return sorted(out, key=lambda x: (x[2], x[0]))


def license_notices(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_notices, notices) of every row; a notice is (license, coverage, start, stop).

    The index of the templates is small and goes with the function.  Null and
    empty texts have no notices; equal rows are all kept; an empty table gives
    an empty result; further columns are ignored.  Offsets count characters of
    the text as it is.
    """
    index = build_index(templates or TEMPLATES)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    notice = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("license", "coverage", "start", "stop")
        for b in batches:
            found = [[dict(zip(fields, x, strict=True)) for x in scan(t.as_py() or "", index)] for t in b.column(1)]
            n = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(found, pa.list_(notice))], ["id", "n_notices", "notices"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_notices long, notices array<struct<license: string, coverage: double, start: long, stop: long>>"
    return rows.mapInArrow(scanned, schema)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Notices of every document: a list of licences, and coverage with spans."""
    found = license_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    licenses = F.array_sort(F.array_distinct(F.col("notices.license")))
    return found.select(F.col("id").alias("doc_id"), "n_notices", licenses.alias("licenses"), "notices")
