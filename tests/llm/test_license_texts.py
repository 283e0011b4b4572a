"""Licence bodies and headers as files carry them."""

import numpy as np
import pytest

from loamgrid.llm import license_scan
from loamgrid.llm.license_texts import TEXTS


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_body_or_header_in_a_comment(name):
    index = license_scan.build_index(license_scan.TEMPLATES)
    body = "\n".join(f" * {line}" for line in TEXTS[name][0].splitlines())
    found = license_scan.scan(f"/* Copyright 2020 Some Person\n{body}\n */\nint main() {{}}", index)
    assert [x[:2] for x in found] == [(name, 1.0)]


def test_registered_texts_are_those_of_the_query():
    index = license_scan.build_index(license_scan.TEMPLATES)
    text = "x " + TEXTS["mit"][0].replace("to any person", "to every person") + " y " + TEXTS["gpl-2.0"][0].replace("program", "library")
    assert [x[0] for x in license_scan.scan(text, index)] == ["mit", "gpl-2.0"]


@pytest.mark.parametrize("name", sorted(license_scan.WHOLE))
def test_whole_text(name):
    index = license_scan.build_index(license_scan.TEMPLATES)
    text = license_scan.WHOLE[name][0]
    start = next(license_scan._TOKEN.finditer(text)).start()
    found = license_scan.scan("İİ before. " + text + " after it", index)
    assert (name, 1.0, 11 + start) in [x[:3] for x in found]


def test_spans_are_of_the_text_itself():
    index = license_scan.build_index(license_scan.TEMPLATES)
    text = "İİİ Released under the MIT License. End"
    ((_, _, a, z),) = license_scan.scan(text, index)
    assert text[a:z] == "Released under the MIT License"


def test_many_notices_in_one_text():
    import time

    index = license_scan.build_index(license_scan.TEMPLATES)
    began = time.time()
    assert len(license_scan.scan("Released under the MIT License. " * 32_000, index)) == 32_000
    assert time.time() - began < 60


def test_candidates_against_all_templates_and_diagonals():
    rng = np.random.default_rng(12)
    vocabulary = [f"v{i}" for i in range(30)]
    templates = {f"t{i}": [" ".join(rng.choice(vocabulary, n))] for i, n in enumerate([3, 5, 7, 8, 13, 21, 30])}
    index = license_scan.build_index(templates)
    for _ in range(60):
        words = list(rng.choice(vocabulary, rng.integers(0, 8)))
        for i in rng.integers(0, len(templates), 2):
            part = templates[f"t{i}"][0].split()
            for at in rng.choice(len(part), int(len(part) * 0.15), replace=False):
                part[at] = "other"
            words += [*part, *rng.choice(vocabulary, rng.integers(0, 4))]
        text = " ".join(words)
        ids = np.array([index.vocabulary.get(w, -1) for w in words], np.int64)
        best = {}
        for t, template in enumerate(index.templates):
            placings = [license_scan.align(template, ids, d)[0] / len(template) for d in range(-len(template), len(ids))]
            best[index.names[t]] = max(placings)
        covered = {n for n, c in best.items() if c >= license_scan.COVERAGE}
        got = license_scan.scan(text, index)
        assert {x[0] for x in got} <= covered and all(x[1] <= best[x[0]] for x in got)
        # what is covered but not reported overlaps a reported one
        assert bool(got) == bool(covered)
