"""Diagonal voting against a plain scan of every position."""

from __future__ import annotations

import random
import re

import pytest

from lodestone.llm.license_scan import scan_licenses
from lodestone.llm.license_templates import BASE, NOTICES, must_hold


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w, places, labels = words(text), [], set()
    for t in BASE:
        p = t.text.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        labels |= {t.label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_match_a_plain_scan(spark):
    rng = random.Random(3)
    vocabulary = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "é", "CC BY-NC", "Under the MIT License", "Apache License, Version 2.0"]
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "cc"), (502, "cc"), (None, "cc by nc"), (503, "cc by nc " * 5000)]
    out = scan_licenses(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, WORDS string"), BASE + NOTICES).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out)
    assert str(got) == str(sorted((i or -1, *brute(t)) for i, t in rows))
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in out)


@pytest.mark.parametrize(("text", "labels"), [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("All rights reserved.", "all-rights-reserved"),
    ("Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without any restriction", "mit"),
    ("redistribution and use of this garden are permitted", ""),
])
def test_notices(spark, text, labels):
    assert scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), BASE + NOTICES).first().labels == labels


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string"), BASE).count() == 0


def test_notices_back_to_back(spark):
    """A repeated footer line, and a notice with a word put in that others follow, keep their labels and scores."""
    lucky = "Licensed under the lucky GNU General Public License, version 3. "
    rows = [(n, "All rights reserved. " * n) for n in (1, 3, 4, 5, 50, 5000)] + [(9001, "some words " + "all rights reserved " * 4 + "and more words"), (9002, "all rights " * 9), (9003, lucky * 6)]
    out = {r.doc_id: (r.labels, r.score) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), NOTICES).collect()}
    assert out.pop(9002) == ("", 0) and out.pop(9003)[1] == pytest.approx(5 / 7)
    assert len(out) == 7 and set(out.values()) == {("all-rights-reserved", 1.0)}


def brute_notices(text, k=3, drift=3, least=0.8):
    """Labels by trying every stretch of the text that is at most 2 * drift words longer than the notice."""
    w, labels = words(text), set()
    for t in NOTICES:
        p = t.text.split()
        place = {tuple(p[i : i + k]): i for i in range(len(p) - k + 1)}
        assert len(place) == len(p) - k + 1
        hits = [(i, place[g]) for i in range(len(w) - k + 1) if (g := tuple(w[i : i + k])) in place]
        must = set(must_hold(t, k))
        for first, _ in hits:
            if must <= {at for _, at in hits} and len({at for i, at in hits if first <= i and i + k <= first + len(p) + 2 * drift}) >= least * len(place):
                labels.add(t.label)
    return ",".join(sorted(labels))


def test_notices_against_a_plain_scan(spark):
    """Every notice whole, with a word put in, with a word left out, and half of it, among other words."""
    rows = []
    for t in NOTICES:
        p = t.text.split()
        for made in (p, [*p[:2], "lucky", *p[2:]], p[:1] + p[2:], p[: len(p) // 2], [*p[:5], *"these words stand in between and part it for good".split(), *p[5:]]):
            rows.append((len(rows), "Some words before it. " + " ".join(made).capitalize() + " and after"))
    out = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), NOTICES).collect()}
    assert {i: out[i] for i, _ in rows} == {i: brute_notices(t) for i, t in rows}
    assert all(t.label in out[5 * i].split(",") for i, t in enumerate(NOTICES))
