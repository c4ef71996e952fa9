import random
import re
import time

import pytest

from cadastra.llm.license_scan import BASE, DENIED, Found, detect, detect_all, rules, scan, scan_licenses, unsuppressed


def base_by_words(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places = [(i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), sorted(places)


TEXTS = [
    "", None, "Released under the MIT License.", "under the mit licenses; under-the MIT...license", "CC BY-NC 4.0 cc by nc cc  by\nnc", "Apache License, Version 2.0", "ünder the mit license",
    "Éunder the mit license under the mit license", "under the\x00mit~license", "x" * 100_000 + " cc by nc",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_places(text):
    got = scan((text or "").encode())
    assert (got["n_words"], got["places"]) == base_by_words(text)
    assert set(got["base"]) <= set(got["labels"]) and 0 <= got["score"] <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("this work is licensed under the gnu general public license, version 3.", ["gpl-3"]),
        ("licensed under the gnu lesser general public license version 2.1 or later", ["lgpl-2.1-or-later"]),
        ("distributed under the terms of the mozilla public license 2.0", ["mpl-2"]),
        ("licensed under cc by-nc-sa 4.0", ["cc-by-nc-sa"]),
        ("creative commons attribution-noncommercial 3.0", ["cc-by-nc"]),
        ("copyright (c) 2019 someone. all rights reserved.", ["copyright", "all-rights-reserved"]),
        ("redistribution and use in source and binary forms", ["bsd-2"]),
        ("license: apache license version 2.0", ["apache-2"]),
        ("spdx-license-identifier: mit", ["mit"]),
        ("spdx-license-identifier: (mit or apache-2.0)", ["mit", "apache-2"]),
        ("licensed under the gpl-3.0", ["gpl-3"]),
        ("license: gpl-2.0-or-later", ["gpl-2-or-later"]),
        ("released under bsd-3-clause", ["bsd-3"]),
        ("gnu general public license v3", ["gpl-3"]),
        ("licensed under lgpl-2.1", ["lgpl-2.1"]),
        ("mpl-2.0 license", ["mpl-2"]),
        ("this is not under the mit license", []),
        ("no longer licensed under apache 2.0", []),
        ("not licensed under the gpl but under the mit license", ["mit"]),
        (" * permission is hereby granted, free of\n * charge, to any person\n * obtaining a copy", ["mit"]),
        ("alle rechte vorbehalten. tous droits réservés", ["all-rights-reserved", "all-rights-reserved"]),
        ("we walked under the trees with permission", []),
    ],
)
def test_detections(text, labels):
    assert [f.label for f in detect(text)] == labels


def test_rules_are_ordered_and_many():
    ps = [r.priority for r in rules()]
    assert len({r.find.pattern for r in rules()}) > 200 and ps == sorted(ps, reverse=True)


PIECES = [
    "licensed under the", "mit license", "not licensed under", "gnu", "lesser general public license", "version 2.1", "or later", "apache license, version 2.0", "spdx-license-identifier:", "mit", "or",
    "bsd-3-clause", "cc by-nc-sa 4.0", "all rights reserved", "copyright (c) 2001-2003", "public domain", "xmit license", "mozilla public license", "2.0", "v3", "\n", "\n # ", "  ", "é", ".", "isc license",
]


def by_definition(text):
    """All rules without keywords; a detection goes if a stronger one lies around or inside it."""
    plain = re.sub(r"\s+(?:(?:\*|#+|//+|;+|%+)\s+)?", " ", text)
    found = set()
    for r in rules():
        at = 0
        while m := r.find.search(plain, at):
            place = "at" if "at" in r.find.groupindex else 0
            a, b = m.span(place)
            if re.match(r"\w", plain[a]) and a and re.match(r"\w", plain[a - 1]):
                at = m.start() + 1
                continue
            found.add(Found(a, b, r.label, r.priority))
            at = m.end()
    kept = []
    for f in sorted(found, key=lambda f: (-f.priority, -(f.end - f.start), f.start, f.label)):
        if not any((k.start <= f.start and f.end <= k.end) or (f.start <= k.start and k.end <= f.end) for k in kept):
            kept.append(f)
    return sorted((f.label, f.priority, plain[f.start : f.end]) for f in kept)


def test_detections_equal_all_rules_and_all_pairs():
    rnd = random.Random(4)
    for _ in range(300):
        text = " ".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 25)))
        got = detect_all(text)
        assert got == detect_all(text, prefilter=False)
        assert sorted((f.label, f.priority, re.sub(r"\s+(?:(?:\*|#+|//+|;+|%+)\s+)?", " ", text[f.start : f.end])) for f in got) == by_definition(text)


def test_suppression_equals_all_pairs():
    rnd = random.Random(5)
    for _ in range(500):
        found = [Found(a, a + rnd.randrange(1, 12), rnd.choice("abc"), rnd.randrange(3)) for a in (rnd.randrange(20) for _ in range(rnd.randrange(15)))]
        kept = []
        for f in sorted(set(found), key=lambda f: (-f.priority, -(f.end - f.start), f.start, f.label)):
            if not any((k.start <= f.start and f.end <= k.end) or (f.start <= k.start and k.end <= f.end) for k in kept):
                kept.append(f)
        assert unsuppressed(found) == sorted(kept)


def test_long_texts_take_linear_time():
    line = "licensed under the MIT License. SPDX-License-Identifier: GPL-2.0-or-later; All rights reserved. cc by nc. This is not under the MIT license\n"
    began = time.time()
    got = scan(line.encode() * (1_000_000 // len(line)))
    assert time.time() - began < 5 and len(got["found"]) > 20_000


def test_denied_phrases_keep_their_label_without_score():
    got = scan("É: This is not under the MIT license".encode())
    assert (got["labels"], got["score"], got["found"]) == (["mit"], 0.0, [])
    assert scan(b"not under the MIT license; under the mit license")["score"] == 0.95
    assert [f.label for f in detect_all("not under the mit license")] == [DENIED]


def test_contained_detections_are_suppressed():
    found = detect("released under the terms of the apache license version 2.0")
    assert len(found) == 1 and found[0].priority == 95


def test_rows(docs):
    got = scan_licenses(docs([(1, TEXTS[2]), (2, None), (1, TEXTS[2])])).collect()
    assert sorted((r.doc_id, r.n_base, r.first_word, r.base_labels, r.labels) for r in got if r.doc_id == 1) == [(1, 1, 1, "mit", "mit")] * 2
    assert next((r.n_words, r.first_word, r.labels, r.score) for r in got if r.doc_id == 2) == (0, None, "", 0.0)
    assert scan_licenses(docs([])).count() == 0


WRAPPED = [
    "all rights reserved", "licensed under the gnu free documentation license", "released into the public domain", "licensed under the european union public licence, version 1.2",
    "permission is hereby granted, free of charge, to any person obtaining a copy", "licensed under the business source license 1.1", "licensed under the gnu general public license, version 3",
    "neither the name of the owner nor the names of its contributors", "may not be copied", "licensed under creative commons attribution noncommercial 3.0", "under the three clause bsd license",
    "available under the open data commons open database license v 1.0", "subject to the terms of the sil open font license 1.1", "covered by the terms of the apache license version 2.0",
]


@pytest.mark.parametrize("text", WRAPPED)
@pytest.mark.parametrize("gap", ["\n", "  ", "\n    ", "\t"])
def test_wrapped_texts_are_detected_alike(text, gap):
    wrapped = text.replace(" ", gap)
    found = detect(wrapped)
    assert [f.label for f in found] == [f.label for f in detect(text)] != []
    assert found == detect(wrapped, prefilter=False) and found[-1].end == len(wrapped)
