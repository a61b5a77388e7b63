"""Licences that differ by a clause, negated notices, identifiers, and a plain search of all windows."""

import random
import re

import pytest

from panelflow.llm import licenses

WORDS = ["alpha", "beta", "the", "of", "software", "license", "under", "version", "2", "0", "permission", "granted"]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _found(spark, texts):
    got = licenses.find_licenses(_docs(spark, texts)).collect()
    return [sorted({r.license for r in got if r.doc_id == i}) for i in range(len(texts))]


def _plain(text):
    """Licences by every window that begins with two words of the template, each compared in full; then places from the best window down."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    matches = []
    for name, form, whole in [(n, t, False) for n, t in licenses.TEMPLATES] + [(n, t, True) for n, t in licenses.WHOLE + licenses.SPDX]:
        f = licenses.normalise(form)
        own = set(zip(f, f[1:]))
        numbers = re.findall(r"\b\d+(?: \d+)*\b", " ".join(f))
        for s in range(max(len(w) - 1, 0)):
            window = w[s : s + len(f)]
            pairs = set(zip(window, window[1:]))
            dice = 2 * len(pairs & own) / (len(pairs) + len(own))
            if tuple(w[s : s + 2]) not in own:
                continue
            order = list(dict.fromkeys(zip(f, f[1:])))
            a, b = s, s + len(f)
            around = " ".join(w[a - 1 if a and w[a].isdigit() else a : b + 1 if window[-1].isdigit() and len(window) == len(f) else b])
            from_ = max(0, s - 1 - order.index(tuple(w[s : s + 2])))
            turned = sum(x in licenses.NEGATIONS for x in w[from_ : s + len(f)]) > sum(x in licenses.NEGATIONS for x in f)
            if dice >= 0.8 and set(numbers) <= set(re.findall(r"\b\d+(?: \d+)*\b", around)) and (whole or not turned):
                matches.append((2 * len(pairs & own) - (len(pairs) + len(own)) / 2, dice, -s, s + len(f), name, whole))
    places, out = [], set()
    for m in sorted(matches, reverse=True):
        if not any(-m[2] < p[3] and -p[2] < m[3] for p in places):
            places.append(m)
    for m in matches:
        place = next(p for p in places if -m[2] < p[3] and -p[2] < m[3])
        if not place[5] or place[4] == m[4]:
            out.add(m[4])
    return sorted(out)


def test_every_template_is_found_as_itself(spark):
    cases = [*licenses.WHOLE, *licenses.SPDX]
    found = _found(spark, [f"Notes about it. Copyright (c) 2024 A. Person. {t} And that is all there is." for _, t in cases])
    assert found == [[name] for name, _ in cases]


def test_all_windows_by_plain_search(spark):
    r = random.Random(3)
    texts = ["", "word", "under " * 9]
    for _, t in licenses.TEMPLATES + licenses.WHOLE[:12] + licenses.SPDX:
        w = t.split()
        for _ in range(r.randint(0, max(1, len(w) // 20))):
            w[r.randrange(len(w))] = r.choice([*WORDS, "not"])
        texts.append(" ".join([*r.choices(WORDS, k=r.randint(0, 5)), *w, *r.choices(WORDS, k=r.randint(0, 5))]))
    assert _found(spark, texts) == [_plain(t) for t in texts]


@pytest.fixture(scope="module")
def named(spark):
    whole = dict(reversed(licenses.WHOLE))
    cases = {
        "This project is not licensed under the terms of the MIT license.": [],
        "It was never released under the MIT License.": [],
        "See section 2. This work is licensed under the GNU General Public License, version 3. 12 notes follow.": [],
        # the notices of both differ by a word, and all licences that reach the threshold are reported
        "See section 2: this work is licensed under the GNU General Public License, version 3. Notes follow.": ["AGPL-3.0", "GPL-3.0"],
        "We do not copy. Released under the MIT License.": ["MIT"],
        "Released under the MIT License. Not for resale.": ["MIT"],
        "SPDX-License-Identifier: MIT": ["MIT"],
        "# SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"],
        "// SPDX-License-Identifier: MIT-0\nint main": ["MIT-0"],
        "Text under CC BY-NC-SA 4.0, figures apart": ["CC-BY-NC-SA-4.0"],
        "the Creative Commons Attribution-NonCommercial 4.0 International License": ["CC-BY-NC-4.0"],
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": ["GPL-2.0"],
        whole["BSD-4-Clause"].replace("by the organization", "by the University of Somewhere and its contributors"): ["BSD-4-Clause"],
        whole["MIT-0"].upper(): ["MIT-0"],
        whole["0BSD"]: ["0BSD"],
        whole["Zlib"].replace("The origin", "1. The origin").replace("Altered", "2. Altered").replace("This notice", "3. This notice"): ["Zlib"],
    }
    return cases, dict(zip(cases, _found(spark, list(cases))))


def test_named_cases(named):
    cases, got = named
    assert got == cases


def test_nulls_repeats_and_empty_tables(spark):
    row = (1, "Released under the MIT License.")
    docs = spark.createDataFrame([row, row, (2, None), (None, "Released under the MIT License."), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.license) for r in licenses.find_licenses(docs).collect()) == [(-1, "MIT"), (1, "MIT")]
    assert licenses.find_licenses(docs.limit(0)).count() == 0 == licenses.scan(docs.limit(0)).count()
