import random
import re

import pytest

from lienwise.llm import licenses
from lienwise.llm.license_texts import TEMPLATES

from .conftest import prose


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, license string")


def found(spark, texts, **options):
    out = [[] for _ in texts]
    for r in licenses.license_notices(frame(spark, texts), **options).orderBy("doc_id", "place").collect():
        out[r["doc_id"]].append(r)
    return out


def names(spark, texts, **options):
    return [[r["license"] for r in rows] for rows in found(spark, texts, **options)]


def test_notices(spark, odd_docs, no_docs):
    texts = [
        prose(1, 30) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(2, 30),
        "released under  the mit license.",
        "All rights reserved\nLicensed under CC BY-NC 4.0.",
        "A license to drive is not a notice of permission in any sense of this word.",
        prose(3, 200) + ". Released under the MIT License. " + prose(4, 200),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and associated documentation files (the \"Software\"), to deal in the\nSoftware without restriction",
        "This work is licensed under the GNU General Public License, version 2.",
        None,
        "",
        "Copyright (c) 2024 Acme Inc. All rights reserved.",
        "Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0.",
        "The parser was rewritten. Released under the MIT License. See the docs.",
        "# All\n# rights\n# reserved.",
        "All rights are reserved",
    ]
    want = [["Apache-2.0"], ["MIT"], ["Proprietary", "CC-BY-NC-4.0"], [], ["MIT"], ["MIT"], ["GPL-2.0"], [], [], ["Proprietary"], ["Apache-2.0"], ["MIT"], ["Proprietary"], ["Proprietary"]]
    assert names(spark, texts) == want
    (exact,) = found(spark, texts)[6]
    assert (exact["words_lacking"], exact["words_added"], exact["agreement"], exact["differences"], exact["place"]) == (0, 0, 1.0, "", 0)
    (added,) = found(spark, texts)[13]
    assert (added["words_lacking"], added["words_added"], added["differences"]) == (0, 1, "- +are")
    assert licenses.license_notices(odd_docs).collect() == [] and licenses.license_notices(no_docs).collect() == []
    with pytest.raises(ValueError):
        licenses.license_notices(no_docs, agree=0.5)


def test_one_line_notices_need_the_name(spark):
    texts = {
        "// SPDX-License-Identifier: BSD-3-Clause": ["BSD-3-Clause"],
        "# SPDX-License-Identifier: GPL-2.0-or-later\n": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: SomethingElse-9": [],
        "Licensed under MIT.": ["MIT"],
        "This software is licensed under the terms of the MIT license.": ["MIT"],
        "Mozilla Public License Version 2.0": ["MPL-2.0"],
        "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"],
        "Released under the ABC License.": [],
        "Licensed under the Elder License, Version 2.0.": [],
        "All rights": [],
        "Sentences of all rights of readers and writers.": [],
    }
    assert names(spark, [prose(3, 20) + ".\n" + t + "\n" + prose(4, 20) for t in texts]) == list(texts.values())


def test_short_wordings_between_any_words_make_blocks_smaller():
    s = licenses.Scanner()
    for i, wording in enumerate(s.words):
        for n in range(6):
            before, after = (words_of(prose(10 * i + n, k)) for k in (n, 2 * n))
            saved = dict((t, x) for x, t in s.ranked([*before, *wording, *after])[1])
            assert saved[i] >= max(saved.values()) - licenses.CLOSE, (i, n)
    for text in ("oneaea is esth eawhha enesnd this that onreathaat the anndea. The. Released under the MIT License.", "Released under the MIT License. Er thntth. Ersteain, erinor asanhetioning the. Is onnd thatat ntat the of"):
        assert [s.names[n[2]] for n in s.notices(words_of(text))] == ["MIT"]


def test_size_reductions_choose(spark, monkeypatch):
    """A wording that saves most wins over a loose one with more words in common, which wins where all reductions are equal."""
    text = "this extraordinarily small file may be redistributed by anyone who acknowledges its two first makers and us as to it no".split()
    loose = ["unchanged" if n in (1, 7, 11, 19) else w for n, w in enumerate(text)]
    templates = (("Loose", " ".join(loose)), ("Exact", " ".join(text[:15])))
    scanner, block = licenses.Scanner(templates), words_of(" ".join(text))
    base, order = scanner.ranked(block)
    assert [t for _, t in order] == [1, 0] and base > order[0][0] > order[1][0] + licenses.CLOSE
    assert [scanner.names[n[2]] for n in scanner.notices(block)] == ["Exact"]
    assert names(spark, [prose(1, 30) + " " + " ".join(text) + " " + prose(2, 30)], templates=templates) == [["Exact"]]
    monkeypatch.setattr(licenses.Scanner, "ranked", lambda self, words: (1, [(1, i) for i in range(len(self.words))]))
    assert [scanner.names[n[2]] for n in scanner.notices(block)] == ["Loose"]


def test_every_template_in_any_layout(spark):
    """Found whole, wrapped, between other words and with words edited, at its place."""
    rng, texts, want = random.Random(1), [], []
    for n, (name, text) in enumerate(TEMPLATES):
        before = prose(n, 40) + " "
        edited = text.split()
        if len(edited) >= 20:
            for at in rng.sample(range(1, len(edited)), len(edited) // 12):
                edited[at] = "changed"
        for body in (text, "\n * ".join(text.split()), text.upper(), " ".join(edited)):
            texts.append(before + body + " " + prose(n + 50, 300))
            want.append((name, len(before.encode())))
    for got, (name, place) in zip(found(spark, texts), want, strict=True):
        assert [r["license"] for r in got] == [name] and got[0]["place"] == place


def brute(words, agree):
    """The notices of a text by trying every window with every template."""
    scanner = licenses.Scanner()
    templates = [(name, words_of(text)) for name, text in TEMPLATES]
    assert scanner.words == [words for _, words in templates]
    keys = [[words[k] for k in key] for (_, words), key in zip(templates, scanner.key, strict=True)]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = max(old[j] + 1 if x == y else 0, old[j + 1], row[j])
        return row[-1]

    best = None
    for t, (name, wording) in enumerate(templates):
        for a in range(len(words)):
            for z in range(a + 1, min(len(words), a + 2 * len(wording)) + 1):
                if not 2 * min(z - a, len(wording)) >= agree * (z - a + len(wording)):
                    continue
                if any(words[a:z].count(k) < keys[t].count(k) for k in keys[t]):
                    continue
                if words[a] not in wording or words[z - 1] not in wording:
                    continue
                same = common(wording, words[a:z])
                score = 2 * same / (len(wording) + z - a)
                if score >= agree and (best is None or (same, score) > best[:2]):
                    best = (same, score, name, a)
    return best


def test_against_brute_force(spark):
    rng, texts = random.Random(3), []
    short = [x for x in TEMPLATES if len(x[1].split()) <= 13]
    for n in range(60):
        words = short[n % len(short)][1].split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = rng.choice(([], ["the"], ["stone"], ["License"]))
        texts.append(prose(n, 6) + " " + " ".join(words) + " " + prose(n + 99, 6))
    for text, got in zip(texts, found(spark, texts), strict=True):
        want = brute(words_of(text), 0.8)
        assert (want is None) == (got == []), text
        if want:
            top = max(got, key=lambda r: r["agreement"])
            assert top["license"] == want[2] and top["agreement"] == pytest.approx(want[1]), text


def test_dictionaries_make_their_own_wording_smaller():
    s = licenses.Scanner()
    for i, words in enumerate(s.words):
        _, best = s.ranked(words)
        assert i in [t for _, t in best] and s.notices(words)[0][2:5:2] == (i, 1.0)
