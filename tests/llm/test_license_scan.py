import random
import re

from lexiflume.llm.license_scan import ALL, NAMES, NOTICES, edits_allowed, license_scan, marks, scan_text


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = sorted(i for i, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "MIT License", "the MIT, license; mit-license mit license license", "é mit licenseé Apache\n\nLicense\x1f General_Public  license", "mitlicense mit licenses",
    "Released under teh MIT License.", "Licenced under the Apache Licence, Version 2.0", "Permission is hereby granted, free of charge, to any person obtaning a copy", "nothing here " * 50,
]


def test_base_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x"), (None, TEXTS[3], "x")], "doc_id long, text string, score string")
    got = sorted(str(tuple(x)[:6]) for x in license_scan(df).collect())
    assert got == sorted(str((i, *plain(t))) for i, t in [*enumerate(TEXTS), (2, TEXTS[2]), (None, TEXTS[3])])
    assert license_scan(df.limit(0)).count() == 0


def test_edited_notices_are_found_with_spans_and_edits():
    text = "Früher — Relesed under the MIT  Licence! rest"
    label, a, b, edits = scan_text(text)["spans"].split(":")
    assert (label, text[int(a) : int(b)], int(edits)) == ("mit", "Relesed under the MIT  Licence", 2)
    assert edits_allowed("released under the mit license") == 2
    assert scan_text("Relesed undr the MIT Licence")["spans"] == ""
    for notice, label in NOTICES.items():
        cut = len(notice) // 2
        changed = notice[:cut] + notice[cut + 1 :]
        assert label in scan_text(f"before it {changed} after")["labels"].split(",")
        assert scan_text(notice)["score"] == 1.0
    assert scan_text("released under the seal of a committee")["labels"] == ""


def test_words_that_tell_licenses_apart_bear_no_edit():
    labels = lambda t: scan_text(t)["labels"]
    assert labels("licensed under cc by nd 4 0") == "cc-by-nd"
    assert labels("released under the bit license") == ""
    assert labels("Licensed under CC BY 4.0") == "cc-by"
    assert labels("CC BY-NC-SA 4.0") == "cc-by-nc-sa"
    assert labels("licensed under the gnu lesser genral public licence version") == "lgpl"
    assert labels("licensed under the gnu general public licence version") == "gpl"


def test_words_that_separate_nothing_may_be_edited():
    labels = lambda t: scan_text(t)["labels"]
    assert "lgpl" in labels("under the terms of the GNU Lesser General Public License as published be the Free Software Foundation")
    assert labels("licensed under the Mozilla Public License, Version 2") == "mpl"
    assert labels("Permission to use, copy, modify, and/or by distribute this software for any purpose") == "isc"
    assert labels("under GPL v3") == labels("the GNU GPL") == labels("SPDX-License-Identifier: GPL-3.0-or-later") == "gpl"
    assert labels("CC-BY-SA-4") == "cc-by-sa" and labels("SPDX-License-Identifier: MIT") == "mit"
    for at, (notice, label) in enumerate(ALL):
        if notice in NAMES:
            continue
        words, (exact, _) = notice.split(), marks(ALL)[at]
        for i, w in enumerate(words):
            if w not in exact:
                for other in (w[1:], w + "q", "q" + w[1:]):
                    assert label in labels(" ".join(["before", *words[:i], *([other] if other else []), *words[i + 1 :], "after"])).split(","), (notice, w, other)


def least_edits(notice, text):
    """Fewest edits that turn the notice into some part of the text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        above, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != t)))
    return min(row)


def test_fuzzy_finds_against_a_plain_edit_distance_scan():
    """A notice within its edits is found wherever the words that bear none stand; beyond them it is not."""
    r, near, far = random.Random(11), 0, 0
    for _ in range(150):
        at = r.randrange(len(NOTICES))
        notice, label = ALL[at]
        chars = list(notice)
        for _ in range(r.randint(0, edits_allowed(notice) + 2)):
            i = r.randrange(len(chars))
            chars[i : i + r.randint(0, 1)] = r.choice(["", "q", "z"])
        changed = " ".join("".join(chars).split())
        text, exact = f"some words {changed} more words", marks(ALL)[at][0]
        edits = least_edits(notice, text)
        found = label in scan_text(text)["labels"].split(",")
        if edits <= edits_allowed(notice) and [w for w in changed.split() if w in exact] == exact:
            near += 1
            assert found, text
        elif all(least_edits(n, text) > edits_allowed(n) for n, x in ALL if x == label):
            far += 1
            assert not found or label in scan_text(text)["base_labels"], text
    assert near > 50 and far > 10


def test_adjacent_notices_are_all_found():
    got = scan_text("licensd undr the apache license version 2 0 licensed under the apache license version 2 0")["spans"]
    assert got == "apache:0:43:2,apache:44:89:0"


def counted(text):
    """As plain, for one phrase after another: MIT and Apache only."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    at = [i for i in range(len(words) - 1) if words[i + 1] == "license" and words[i] in ("mit", "apache")]
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({words[i] for i in at}))


def test_long_texts_take_time_by_their_length():
    import time

    for text, n in (("Licensd under the Apache License, Version 2.0. " * 20_000, 20_000), ("mit license " * 80_000, 0), ("license under the gnu " * 45_000, 0)):
        began = time.time()
        got = scan_text(text)
        assert time.time() - began < 10
        assert got["spans"].count(":") == 3 * n
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == counted(text)
