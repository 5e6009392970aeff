"""License scans: fuzzy search for short notices.

Texts become lower-case words joined by single spaces. A notice with at most k edits, cut into k + 1 pieces, must hold
one piece unchanged, so one pass of an Aho-Corasick automaton over all pieces finds every candidate place; there the
regex library's bounded-error matching decides, counts edits and gives the span. In each notice the words that name its license, and those that tell it from a
notice of another license so near that edits could turn one into the other, bear no edit; and the other notice's may not stand in the span. All other words
may be misspelt, missing or added. Each place is matched on its own, so notices that follow each other are all found.

Null and empty texts have no words and no finds. Every row gives one row, so repeated rows repeat and an empty table gives
none; columns other than id and text are ignored, whatever their names. A find of a notice that is part of a longer one gives way to a find of
that one; of other overlapping finds the one with the smallest share of edits stands, then the longer one, then the earlier one. Time grows with a text's length, however often it repeats a notice.
"""

from __future__ import annotations

import difflib
import functools
import re
from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Phrases whose exact places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening words of common public notices, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version": "gpl",
    "licensed under the gnu lesser general public license version": "lgpl",
    "licensed under the gnu affero general public license version": "agpl",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "distributed under the terms of the bsd 2 clause license": "bsd",
    "distributed under the terms of the bsd 3 clause license": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under the mozilla public license version 2 0": "mpl",
    "licensed under the eclipse public license version": "epl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution": "cc",
    "licensed under a creative commons attribution sharealike": "cc-by-sa",
    "licensed under a creative commons attribution noncommercial": "cc-by-nc",
    "licensed under a creative commons attribution noderivatives": "cc-by-nd",
}

# Short names of licenses and their versions, as whole words without any edit; the identifiers behind SPDX tags.
_GNU = ("gpl", "lgpl", "agpl")
SPDX = {"mit": "mit", "apache 2 0": "apache", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mpl 2 0": "mpl", "epl 2 0": "epl", "isc": "isc", "unlicense": "unlicense", "cc0 1 0": "cc0"}
NAMES = (
    {f"cc {kind} {version}": f"cc-{kind.replace(' ', '-')}" for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for version in ("1 0", "2 0", "2 5", "3 0", "4 0", "3", "4")}
    | {"cc0 1 0": "cc0", "mpl 2 0": "mpl"}
    | {f"{name} {version}": name for name in _GNU for version in ("v2", "v3", "version 2", "version 3")}
    | {f"gnu {name}": name for name in _GNU}
    | {f"spdx license identifier {tag}": label for tag, label in SPDX.items()}
)

# Words that name a license wherever a notice has them, and the parts of cc names.
NAMING, CC_PARTS = frozenset("mit bsd mpl cc cc0 lesser affero".split()), frozenset("by sa nc nd".split())

ALL = tuple((NOTICES | NAMES).items())

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: ASCII letters to lower case, other ASCII but digits to blanks, bytes of other characters as they are.
_TABLE = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def edits_allowed(notice: str) -> int:
    """One edit for each 12 characters, 4 at most."""
    return min(4, len(notice) // 12)


def _differences(a: list[str], b: list[str]) -> tuple[int, set[str], set[str]]:
    """How many characters turn the words a into words within b, about; and which words only one of them has there."""
    cost, mine, others = 0, set(), set()
    steps = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    for kind, i, j, k, m in steps:
        outside = i == j and (i == 0 or i == len(a))  # what b has before and after
        if kind != "equal" and not outside:
            cost += max(len(" ".join(a[i:j])), len(" ".join(b[k:m])))
            mine, others = mine | set(a[i:j]), others | set(b[k:m])
    return cost, mine, others


@functools.cache
def marks(notices: tuple[tuple[str, str], ...]) -> list[tuple[list[str], frozenset[str]]]:
    """Of each notice: its words that bear no edit, in order, and all words that count when a span is held against these."""
    out = []
    for notice, label in notices:
        words = notice.split()
        if notice in NAMES:
            out.append((words, frozenset(words) | CC_PARTS))
            continue
        own, others = NAMING & set(words), set()
        if "cc" in words:
            own, others = own | CC_PARTS & set(words), others | CC_PARTS
        for other, its in notices:
            if its != label and other not in NAMES:
                cost, mine, theirs = _differences(words, other.split())
                if cost <= max(edits_allowed(notice), edits_allowed(other)):
                    own, others = own | mine, others | theirs
        out.append(([w for w in words if w in own], frozenset(own | others - set(words))))
    return out


@functools.cache
def _search(notices: tuple[tuple[str, str], ...]):
    seeds, patterns = ahocorasick.Automaton(), []
    places: dict[str, list[tuple[int, int]]] = {}
    for at, (notice, _) in enumerate(notices):
        k = edits_allowed(notice)
        patterns.append(regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}"))
        cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            places.setdefault(notice[a:b], []).append((at, a))
    for piece, where in places.items():
        seeds.add_word(piece, (len(piece), where))
    seeds.make_automaton()
    return seeds, patterns, marks(notices)


@functools.cache
def _longer(notices: tuple[tuple[str, str], ...]) -> list[list[int]]:
    """Of each notice the others that hold it."""
    return [[j for j, (other, _) in enumerate(notices) if notice != other and notice in other] for notice, _ in notices]


def fuzzy_places(joined: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int, int]]:
    """(notice number, start, end, edits) in the joined words; one for each place, the best of overlapping ones."""
    seeds, patterns, exact = _search(notices)
    starts: dict[int, list[int]] = {}
    for end, (length, where) in seeds.iter(joined):
        for at, offset in where:
            starts.setdefault(at, []).append(end + 1 - length - offset)
    found, known = set(), {}
    for at, hits in starts.items():
        notice, k, words = notices[at][0], edits_allowed(notices[at][0]), notices[at][0].split()
        hits, done = sorted(set(hits)), 0
        while done < len(hits):
            # Starts within the edits of each other are one place.
            first, done = hits[done], bisect_right(hits, hits[done] + k)
            a, b = max(0, first - k), min(len(joined), hits[done - 1] + len(notice) + k)
            window = joined[a:b]
            if (at, window) not in known:
                # An edit spoils one word at most, so all others stand in the window.
                hope = sum(w in window for w in words) >= len(words) - k and all(w in window for w in exact[at][0])
                m = patterns[at].search(window) if hope else None
                known[at, window] = m and (m.start(), m.end(), sum(m.fuzzy_counts))
            if got := known[at, window]:
                s, e = a + got[0], a + got[1]
                left, right = joined.rfind(" ", 0, s + (joined[s] == " ")) + 1, joined.find(" ", e - (joined[e - 1] == " "))
                unedited, counting = exact[at]
                if [w for w in joined[left : right if right >= 0 else len(joined)].split() if w in counting] == unedited:
                    found.add((at, s, e, got[2]))
    # A notice that begins or ends within a longer one gives way to it.
    by_notice: dict[int, list[tuple[int, int]]] = {}
    for at, s, e, _ in found:
        by_notice.setdefault(at, []).append((s, e))
    for spans in by_notice.values():
        spans.sort()

    def within(at: int, s: int, e: int) -> bool:
        for longer in _longer(notices)[at]:
            spans = by_notice.get(longer, ())
            i = bisect_right(spans, (s, len(joined)))
            if i and spans[i - 1][1] >= e:
                return True
        return False

    found = {x for x in found if not within(*x[:3])}
    # Of notices that overlap, the one with the smallest share of edits stands; then the longer one.
    kept: list[tuple[int, int, int, int]] = []  # by start; none overlap
    for at, s, e, edits in sorted(found, key=lambda x: (x[3] / len(notices[x[0]][0]), x[1] - x[2], x[1], x[0])):
        i = bisect_left(kept, (s,))
        if (i == 0 or kept[i - 1][1] <= s) and (i == len(kept) or e <= kept[i][0]):
            insort(kept, (s, e, at, edits))
    return [(at, s, e, edits) for s, e, at, edits in kept]


def scan_text(text: str | None, notices: tuple[tuple[str, str], ...] = ALL) -> dict:
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []
    joined = b" ".join(words)
    padded = b" " + joined + b" "
    base, labels = [], set()
    places = None
    for phrase, label in PHRASES.items():
        want, at = f" {phrase} ".encode(), -1
        while (at := padded.find(want, at + 1)) >= 0:
            places = places or list(accumulate((len(w) + 1 for w in words), initial=0))
            base.append(bisect_left(places, at))
            labels.add(label)
    plain = joined.decode("utf-8", "replace")
    fuzzy = fuzzy_places(plain, notices)
    spans = []
    if fuzzy:
        starts = [m.span() for m in _WORD.finditer(text)]
        begins = list(accumulate((len(w) + 1 for w in plain.split(" ")), initial=0))
        for at, a, b, edits in fuzzy:
            first, last = bisect_right(begins, a + (plain[a] == " ")) - 1, bisect_right(begins, b - 1 - (plain[b - 1] == " ")) - 1
            spans.append((notices[at][1], starts[first][0], starts[last][1], edits, 1 - edits / len(notices[at][0])))
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(base, default=None),
        "last_word": max(base, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {x[0] for x in spans})),
        "score": 1.0 if base else max((x[4] for x in spans), default=0.0),
        "spans": ",".join(f"{x[0]}:{x[1]}:{x[2]}:{x[3]}" for x in spans),
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def license_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document. spans: label:start:end:edits in code points of the text, by start."""

    def scan(batches):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
        for batch in batches:
            rows = [scan_text(t) for t in batch.column("text").to_pylist()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True))], ["doc_id", *names])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)
