"""License notices in documents: winnowed fingerprints and banded alignment.

Templates (known notices) are cut into lower-case words, every ``GRAM`` words
are hashed, and winnowing keeps the smallest hash of each window of
``WINDOW`` neighbours (all of them for templates of at most ``SHORT`` words).
The kept fingerprints form an inverted index from hash to template and
position: every text that repeats ``GRAM + WINDOW - 1`` words of a template in
a row (``GRAM`` words of a short one) holds one of them.  Where a quarter of a
template's words is lost or replaced, so many always stay in a row, so every
text that reaches ``MIN_COVERAGE`` this way is a candidate.  Words put between
the template's do not count against coverage; a text where they leave no such
run is not a match.

A document's grams are looked up in that index.  A hit gives a template and a
diagonal (place in the text less place in the template), and the words around
it are aligned with the template within a band of diagonals (global in the
template, free at both ends of the text).  The alignment reports how much of
the template is matched and where; candidates of at least ``MIN_COVERAGE``
are results, the best one where they overlap.  Hits whose surroundings cannot
reach that (too few words of the template, or its name is not there) are not
aligned.

Coverage alone cannot tell licenses whose notices differ in one word.  The
words of a template that tell it from others (``FAMILY``, ``VARIANT`` and
numbers) and all between them are its name; the text's words in its place
must hold the same families, exactly the same variants and, if the name has a
version, exactly that one (final zeros aside: version 2 is 2.0).

The index depends on the templates alone (a parameter, not the corpus) and is
shipped with the function; documents are read whole, in one pass without a
shuffle.

Defined cases: null and empty texts match nothing; a template shorter than
``MIN_WORDS`` words is refused; repeated rows repeat their matches; a null
``doc_id`` is carried through; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm._text import LOWER, Words, runs, span_hashes, text_bytes, text_column, windows

GRAM = 2
WINDOW = 2
SHORT = 8
MIN_WORDS = 3
BAND = 6
MIN_COVERAGE = 0.75
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[48:58] = False
_BREAK[65:91] = False
_BREAK[97:123] = False

#: Notices by the name they are reported under.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    **{f"Apache-{v}": f"Licensed under the Apache License, Version {v}." for v in ("1.0", "1.1")},
    **{name: f"This work is licensed under the GNU {title}." for name, title in {
        "GPL-1.0": "General Public License, version 1", "GPL-2.0": "General Public License, version 2",
        "LGPL-2.0": "Library General Public License, version 2",
        "LGPL-2.1": "Lesser General Public License, version 2.1",
        "LGPL-3.0": "Lesser General Public License, version 3",
        "AGPL-3.0": "Affero General Public License, version 3",
        "GFDL-1.1": "Free Documentation License, version 1.1",
        "GFDL-1.2": "Free Documentation License, version 1.2",
        "GFDL-1.3": "Free Documentation License, version 1.3"}.items()},
    **{f"{kind}-notice": (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {word} "
        "General Public License as published by the Free Software Foundation")
       for kind, word in {"LGPL": "Lesser", "LGPL-2.0": "Library", "AGPL": "Affero"}.items()},
}
#: Other wordings, reported under the same names.
FORMS: list[tuple[str, str]] = []
for _version, _port in {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic",
                        "1.0": "Generic"}.items():
    _nd = "NoDerivatives" if _version == "4.0" else "NoDerivs"
    for _kind, _title in {"BY": "", "BY-NC": "-NonCommercial", "BY-SA": "-ShareAlike", "BY-ND": f"-{_nd}",
                          "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": f"-NonCommercial-{_nd}"}.items():
        for _text in (f"This work is licensed under a Creative Commons Attribution{_title} {_version} {_port} License.",
                      f"Licensed under CC {_kind} {_version}."):
            if TEMPLATES.setdefault(_name := f"CC-{_kind}-{_version}", _text) != _text:
                FORMS.append((_name, _text))

#: Words that name a family of licenses, by what they stand for.
FAMILY = {
    "mit": "mit", "apache": "apache", "bsd": "bsd", "mozilla": "mozilla", "mpl": "mozilla", "eclipse": "eclipse",
    "gnu": "gnu", "general": "gnu", "gpl": "gnu", "cc": "cc", "creative": "cc", "commons": "cc"}
#: Words that make another license of a family, and the family.
VARIANT = {
    **dict.fromkeys(["lesser", "lgpl"], ("lesser", "gnu")), **dict.fromkeys(["affero", "agpl"], ("affero", "gnu")),
    "library": ("library", "gnu"), **dict.fromkeys(["documentation", "gfdl"], ("documentation", "gnu")),
    **dict.fromkeys(["attribution", "by"], ("by", "cc")),
    **dict.fromkeys(["noncommercial", "commercial", "nc"], ("nc", "cc")),
    **dict.fromkeys(["sharealike", "alike", "sa"], ("sa", "cc")),
    **dict.fromkeys(["noderivatives", "noderivs", "derivatives", "derivative", "derivs", "nd"], ("nd", "cc"))}
_NUMBER = re.compile(r"v?([0-9]{1,3})")
_CODES = ["", *sorted({*FAMILY.values(), *(v for v, _ in VARIANT.values())}), *"0123456789"]


def license_key(words: list[str]) -> tuple[frozenset[str], frozenset[str], tuple[int, ...]]:
    """Families, variants of these and version (without final zeros) that lower-case words name."""
    family = frozenset(FAMILY[x] for x in words if x in FAMILY)
    variant = frozenset(VARIANT[x][0] for x in words if x in VARIANT and VARIANT[x][1] in family)
    version = [int(m[1]) for m in map(_NUMBER.fullmatch, words) if m]
    while version and not version[-1]:
        version.pop()
    return family, variant, tuple(version)


def _hashes(text: str) -> np.ndarray:
    data, off = text_bytes(pa.array([text], pa.large_string()), 0, 1)
    data = LOWER[data]
    w = Words(data, off, _BREAK)
    return span_hashes(data, w.start, w.end)


def _strings(text: str) -> list[str]:
    data, off = text_bytes(pa.array([text], pa.large_string()), 0, 1)
    data = LOWER[data]
    w = Words(data, off, _BREAK)
    return [data[a:z].tobytes().decode() for a, z in zip(w.start, w.end)]


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions kept: the smallest hash of each window, the last of equals."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(at + np.arange(len(views)))


class Index:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: dict[str, str] | list[tuple[str, str]], gram: int = GRAM, window: int = WINDOW):
        pairs = list(templates.items() if isinstance(templates, dict) else templates)
        self.names = [n for n, _ in pairs]
        self.gram = gram
        self.words = [_hashes(t) for _, t in pairs]
        self.named, self.key, self.need = [], [], []
        h, owner, place = [], [], []
        for i, w in enumerate(self.words):
            if len(w) < max(gram, MIN_WORDS):
                raise ValueError(f"template {self.names[i]!r} has fewer than {max(gram, MIN_WORDS)} words")
            g, at = windows(w, np.zeros(len(w), np.int64), gram)
            kept = winnow(g, 1 if len(w) <= SHORT else window)
            h.append(g[kept])
            owner.append(np.full(len(kept), i))
            place.append(at[kept])
            # the name: from the first family word to the last telling one after it
            words = _strings(pairs[i][1])
            first = next((j for j, x in enumerate(words) if x in FAMILY), None)
            own = license_key(words)[0]
            end = 0 if first is None else 1 + max(
                j for j, x in enumerate(words) if x in FAMILY or _NUMBER.fullmatch(x) or x in VARIANT and VARIANT[x][1] in own)
            self.named.append((first or 0, end))
            self.key.append(license_key(words[first or 0:end]))
            family, variant, version = self.key[-1]
            self.need.append([_CODES.index(x) for x in [*family, *variant, *(str(n % 10) for n in version)]])
        self.vocabulary = np.unique(np.concatenate(self.words))
        telling = {x: _CODES.index(FAMILY.get(x) or VARIANT[x][0]) for x in [*FAMILY, *VARIANT]}
        spelt = _hashes(" ".join(telling))
        order = np.argsort(spelt)
        self.telling, self.code = spelt[order], np.array(list(telling.values()))[order]
        h, owner, place = map(np.concatenate, (h, owner, place))
        order = np.argsort(h, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.first = np.append(self.first, len(h))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram index, template, place in it) of all hits."""
        at = np.minimum(np.searchsorted(self.hash, grams), len(self.hash) - 1)
        where = np.flatnonzero(self.hash[at] == grams)
        lo, hi = self.first[at[where]], self.first[at[where] + 1]
        n = hi - lo
        row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(where, n), self.owner[row], self.place[row]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Best alignment of all of ``template`` with a stretch of ``text`` whose
    diagonals lie within ``band`` of ``shift`` (match 2, mismatch and gap -1;
    unused template words at the ends cost nothing).  Returns the number of
    matched words and the stretch (first word, end) in the text."""
    return _align(template, text, shift, band)[:3]


def _align(template, text, shift, band):
    """``align`` and the matched (place in the template, place in the text), ascending."""
    best = (0, 0, 0, 0, None)
    width = 2 * band + 1
    blank = (0, 0, -1, 0, None)  # score, matches, first matched word, end of the last, last match and those before
    row = [blank] * width
    for i in range(len(template)):
        new = []
        for b in range(width):
            j = i + shift + b - band
            up = row[b + 1] if b + 1 < width else blank
            left = new[b - 1] if b else blank
            cell = max(blank, (up[0] - 1, *up[1:]), (left[0] - 1, *left[1:]), key=lambda c: c[:2])
            if 0 <= j < len(text):
                s, m, a, e, pairs = row[b]
                same = text[j] == template[i]
                step = (s + 2, m + 1, a if m else j, j + 1, (i, j, pairs)) if same else (s - 1, m, a, e, pairs)
                if step[:2] > cell[:2]:
                    cell = step
            new.append(cell)
            if cell[:2] > best[:2]:
                best = cell
        row = new
    pairs, at = [], best[4]
    while at:
        pairs.append(at[:2])
        at = at[2]
    return best[1], best[2], best[3], pairs[::-1]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE,
         band: int = BAND) -> DataFrame:
    """One row per match: ``doc_id``, ``license``, ``coverage`` (matched share
    of the template's words), ``matched_words``, ``start_char``, ``end_char``
    (code points of the text) and ``span``, that part of the text."""
    index = Index(templates or [*TEMPLATES.items(), *FORMS])
    names = ["doc_id", "license", "coverage", "matched_words", "start_char", "end_char", "span"]

    def task(batches):
        for b in batches:
            whole, rows = text_column(b), []
            for lo, hi in runs(whole):
                data, off = text_bytes(whole, lo, hi)
                lower = LOWER[data]
                w = Words(lower, off, _BREAK)
                h = span_hashes(lower, w.start, w.end)
                g, at = windows(h, w.doc, index.gram)
                hit, owner, place = index.hits(g)
                for doc, t, first, end, got in _matches(index, lower, h, w, at[hit], owner, place, min_coverage, band):
                    a, z = int(w.start[first]), int(w.end[end - 1])
                    span = data[a:z].tobytes().decode()
                    before = len(data[off[doc]:a].tobytes().decode())
                    rows.append((lo + doc, index.names[t], got / len(index.words[t]), got, before,
                                 before + len(span), span))
            if rows:
                at, *rest = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(at)), *map(pa.array, rest)], names)

    return docs.select("doc_id", "text").mapInArrow(
        task, "doc_id long, license string, coverage double, matched_words long, start_char long, end_char long, "
              "span string")


def _reach(template: np.ndarray, band: int) -> int:
    return min(band, len(template) // 2)  # copies of a short notice in a row stay apart


def _possible(index, data, h, w, word, owner, place, min_coverage, band):
    """Hits around which the text holds enough words of the template and all its name needs."""
    keep = np.zeros(len(word), bool)
    if not len(word):
        return keep
    at = np.minimum(np.searchsorted(index.telling, h), len(index.telling) - 1)
    last = data[w.end - 1]
    digit = np.where((last >= 48) & (last < 58), last.astype(np.int64) - 48 + len(_CODES) - 10, 0)
    code = np.where(index.telling[at] == h, index.code[at], digit)
    spot = {c: np.flatnonzero(code == c) for c in {c for t in np.unique(owner) for c in index.need[t]}}
    known = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    known = np.where(index.vocabulary[known] == h, known, len(index.vocabulary))
    for t in np.unique(owner):
        template = index.words[t]
        reach = _reach(template, band)
        rows = np.flatnonzero(owner == t)
        shift = word[rows] - place[rows]
        doc = w.doc[word[rows]]
        lo = np.maximum(w.first[doc], shift - reach)
        hi = np.minimum(w.first[doc + 1], shift + len(template) + 2 * reach)
        good = np.ones(len(rows), bool)
        for c in index.need[t]:
            good &= np.searchsorted(spot[c], hi) > np.searchsorted(spot[c], lo)
        if good.any():
            member = np.append(np.isin(index.vocabulary, template), False)
            n = np.concatenate([[0], np.cumsum(member[known])])
            good &= n[hi] - n[lo] >= min_coverage * len(template)
            keep[rows] = good
    return keep


def _same_license(index, t, pairs, data, w, lo, stop):
    """The words in the place of the template's name name the same license.  ``pairs``: matched
    words, in the text counted from ``lo``; the document ends at word ``stop``."""
    first, end = index.named[t]
    if first == end:
        return True
    inside = [j for i, j in pairs if first <= i < end]
    if not inside:
        return False
    a = lo + max((j + 1 for i, j in pairs if i < first), default=inside[0])
    z = lo + min((j for i, j in pairs if i >= end), default=inside[-1] + 1)
    if not any(i >= end for i, _ in pairs):  # version 2 must not go on as 2.1
        while z < stop and w.start[z] == w.end[z - 1] + 1 and data[w.end[z - 1]] == 46 and 48 <= data[w.start[z]] < 58:
            z += 1
    words = [data[w.start[j]:w.end[j]].tobytes().decode() for j in range(a, z)]
    family, variant, version = license_key(words)
    f, v, n = index.key[t]
    return f <= family and v == variant and n in ((), version)


def _matches(index, data, h, w, word, owner, place, min_coverage, band):
    """Accepted matches (document, template, first word, end word, matched)."""
    keep = _possible(index, data, h, w, word, owner, place, min_coverage, band)
    word, owner, place = word[keep], owner[keep], place[keep]
    doc = w.doc[word]
    shift = word - place
    order = np.lexsort((shift, owner, doc))
    found, tried, last = [], {}, None
    for d, t, s in zip(doc[order].tolist(), owner[order].tolist(), shift[order].tolist()):
        if last == (d, t, s):
            continue
        last = (d, t, s)
        template = index.words[t]
        reach = _reach(template, band)
        lo = max(int(w.first[d]), s - reach)
        hi = min(int(w.first[d + 1]), s + len(template) + 2 * reach)
        # the same words around the same diagonal give the same alignment
        key = (t, s - lo, h[lo:hi].tobytes())
        if key not in tried:
            tried[key] = _align(template, h[lo:hi], s - lo, reach)
        got, a, z, pairs = tried[key]
        if got >= min_coverage * len(template) and _same_license(index, t, pairs, data, w, lo, int(w.first[d + 1])):
            found.append((d, -got, a + lo, t, z + lo))
    # of overlapping matches in one document the one with most words stays
    kept: list[tuple] = []
    starts: list[tuple] = []  # (document, first word, end) of the kept, ascending; they never overlap
    for d, got, a, t, z in sorted(found):
        i = bisect_left(starts, (d, a, z))
        if (i and starts[i - 1][0] == d and starts[i - 1][2] > a) or (
                i < len(starts) and starts[i][0] == d and starts[i][1] < z):
            continue
        starts.insert(i, (d, a, z))
        kept.append((d, t, a, z, -got))
    return sorted(kept, key=lambda m: (m[0], m[2]))
