"""Plain single-machine versions of the operators' definitions."""

import re

from tallyframe.llm import fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k=5):
    w = words(ascii_lower(text))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def components(sets, linked):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def jaccard(rows):
    """{doc_id: (set size, smallest reachable doc_id)} of (doc_id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]

    def linked(a, b):
        both = len(a & b)
        return bool(a and b) and 100 * both >= 75 * (len(a) + len(b) - both)
    root = components(sets, linked)
    low = {}
    for (d, _), r in zip(rows, root):
        low[r] = d if low.get(r) is None else min(low[r], d) if d is not None else low[r]
    return [(d, len(s), low[r]) for (d, _), s, r in zip(rows, sets, root)]


def line_dedup(rows, min_chars=20, min_docs=3):
    """(doc_id, lines, dropped, kept text) of (doc_id, text) rows."""
    def keys(text):
        return [ascii_lower(x).strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")]
    held = {}
    for d, t in rows:
        for k in set(keys(t)):
            if len(k) >= min_chars:
                held.setdefault(k, []).append(d)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [p for p, k in zip(parts, keys(t)) if k not in last or last[k] == d]
        out.append((d, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def base_measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {t for t in tri if tri.count(t) > 1} if len(tri) < 400 else {
        t for t, n in __import__("collections").Counter(tri).items() if n > 1}
    covered = {i + j for i, t in enumerate(tri) if t in twice for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def edited_rows(rows):
    """doc_id -> (n_chars, edited text, next doc_id), by descending doc_id."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        nd, nt = order[(i + 1) % len(order)]
        out[d] = (len(t or ""), fingerprint.edited(t or "", nt or ""), nd)
    return out
