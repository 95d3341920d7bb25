"""Text column helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A sentence is a run of non-terminators followed by . ! or ?;
# without any sentence the text is cut to this many characters.
SENTENCE = r"[^.!?]+[.!?]+"
FALLBACK_CHARS = 120


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate_sentences(c, n: int) -> Column:
    """The first ``n`` sentences joined by a space (trimmed); a text with no
    complete sentence falls back to its first 120 characters."""
    c = _c(c)
    sentences = F.regexp_extract_all(c, F.lit(SENTENCE), 0)
    return F.when(c.isNull(), F.lit(None)).when(
        F.size(sentences) == 0, F.substring(c, 1, FALLBACK_CHARS)).otherwise(
        F.trim(F.array_join(F.slice(sentences, 1, n), " ")))


def contains_ci(text, needle) -> Column:
    """Case-insensitive literal containment (no LIKE wildcards to escape)."""
    return F.lower(_c(text)).contains(F.lower(_c(needle)) if not isinstance(needle, str) else needle.lower())


def any_field_contains(fields, query: str) -> Column:
    """Free-text filter over several fields, OR'd, null-safe."""
    q = query.lower()
    out = None
    for f in fields:
        term = F.coalesce(F.lower(_c(f)).contains(q), F.lit(False))
        out = term if out is None else out | term
    return out


def word_match(text, needle) -> Column:
    """Case-insensitive whole-word match of a literal needle (Unicode-aware
    ``(?iu)``, the needle quoted with \\Q..\\E)."""
    pat = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}_])\\Q"), _c(needle), F.lit("\\E(?![\\p{L}\\p{N}_])"))
    return F.regexp_like(_c(text), pat)
