"""Columns over text: terms, headings, snippets, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"
#: Words that count for little in highlights.
STOPWORDS = frozenset(
    "a all an and are as at be been both but by can could did do does each every few for from had has have how in is it its may might more most must"
    " no not of on only or other our should some such that the their them these they this those to was we were what when where which who why will with would you your".split()
)
K1, B = 1.2, 0.75
TYPICAL_CHARS = 500


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), 0)


def term_count(tokens: Column, term: str) -> Column:
    """Occurrences of a term in an array of terms."""
    return F.size(F.filter(tokens, lambda t: t == term))


def headings(text: Column) -> Column:
    """The heading lines of markdown without their marks, joined by line breaks; fenced code is left out."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", "")
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"^#{1,6}\s"))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^#{1,6}\s+", "")), "\n")


def count_of(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a string, the case ignored."""
    low, p = F.lower(text), F.lower(part)
    return ((F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.greatest(F.length(p), F.lit(1))).cast("int")


def query_words(query: str) -> list[str]:
    """Lower-cased words of more than two letters, repeats included."""
    return [w for w in query.lower().split() if len(w) > 2]


def term_scores(text: Column, query: str) -> Column:
    """Array of (term, score, place) of the query's words that occur in the text, best first; of equal scores, the earlier word."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text) / F.lit(float(TYPICAL_CHARS))
    rows = []
    for k, w in enumerate(query_words(query)):
        tf = count_of(text, F.lit(w))
        damp = (0.1 if w in STOPWORDS else 1.0) * min(len(w) / 5, 1.5)
        score = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size)) * damp
        rows.append(F.struct(F.lit(w).alias("term"), F.when(tf > 0, score).alias("score"), F.lit(k).alias("place")))
    if not rows:
        return F.array().cast("array<struct<term:string,score:double,place:int>>")
    found = F.filter(F.array(*rows), lambda r: r["score"].isNotNull())

    def better(a: Column, b: Column) -> Column:
        return F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["place"] - b["place"])

    return F.array_sort(found, better)


def highlights(scores: Column, most: int = 5) -> Column:
    """The terms of term_scores(), the best few."""
    return F.transform(F.slice(scores, 1, most), lambda r: r["term"])


def snippet(text: Column, scores: Column, query: str, around: int = 2) -> Column:
    """The lines around the line that holds the greatest sum of term scores (the first such); the first lines if none holds any."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    words, whole = query_words(query), 2 * around + 1
    lookup = F.map_from_entries(F.transform(F.array_distinct(F.transform(scores, lambda r: r["term"])), lambda t: F.struct(t, F.element_at(F.filter(scores, lambda r: r["term"] == t), 1)["score"])))

    def value(line: Column) -> Column:
        low, total = F.lower(line), F.lit(0.0)
        for w in words:
            total = total + F.when(low.contains(w), F.coalesce(F.try_element_at(lookup, F.lit(w)), F.lit(1.0))).otherwise(0.0)
        return total

    values = F.transform(lines, value)
    best = F.array_position(values, F.array_max(values)).cast("int")
    first = F.when(F.array_max(values) > 0, F.greatest(best - around, F.lit(1))).otherwise(1)
    length = F.when(F.array_max(values) > 0, F.least(best + around, F.size(lines)) - first + 1).otherwise(whole)
    return F.when(F.size(lines) <= whole, F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.slice(lines, first, length), "\n"))


def line_at(text: Column, offset: Column) -> Column:
    """The number of the line, from 1, that a character offset lies in."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def content_hash(text: Column) -> Column:
    """SHA-256 in hexadecimal digits, the key of cached embeddings."""
    return F.sha2(F.encode(text, "UTF-8"), 256)
