"""Identifiers in queries: splitting, expansion, and the terms a query is searched by. Pure Python but for the column forms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places at which an identifier's case changes: before a capital after a small letter, and before the last of some capitals.
_TURN = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
_CODE = r"[a-z][A-Z]|[A-Z]{2}[a-z]|[_.]"
#: Marks that a search string is cleared of; apostrophe and underscore stay.
MARKS = "\\" + "?\"():^*-=<>[]{}/|@#$%&~`+,.;!"
_CLEAR = str.maketrans(dict.fromkeys(MARKS, " "))


def is_identifier(token: str) -> bool:
    """Whether a word looks like code: a change of case inside, an underscore or a dot."""
    return re.search(_CODE, token) is not None


def parts_of(token: str) -> list[str]:
    """The words of an identifier: at dots, else at underscores, else at changes of case."""
    if "." in token:
        return [p for piece in token.split(".") for p in parts_of(piece)]
    if "_" in token:
        return [p for p in token.split("_") if p]
    found = [p for p in re.sub(_TURN, " ", token).split(" ") if p]
    return found if len(found) > 1 else [token]


def expand(query: str) -> str:
    """The query with every identifier preceded by its parts."""
    out: list[str] = []
    for word in query.split():
        if is_identifier(word) and len(parts := parts_of(word)) > 1:
            out += parts
        out.append(word)
    return " ".join(out)


def search_terms(query: str) -> list[str]:
    """Words of a query without marks."""
    return query.translate(_CLEAR).split()


@dataclass(frozen=True)
class Match:
    """Phrases that must all occur (mode "and") or of which one must ("or")."""

    phrases: tuple[str, ...]
    mode: str

    def fts(self) -> str:
        """The same as a full-text match string."""
        return (" " if self.mode == "and" else " OR ").join(f'"{p}"' for p in self.phrases)


def match(query: str, mode: str) -> Match | None:
    """Phrases of a query; None without any. A single phrase is the same in both modes."""
    terms = tuple(search_terms(query))
    if not terms:
        return None
    return Match(terms, "and" if len(terms) == 1 else mode)


def identifier_flag(token: Column) -> Column:
    """is_identifier() of a column."""
    return token.rlike(_CODE)


def expanded(token: Column) -> Column:
    """expand() of a column of single words without dots."""
    camel = F.regexp_replace(token, _TURN, " ")
    snake = F.array_join(F.filter(F.split(token, "_"), lambda p: p != ""), " ")
    parts = F.when(token.contains("_"), snake).otherwise(camel)
    return F.when(identifier_flag(token) & parts.contains(" "), F.concat_ws(" ", parts, token)).otherwise(token)


CODE_ENDINGS = tuple(a + b for b in ("ts", "js") for a in ("", "m", "c")) + ("tsx", "jsx")


def content_type(path: str) -> str:
    """"code" for names with an ending of TypeScript or JavaScript, else "markdown"."""
    return "code" if path.rsplit(".", 1)[-1].lower() in CODE_ENDINGS else "markdown"


def content_type_column(path: Column) -> Column:
    """content_type() of a column."""
    return F.when(F.lower(F.substring_index(path, ".", -1)).isin(*CODE_ENDINGS), "code").otherwise("markdown")
