"""What chunkers give."""

from __future__ import annotations

from dataclasses import dataclass, field

ENTITY = "struct<name:string,type:string,signature:string,is_partial:boolean>"


@dataclass
class Chunk:
    """A piece of a document; offsets in characters, end exclusive; lines from 1, both included."""

    text: str
    span: tuple[int, int] | None = None
    lines: tuple[int, int] | None = None
    context: str | None = None
    entities: list[dict] = field(default_factory=list)
    scope: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    siblings: list[dict] = field(default_factory=list)

    def row(self) -> dict:
        """The chunk under the column names of chunked()."""
        start, end = self.span or (None, None)
        first, last = self.lines or (None, None)
        return {"text": self.text, "start": start, "end": end, "first_line": first, "last_line": last, "context": self.context, "entities": self.entities or None, "scope": self.scope or None, "imports": self.imports or None, "siblings": self.siblings or None}


def line_of(text: str, offset: int) -> int:
    """The line, from 1, of a character offset."""
    return text.count("\n", 0, max(0, offset)) + 1
