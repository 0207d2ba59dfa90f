"""Markdown is cut at the largest structure that it has: headings, fences, rules, paragraphs, lines, words, characters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from millrace.operators.chunking.base import Chunk, line_of

SEPARATORS = (*("\n" + "#" * k + " " for k in range(2, 7)), "```\n\n", *(f"\n\n{c * 3}\n\n" for c in "*-_"), "\n\n", "\n", " ", "")


def _pieces(text: str, size: int, separators: Sequence[str]) -> list[str]:
    """Pieces of at most `size` characters if the separators allow it; a separator stays at the end of the piece before it."""
    sep = next((s for s in separators if s in text), None) if len(text) > size else None
    if sep is None:
        return [text]
    parts = list(text) if sep == "" else text.split(sep)
    parts = [p + sep for p in parts[:-1]] + parts[-1:]
    return [piece for p in parts for piece in ([p] if len(p) <= size else _pieces(p, size, separators[1:]))]


def split_text(text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> list[Chunk]:
    """Chunks of about `size` characters; each but the first begins with the last `overlap` characters of the one before, if that is longer.

    Spans are where the chunk's text is found from the last one's on; an overlap may make a chunk longer than `size`.
    """
    if len(text) <= size:
        return [Chunk(text, (0, len(text)), (1, line_of(text, len(text))))]
    out: list[Chunk] = []
    held, after = "", 0

    def close(last: bool) -> None:
        nonlocal after
        at = text.find(held, after)
        start = at if at >= 0 else after
        end = len(text) if last and at < 0 else start + len(held)
        out.append(Chunk(held, (start, end), (line_of(text, start), line_of(text, end))))
        after = max(0, start + len(held) - overlap)

    for piece in _pieces(text, size, separators):
        if len(held) + len(piece) <= size:
            held += piece
            continue
        if held:
            close(False)
        held = (held[-overlap:] if 0 < overlap < len(held) else "") + piece
    if held:
        close(True)
    return out


def markdown_chunker(size: int = 1000, overlap: int = 200) -> Callable[[str, str], list[Chunk]]:
    """split_text() as a chunker."""
    return lambda content, _id: split_text(content, size, overlap)
