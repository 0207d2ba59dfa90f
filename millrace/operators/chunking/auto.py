"""Chunks by kind of content."""

from __future__ import annotations

from collections.abc import Callable

from millrace.functions.identifiers import content_type
from millrace.operators.chunking.base import Chunk
from millrace.operators.chunking.code import code_chunker
from millrace.operators.chunking.markdown import markdown_chunker


def auto_chunker(markdown: dict | None = None, code: dict | None = None) -> Callable[[str, str], list[Chunk]]:
    """Code by the ending of its id, all else as markdown."""
    by = {"markdown": markdown_chunker(**(markdown or {})), "code": code_chunker(**(code or {}))}
    return lambda content, id_: by[content_type(id_)](content, id_)
