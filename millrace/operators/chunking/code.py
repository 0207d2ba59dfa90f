"""TypeScript and JavaScript, cut at declarations by a scanner that knows strings, templates, comments, regular expressions and brackets.

It is no compiler: of JSX, and of expressions whose end only a grammar can tell, it makes the best of brackets and line
ends. Declarations inside functions and classes belong to these; those inside unnamed blocks and callbacks count as top level.
Chunks cover declarations; text between them goes with the chunk it lies in, and, unlike some chunkers, text before the
first, after the last and between two chunks is kept, with the following chunk or the last.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from millrace.operators.chunking.base import Chunk, line_of

_IDENT = r"[A-Za-z_$][\w$]*"
_SKIP = re.compile(r"\s+|//[^\n]*|/\*.*?\*/", re.S)
_DECLARATION = re.compile(rf"(?P<mods>(?:(?:export|default|declare|abstract|async)\s+)*)(?P<kind>function\s*\*?|class|interface|enum|type|namespace|module|const\s+enum|const|let|var)\b\s*(?P<name>{_IDENT}|\"[^\"\n]*\"|'[^'\n]*')?")
_MEMBER = re.compile(rf"(?P<mods>(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|accessor)\s+)*)(?P<accessor>(?:get|set)\s+(?=[\w$#\[\"']))?(?P<star>\*\s*)?(?P<name>#?{_IDENT}|\[[^\]\n]*\]|\"[^\"\n]*\"|'[^'\n]*'|\d+)\s*(?P<mark>[?!]?)\s*(?=[(<:=;\n}}]|$)")
_IMPORT = re.compile(rf"import\s+(?:type\s+)?(?:(?P<clause>[^'\";]*?)\s*from\s*)?(?P<q>['\"])(?P<source>[^'\"\n]*)(?P=q)")
_KINDS = {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type", "namespace": "namespace", "module": "namespace", "const": "variable", "let": "variable", "var": "variable"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, ")]}"


@dataclass
class Declaration:
    """A named declaration; offsets of its own text."""

    name: str
    type: str
    signature: str
    start: int
    end: int
    children: list[Declaration] = field(default_factory=list)

    def entity(self) -> dict:
        return {"name": self.name, "type": self.type, "signature": self.signature or None, "is_partial": None}


class _Scanner:
    """Finds ends of things in source text."""

    def __init__(self, s: str):
        self.s = s
        self.n = len(s)

    def blank(self, i: int) -> int:
        """After white space and comments."""
        while i < self.n and (m := _SKIP.match(self.s, i)):
            i = m.end()
        return i

    def quoted(self, i: int) -> int:
        """After the string, template, comment or regular expression at i; i + 1 if there is none."""
        s, c = self.s, self.s[i]
        if c in "'\"":
            m = re.compile(rf"{c}(?:\\.|[^\\\n{c}])*{c}?", re.S).match(s, i)
            return m.end()
        if c == "`":
            j = i + 1
            while j < self.n and s[j] != "`":
                if s[j] == "\\":
                    j += 2
                elif s.startswith("${", j):
                    j = self.closed(j + 1)
                else:
                    j += 1
            return min(self.n, j + 1)
        if c == "/":
            if m := _SKIP.match(s, i):
                return m.end()
            before = s[:i].rstrip()[-1:]
            word = re.search(r"[\w$]+$", s[max(0, i - 12) : i].rstrip())
            if before == "" or before in "(,=:[!&|?{};+-*%~^<>" or word and word[0] in ("return", "typeof", "case", "in", "of"):
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*").match(s, i)
                return m.end() if m else i + 1
        return i + 1

    def closed(self, i: int) -> int:
        """After the bracket that closes the one at i."""
        depth, j = 0, i
        while j < self.n:
            c = self.s[j]
            if c in "'\"`/":
                j = self.quoted(j)
                continue
            if c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth -= 1
                if depth <= 0:
                    return j + 1
            j += 1
        return self.n

    def statement(self, i: int, stops: str = ";") -> int:
        """The end of an expression or type from i: before a stop, or a line end at which no more is expected."""
        j = i
        while j < self.n:
            c = self.s[j]
            if c in stops or c in _CLOSE:
                return j
            if c in _OPEN:
                j = self.closed(j)
                continue
            if c in "'\"`/":
                j = self.quoted(j)
                continue
            if c == "\n":
                k = self.blank(j)
                left = self.s[i:j].rstrip()
                if k >= self.n:
                    return j
                if left and not re.search(r"(?:[=+\-*/%&|^!~?:,.<({\[]|=>|\b(?:extends|in|of|typeof|keyof|new|await|return))$", left) and not re.match(r"[.?:&|+\-*/%=<>,)\]}^]|instanceof\b|in\b|as\b|satisfies\b", self.s[k:]):
                    return j
            j += 1
        return self.n

    def angle(self, i: int) -> int:
        """After the type parameters at i, if there are any."""
        if i >= self.n or self.s[i] != "<":
            return i
        depth = 0
        for j in range(i, self.n):
            depth += {"<": 1, ">": -1 if self.s[j - 1] != "=" else 0}.get(self.s[j], 0)
            if depth == 0:
                return j + 1
        return i


def _flat(text: str) -> str:
    return text.strip()


def _parameters(sc: _Scanner, i: int) -> tuple[str, int]:
    """(parameters joined by comma and space, offset after the bracket) of the list at i."""
    end = sc.closed(i)
    parts, start, j = [], i + 1, i + 1
    while j < end - 1:
        c = sc.s[j]
        if c in _OPEN:
            j = sc.closed(j)
        elif c in "'\"`/":
            j = sc.quoted(j)
        elif c == "<" and (k := sc.angle(j)) > j:
            j = k
        elif c == ",":
            parts.append(_flat(sc.s[start:j]))
            j += 1
            start = j
        else:
            j += 1
    parts.append(_flat(sc.s[start : end - 1]))
    return ", ".join(p for p in parts if p), end


def _returns(sc: _Scanner, i: int) -> tuple[str, int]:
    """(": type" or nothing, offset after it) of the return type at i; it ends before a body or statement's end."""
    j = sc.blank(i)
    if j >= sc.n or sc.s[j] != ":":
        return "", i
    k = start = sc.blank(j + 1)
    while k < sc.n:
        c = sc.s[k]
        if c == "{":
            before = sc.s[start:k].rstrip()
            if before and before[-1] not in "|&<,:(=":
                break
            k = sc.closed(k)
            continue
        if c in "([":
            k = sc.closed(k)
            continue
        if c == "<":
            k = max(k + 1, sc.angle(k))
            continue
        if c in ";=" and sc.s[k : k + 2] != "=>" or c in _CLOSE or c == "\n" and sc.s[start:k].strip():
            break
        k += 2 if sc.s[k : k + 2] == "=>" else 1
    return f": {_flat(sc.s[start:k])}", k


def _body(sc: _Scanner, i: int) -> int:
    j = sc.blank(i)
    if j < sc.n and sc.s[j] == "{":
        return sc.closed(j)
    return j + 1 if j < sc.n and sc.s[j] == ";" else i


def _members(sc: _Scanner, i: int, end: int) -> list[Declaration]:
    """Methods, accessors and properties in the class body from i to end."""
    out, j = [], i
    while (j := sc.blank(j)) < end:
        if sc.s[j] == "@":  # decorator
            j = re.compile(r"@[\w$.]+").match(sc.s, j).end() if re.compile(r"@[\w$.]+").match(sc.s, j) else j + 1
            j = sc.closed(j) if j < end and sc.s[j] == "(" else j
            continue
        m = _MEMBER.match(sc.s, j)
        if not m or m.end() > end:
            j = sc.closed(j) if sc.s[j] in _OPEN else sc.quoted(j) if sc.s[j] in "'\"`/" else j + 1
            continue
        name, start, k = m["name"], m.start(), sc.angle(sc.blank(m.end()))
        if k < end and sc.s[k] == "(":
            params, k = _parameters(sc, k)
            types, k = _returns(sc, k)
            k = _body(sc, k)
            if name == "constructor":
                out += _block(sc, start, k)
            elif m["accessor"]:
                out.append(Declaration(name, "getter" if m["accessor"].startswith("get") else "setter", name, start, k))
            else:
                out.append(Declaration(name, "method", f"{'async ' if 'async' in m['mods'].split() else ''}{name}({params}){types}", start, k))
        else:
            k = sc.statement(k)
            k += k < end and sc.s[k] == ";"
            out.append(Declaration(name, "property", name, start, k))
        j = max(k, j + 1)
    return out


def _variables(sc: _Scanner, i: int) -> tuple[list[Declaration], int]:
    """The variables of a statement whose names begin at i, and the statement's end."""
    out = []
    while True:
        i = sc.blank(i)
        m = re.compile(_IDENT).match(sc.s, i)
        if not m:  # a pattern
            end = sc.statement(i, ";,")
        else:
            j, types = sc.blank(m.end()), ""
            if j < sc.n and sc.s[j] in ":!":
                types, _ = _returns(sc, j + (sc.s[j] == "!"))
            end = sc.statement(i, ";,")
            end = i + len(sc.s[i:end].rstrip())
            out.append(Declaration(m[0], "variable", m[0] + types, i, end, _block(sc, m.end(), end)))
        j = sc.blank(end)
        if j < sc.n and sc.s[j] == ",":
            i = j + 1
            continue
        return out, end


def _block(sc: _Scanner, i: int, end: int) -> list[Declaration]:
    """Declarations between two offsets, those in nested brackets too."""
    out: list[Declaration] = []
    j = i
    while j < end:
        j = sc.blank(j)
        if j >= end:
            break
        c = sc.s[j]
        if c in "'\"`/":
            j = sc.quoted(j)
            continue
        if c == "i" and (m := _IMPORT.match(sc.s, j)):
            j = m.end()
            continue
        m = _DECLARATION.match(sc.s, j) if (c.isalpha() or c in "_$") and (j == 0 or not re.match(r"[\w$.]", sc.s[j - 1])) else None
        kind = re.split(r"[\s*]+", m["kind"])[-1 if m and m["kind"].endswith("enum") else 0] if m else ""
        if not m or not (m["name"] or kind in ("const", "let", "var")) or kind in ("type", "module", "namespace") and not m["name"]:
            w = re.compile(r"[\w$]+").match(sc.s, j)
            j = w.end() if w else j + 1
            continue
        name, k = m["name"] or "", m.end()
        if kind in ("const", "let", "var"):
            found, k = _variables(sc, m.start("name") if m["name"] else sc.blank(m.end("kind")))
            out += found
        elif kind == "function":
            k = sc.angle(sc.blank(k))
            if k >= sc.n or sc.s[k] != "(":
                j = m.end()
                continue
            params, k = _parameters(sc, k)
            types, k = _returns(sc, k)
            body = _body(sc, k)
            mods = m["mods"].split()
            text = f"{'export ' if 'export' in mods else ''}{'async ' if 'async' in mods else ''}function {name}({params}){types}"
            out.append(Declaration(name, "function", text, m.start(), body, _block(sc, k, body)))
            k = body
        elif kind == "type":
            k = sc.statement(k)
            k += k < sc.n and sc.s[k] == ";"
            out.append(Declaration(name, "type", name, m.start(), k))
        else:
            head = k
            while k < sc.n and sc.s[k] != "{":
                k = max(k + 1, sc.angle(k)) if sc.s[k] == "<" else sc.quoted(k) if sc.s[k] in "'\"/" else k + 1
            after = sc.closed(k) if k < sc.n else sc.n
            rest = re.sub(r"\s+", " ", sc.s[sc.angle(sc.blank(head)) : k]).strip()
            text = f"{kind} {name}{' ' + rest if rest else ''}" if kind in ("class", "interface") else name.strip("\"'")
            kids = _members(sc, k + 1, after - 1) if kind == "class" else _block(sc, k + 1, after - 1) if kind in ("namespace", "module") else []
            out.append(Declaration(name, _KINDS[kind], text, m.start(), after, kids))
            k = after
        j = max(k, j + 1)
    return out


def declarations(source: str) -> list[Declaration]:
    """Top-level declarations of a source text, in order, with those inside them."""
    return _block(_Scanner(source), 0, len(source))


def imports(source: str) -> tuple[list[dict], int]:
    """(imported names, offset after the imports at the start)."""
    sc, out, end, leading = _Scanner(source), [], 0, True
    j = sc.blank(0)
    while j < sc.n:
        m = _IMPORT.match(source, j)
        if not m:
            leading = False
            j = sc.statement(j) + 1
            j = sc.blank(j)
            continue
        src, clause = m["source"], m["clause"]
        name = lambda n, **flags: out.append({"name": n, "source": src, "is_default": flags.get("d"), "is_namespace": flags.get("s")})  # noqa: B023, E731
        if clause is None:
            name(src)
        else:
            braces = re.search(r"\{(.*?)\}", clause, re.S)
            rest = clause.replace(braces[0], "") if braces else clause
            for part in (p.strip() for p in rest.split(",")):
                if part.startswith("*"):
                    name(part.split()[-1], s=True)
                elif part:
                    name(part, d=True)
            for part in (p.strip() for p in (braces[1].split(",") if braces else [])):
                if part:
                    name(part.removeprefix("type ").split()[-1])
        j = m.end()
        if j < sc.n and source[j] == ";":
            j += 1
        if leading:
            end = j
        j = sc.blank(j)
    return out, end


def scope_chain(target: Declaration, decls: list[Declaration]) -> list[dict]:
    """Declarations (name and type) that a declaration stands in, the innermost first."""
    of = lambda d: {"name": d.name, "type": d.type, "signature": None, "is_partial": None}
    for d in decls:
        if any(c is target for c in d.children):
            return [of(d)]
        if inner := scope_chain(target, d.children):
            return [*inner, of(d)]
    return []


def _siblings(decls: list[Declaration], at: int, reach: int = 3) -> list[dict]:
    order = [*range(at - 1, max(-1, at - reach - 1), -1), *range(at + 1, min(len(decls), at + reach + 1))]
    return [{"name": decls[k].name, "type": decls[k].type, "position": "before" if k < at else "after", "distance": abs(k - at)} for k in order]


def code_chunker(max_chunk_size: int | None = None, max_tokens: int | None = None, filter_imports: bool = False, overlap_lines: int = 0) -> Callable[[str, str], list[Chunk]]:
    """Chunks of whole top-level declarations, as many as fit max_chunk_size (1,000, or what max_tokens allow at 3.5 characters each, less 15 %)."""
    size = max_chunk_size or (int(max_tokens * 3.5 * 0.85) if max_tokens else 1000)

    def cut(content: str, _id: str) -> list[Chunk]:
        decls = declarations(content)
        imported, import_end = imports(content)
        groups: list[tuple[int, list[int]]] = []
        start = import_end if filter_imports and len(content) > size else 0
        held: list[int] = []
        if len(content) > size:
            for k, d in enumerate(decls):
                if held and d.end - start > size:
                    groups.append((start, held))
                    start, held = decls[held[-1]].end, []
                held.append(k)
        if held or not groups:
            groups.append((start, held if len(content) > size else list(range(len(decls)))))
        out = []
        for g, (begin, mine) in enumerate(groups):
            end = decls[mine[-1]].end if g < len(groups) - 1 else len(content)
            text = content[begin:end]
            first = line_of(content, begin + len(text) - len(text.lstrip()))
            scope = scope_chain(decls[mine[0]], decls) if mine else []
            context = " > ".join(f"{d['type']} {d['name']}" for d in scope) or None
            chunk = Chunk(text.strip(), None, (first, line_of(content, begin + len(text.rstrip()))), context, [decls[k].entity() for k in mine], scope, imported, _siblings(decls, mine[0]) if mine else [])
            if overlap_lines > 0 and first > 1:
                above = "\n".join(content.split("\n")[max(0, first - 1 - overlap_lines) : first - 1])
                if above.strip():
                    chunk.text = f"{above}\n{chunk.text}"
            out.append(chunk)
        return out

    return cut
