"""Secret scans by a recursive decoding worklist.

A text is the first layer. Every layer is searched for secrets and for encoded regions, and every region that decodes is a
layer of its own that goes on the worklist until none is left: percent escapes (%41, %u0041, and once more with `+` as a
space), backslash escapes (\\u0041, \\u{41}, \\x41, \\101, \\", \\n ...) and character references (&#65;, &equals;), each decoded in
place with the text around them; base64 runs, wrapped over lines or not, from each of their first four letters; and
what streams (gzip, zlib, raw deflate, bzip2, xz, lzma, zstd) that start anywhere in decoded bytes unpack to. Of decoded bytes, stretches of printable
ASCII count, in one byte a character or two (UTF-16): a secret has no other characters. A layer carries for every
character the span of the original text that it came from. One that repeats a layer already seen at the same place is
not entered again, so cyclic encodings end.

All steps are linear in the length of a layer. Escapes nested more than MOST_DEPTH deep are unwrapped to their
fixpoint in one further step, without the layers between. A stream is scanned to its end however long it is,
in overlapping blocks of `block` bytes, and takes the time of its length; what it unpacks to has the span of the stream.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows are scanned each on
its own; bytes that are no UTF-8 are replaced and hide nothing around them.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html.entities
import lzma
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate(KINDS)}
BLOCK = 16 * 1024 * 1024
PIECE, FEED = 1024 * 1024, 4 * 1024
MOST_DEPTH = 6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "api")
#: What any secret, or region to decode, has.
_HOLDS = re.compile(r"passw|secret|token|api_?key|AKIA|%u?[0-9a-f]{2}|\\.|&[#a-z]|[a-z0-9+/_-]{16}|[a-z0-9+/_-]\s*\n\s*[a-z0-9+/_-]", re.I | re.A)
_PERCENT = re.compile(r"%u[0-9A-Fa-f]{4}|(?:%[0-9A-Fa-f]{2})++")
_BACKSLASH = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|([0-3][0-7]{2})|([nrtbfv0]|[!-/:-@\[-`{-~]))")
_NUMBERED = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|([0-3][0-7]{2})|((?!)))")
_REFERENCE = re.compile(r"&(?:#([0-9]{1,7});?|#[xX]([0-9A-Fa-f]{1,6});?|([A-Za-z][A-Za-z0-9]{1,31};))")
_ONE_LETTER = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_ENDS = re.compile(r"%u[0-9A-Fa-f]{4}\Z|%[0-9A-Fa-f]{2}\Z|\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[0-3][0-7]{2}|[nrtbfv]|[!-/:-@\[-`|~])\Z|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});\Z")
_LONGEST = 34
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++")
_LETTERS = re.compile(r"[A-Za-z0-9+/_-]++")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd|\x5d\x00\x00[\x00-\xff]{2}")
_PRINTED = ((re.compile(rb"[\t\r\n\x20-\x7e]{12,}+"), 0, 1), (re.compile(rb"(?:[\t\r\n\x20-\x7e]\0){12,}+"), 0, 2), (re.compile(rb"(?:\0[\t\r\n\x20-\x7e]){12,}+"), 1, 2))
_WORD = re.compile(r"\S++")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three kinds in one layer, by start, then kind."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]], s[2]))


class _Layer:
    """A decoded text; `at(i, j)` is the original span that its characters i to j came from. depth: escapes decoded one after another."""

    __slots__ = ("text", "starts", "ends", "whole", "depth")

    def __init__(self, text: str, starts: Sequence[int] | None, ends: Sequence[int] | None, whole: tuple[int, int], depth: int = 0):
        self.text, self.starts, self.ends, self.whole, self.depth = text, starts, ends, whole, depth

    def at(self, i: int, j: int) -> tuple[int, int]:
        if self.starts is None:
            return self.whole
        return self.starts[i], self.ends[j - 1]


Part = tuple[int, int, str, list[int]]  # start, end, the text instead, and the number of characters that each character of it stood in


def _spliced(layer: _Layer, parts: Sequence[Part], plus: bool = False) -> _Layer:
    """The layer with parts in place of what was there. plus: with `+` as a space in the words around them."""
    out, starts, ends, at = [], [], [], 0

    def between(i: int, j: int) -> str:
        text = layer.text[i:j]
        if plus and "+" in text:
            words = re.split(r"(\s+)", text)
            if i:
                words[0] = words[0].replace("+", " ")
            if j < len(layer.text):
                words[-1] = words[-1].replace("+", " ")
            text = "".join(words)
        return text

    for i, j, text, widths in parts:
        out += [between(at, i), text]
        if layer.starts is not None:
            starts += layer.starts[at:i]
            ends += layer.ends[at:i]
            for n in widths:
                starts.append(layer.starts[i])
                ends.append(layer.ends[i + n - 1])
                i += n
        at = j
    out.append(between(at, len(layer.text)))
    if layer.starts is None:
        return _Layer("".join(out), None, None, layer.whole, layer.depth + 1)
    return _Layer("".join(out), [*starts, *layer.starts[at:]], [*ends, *layer.ends[at:]], layer.whole, layer.depth + 1)


def _scalar(value: int) -> str:
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else "\ufffd"


def _unpercented(m: re.Match[str]) -> Part:
    if m[0][1] == "u":
        return m.start(), m.end(), _scalar(int(m[0][2:], 16)), [6]
    data = bytes.fromhex(m[0].replace("%", ""))
    if data.isascii():
        return m.start(), m.end(), data.decode(), [3] * len(data)
    text = data.decode("utf-8", "surrogateescape")
    return m.start(), m.end(), "".join("\ufffd" if "\ud800" <= c <= "\udfff" else c for c in text), [3 * len(c.encode("utf-8", "surrogateescape")) for c in text]


def _unslashed(m: re.Match[str]) -> str:
    if m[6]:
        return _ONE_LETTER.get(m[6], m[6])
    return _scalar(int(m[5], 8) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16))


def _referred(m: re.Match[str]) -> str | None:
    if m[3]:
        return html.entities.html5.get(m[3])
    return _scalar(int(m[1]) if m[1] else int(m[2], 16))


def _reduced(layer: _Layer) -> _Layer:
    """The layer with all escapes decoded, and those that these make, until none is left: a stack of characters, whose end is decoded when it is an escape."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    for k, c in enumerate(layer.text):
        s, e = layer.at(k, k + 1)
        out.append(c)
        starts.append(s)
        ends.append(e)
        while m := _ENDS.search("".join(out[-_LONGEST:])):
            if m[0][0] == "%":
                c = _scalar(int(m[0].lstrip("%u"), 16))
            elif m[0][0] == "&":
                c = _referred(_REFERENCE.match(m[0]))
            else:
                c = _unslashed(_BACKSLASH.match(m[0]))
            if c is None or c == m[0]:
                break
            n = len(m[0])
            s, e = starts[-n], ends[-1]
            out[-n:], starts[-n:], ends[-n:] = list(c), [s] * len(c), [e] * len(c)
    return _Layer("".join(out), None if layer.starts is None else starts, None if layer.starts is None else ends, layer.whole, layer.depth + 1)


def _unpacker(head: bytes, raw: bool) -> Callable[[], object] | None:
    """What unpacks a stream that starts so."""
    if raw:
        return lambda: zlib.decompressobj(-15)
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return lambda: zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00" or head[:3] == b"\x5d\0\0":
        return lambda: lzma.LZMADecompressor(memlimit=256 << 20)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return lambda: zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
    return None


def _stream(data: bytes, at: int, raw: bool = False) -> Iterator[bytes]:
    """Unpacked bytes of the stream that starts in data at a place, up to its end or first fault; nothing where none starts."""
    held, at = data[at : at + FEED], at + FEED
    while (new := _unpacker(held, raw)) is not None:
        unpack = new()
        bounded, done = not type(unpack).__module__.startswith("zstandard"), False
        try:
            while not done:
                out = unpack.decompress(held, PIECE) if bounded else unpack.decompress(held)
                if out:
                    yield out
                done = unpack.eof
                held = getattr(unpack, "unconsumed_tail", b"")
                if not out and not held and not done:
                    held, at = data[at : at + FEED], at + FEED
                    if not held:
                        return
            held = unpack.unused_data  # another member
        except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError, zstandard.ZstdError, MemoryError):
            return
        if raw:
            return
        if len(held) < 6:
            held, at = held + data[at : at + FEED], at + FEED


def _blocks(pieces: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The pieces as blocks of about `size` bytes that overlap by a sixteenth."""
    parts, n = [], 0
    for piece in pieces:
        parts.append(piece)
        n += len(piece)
        if n >= size:
            held = b"".join(parts)
            yield held
            parts, n = [held[-size // 16 :]], min(n, size // 16)
    if n:
        yield b"".join(parts)


class _Scan:
    """The worklist over one text."""

    def __init__(self, text: str, block: int):
        self.block = block
        self.base = base_spans(text)
        self.spans = set(self.base)
        self.seen: set[tuple] = set()
        first = _Layer(text, range(len(text)), range(1, len(text) + 1), (0, len(text)))
        work = [self.inside(first)]
        while work:  # one layer of each depth is held at a time
            new = next(work[-1], None)
            if new is None:
                work.pop()
            elif self.unseen(new.text.encode("utf-8", "surrogatepass"), new.whole):
                self.spans.update((kind, *new.at(i, j)) for kind, i, j in base_spans(new.text))
                work.append(self.inside(new))

    def unseen(self, data: bytes, whole: tuple[int, int], stream: bool = False) -> bool:
        key = (hashlib.blake2b(data, digest_size=16).digest(), whole, stream)
        if key in self.seen:
            return False
        self.seen.add(key)
        return True

    def inside(self, layer: _Layer) -> Iterator[_Layer]:
        text = layer.text
        if "%" in text or "\\" in text or "&" in text:
            if layer.depth < MOST_DEPTH:
                yield from chain(self.percent(layer), self.slashes(layer), self.references(layer))
            elif layer.depth == MOST_DEPTH:
                yield _reduced(layer)
        yield from self.base64(layer)

    def percent(self, layer: _Layer) -> Iterator[_Layer]:
        if "%" not in layer.text or not (parts := [_unpercented(m) for m in _PERCENT.finditer(layer.text)]):
            return
        new = _spliced(layer, parts)
        yield new
        if "+" in layer.text and (spaced := _spliced(layer, parts, plus=True)).text != new.text:
            yield spaced
        if all(p[2].isascii() for p in parts):
            return
        for w in _WORD.finditer(layer.text):  # bytes of words that hold escapes
            if "%" not in w[0]:
                continue
            data, places = bytearray(), []
            k = w.start()
            for m in _PERCENT.finditer(layer.text, w.start(), w.end()):
                raw = layer.text[k : m.start()]
                data += raw.encode("latin-1", "replace")
                places += range(k, m.start())
                if m[0][1] != "u":
                    data += bytes.fromhex(m[0].replace("%", ""))
                    places += range(m.start(), m.end(), 3)
                k = m.end()
            data += layer.text[k : w.end()].encode("latin-1", "replace")
            places += range(k, w.end())
            places.append(w.end())
            yield from self.of_bytes(bytes(data), lambda n, p=places: layer.at(p[n], p[n + 1]))

    def characters(self, layer: _Layer, parts: list[Part]) -> Iterator[_Layer]:
        """The layer with parts decoded, and its characters as bytes where they stand for such."""
        if not parts:
            return
        new = _spliced(layer, parts)
        yield new
        if any("\x7f" < p[2] < "\u0100" or p[2] == "\0" for p in parts):
            yield from self.of_bytes(new.text.encode("latin-1", "replace"), lambda n: new.at(n, n + 1), words=new.text)

    def slashes(self, layer: _Layer) -> Iterator[_Layer]:
        if "\\" in layer.text:
            for pattern in (_NUMBERED, _BACKSLASH):  # of two backslashes, the second or the first may be what escapes
                yield from self.characters(layer, [(m.start(), m.end(), _unslashed(m), [m.end() - m.start()]) for m in pattern.finditer(layer.text)])

    def references(self, layer: _Layer) -> Iterator[_Layer]:
        if "&" in layer.text:
            found = ((m, _referred(m)) for m in _REFERENCE.finditer(layer.text))
            yield from self.characters(layer, [(m.start(), m.end(), c[:1], [m.end() - m.start()]) for m, c in found if c])

    def base64(self, layer: _Layer) -> Iterator[_Layer]:
        for m in _BASE64.finditer(layer.text):
            yield from self.run64(layer, m[0], range(m.start(), m.end()))
        if "\n" in layer.text:
            for m in _WRAPPED.finditer(layer.text):
                lines = list(_LETTERS.finditer(m[0]))
                run = "".join(x[0] for x in lines)
                if len(run) >= 16:
                    yield from self.run64(layer, run, list(chain.from_iterable(range(m.start() + x.start(), m.start() + x.end()) for x in lines)))

    def run64(self, layer: _Layer, run: str, places: Sequence[int]) -> Iterator[_Layer]:
        run = run.replace("-", "+").replace("_", "/")
        for first in range(4):  # what stands before a region may be of its letters
            part = run[first : len(run) - ((len(run) - first) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))

            def span(k: int, first: int = first) -> tuple[int, int]:
                return layer.at(places[first + k * 4 // 3], places[first + (k * 8 + 7) // 6] + 1)

            yield from self.of_bytes(data, span, raw=True)

    def of_bytes(self, data: bytes, span: Callable[[int], tuple[int, int]] | None, whole: tuple[int, int] | None = None, raw: bool = False, words: str | None = None) -> Iterator[_Layer]:
        """Layers of decoded bytes: their printable stretches, and what streams that start in them unpack to. span: of a byte; without one, all have the span `whole`. words: the text that the bytes are of, whose words bound a stream."""
        for pattern, first, step in _PRINTED:
            if step == 2 and b"\0" not in data:
                break
            for m in pattern.finditer(data):
                text = m[0][first::step].decode()
                if not _HOLDS.search(text):
                    continue
                if span is None:
                    yield _Layer(text, None, None, whole)
                    continue
                spans = [span(k) for k in range(m.start() + first, m.end(), step)]
                yield _Layer(text, [s for s, _ in spans], [e for _, e in spans], (spans[0][0], spans[-1][1]))
        places = [(m.start(), False) for m in _MAGIC.finditer(data)]
        if raw and len(data) > 12 and not data.isascii():
            places.append((0, True))
        for at, bare in places:
            pieces = _stream(data, at, bare)
            if not (first := next(pieces, b"")):
                continue
            end = len(data)
            if words is not None and (gap := re.compile(r"\s").search(words, at + 1)):
                end = max(at + 1, gap.start())
            region = whole if span is None else (span(at)[0], span(end - 1)[1])
            for block in _blocks(chain((first,), pieces), self.block):
                if self.unseen(block, region, stream=True):
                    yield from self.of_bytes(block, None, region)


def scan_text(text: str | None, block: int = BLOCK) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, in code points of the text itself, each list by start, kind and end."""
    scan = _Scan(text or "", block)
    return scan.base, sorted(scan.spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str | None:
    """The text with every span (overlapping ones as one) replaced by the mask."""
    if text is None or not spans:
        return text
    out, at = [], 0
    start, end = spans[0][1], spans[0][2]
    for _, i, j in sorted(spans, key=lambda s: s[1])[1:] + [("", len(text) + 1, len(text) + 1)]:
        if i > end or (i == end and i > len(text)):
            out += [text[at:start], mask]
            at, start, end = end, i, j
        else:
            end = max(end, j)
    return "".join(out) + text[at:]


_SCAN = "base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>, base_sha256 string, spans_text string"


def secret_column(text: Column) -> Column:
    """A struct (base, spans, base_sha256, spans_text) for a text column."""

    @F.pandas_udf(_SCAN)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                base, spans = scan_text(t)
                rows.append(([{"kind": k, "start": i, "end": j} for k, i, j in base], [{"kind": k, "start": i, "end": j} for k, i, j in spans], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            yield pd.DataFrame(rows, columns=["base", "spans", "base_sha256", "spans_text"])

    return scan(text)


def scan_secrets(df: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """df with a struct column `into` of all secrets in each whole text. Other columns stay; one named `into` is replaced.

    One map over the rows, no shuffle. Null and empty texts give empty lists.
    """
    return df.withColumn(into, secret_column(F.col(text)))


def redact_secrets(df: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """df with every secret in `text`, nested ones too, replaced by the mask. Null stays null; columns and rows stay."""

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([redact(t, scan_text(t)[1], mask) for t in batch], dtype=object)

    return df.withColumn(text, clean(F.col(text)))
