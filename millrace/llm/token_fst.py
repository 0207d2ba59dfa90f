"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is compiled into two deterministic transducers whose transitions say how many tokens
they add, so that no token is ever built.

1. The splitter reads code points by class (letters, digits, white space, apostrophe, the letters of contractions,
   others) and marks where the tokenizer's pattern starts a piece. It has 12 states. A run over a long stream is
   cut into chunks; each chunk becomes a map from every entry state to its exit state, and the maps compose by a
   parallel prefix scan, which gives each chunk's true entry state; nothing of a text is read in sequence. Look-ahead
   of the pattern is a delayed mark, set one code point late.
2. The counter reads the bytes of a piece. Its state holds, for each start of a token that may still grow, the
   last token before that start and the number of tokens so far against now; that is all that later bytes can
   depend on. A transition's weight is the change in the number of tokens, so a piece's count is the sum along its
   path. A piece always starts in one state, so that the chunks which the splitter finds, the pieces, have their entry states at
   once and are read side by side, a byte of each at a time, by look-ups in arrays. States and transitions are compiled when
   first met, hash-consed, and dropped beyond a bound of memory.

Classes of code points are asked of the tokenizer itself, so they follow its Unicode tables.

Defined results: null and empty texts have 0 tokens; special strings inside texts are one token each, as the
library has it by default; lone surrogates cannot occur in Spark strings. Repeated rows are counted alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of code points.
SPACE, WHITE, LETTER, DIGIT, OTHER, APOS, STMD, R, V, L, E, END = range(12)
# States: after reading a code point, what piece is open. Q_* are contractions not yet decided.
START, LET, NUM, OTH, Q, Q_R, Q_V, Q_L, SP1, WS1, WSS, WSW = range(12)
N_STATES, N_CLASSES = 12, 12
LETTERS = (LETTER, STMD, R, V, L, E)
CHUNK = 512
HEAD = 24
MAX_STATES = 400_000  # beyond, states and transitions are dropped before the next GROUP
GROUP = 1 << 18  # bytes of pieces read side by side, about; each adds a transition and a state at most
SLOTS = 22  # bits of the table of transitions
WIDE = 256  # bytes of a piece beyond which it is read by itself


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by class and state. Marks: 1 a piece starts at this code point, 2 one started at the one before."""
    nxt = np.zeros((N_CLASSES, N_STATES), np.uint8)
    marks = np.zeros((N_CLASSES, N_STATES), np.uint8)

    def opened(c: int) -> int:
        if c in LETTERS:
            return LET
        return {DIGIT: NUM, OTHER: OTH, APOS: Q, SPACE: SP1, WHITE: WS1, END: START}[c]

    def joined(c: int) -> int:
        return {DIGIT: NUM, OTHER: OTH, APOS: OTH}.get(c, LET)

    for c in range(N_CLASSES):
        white, word = c in (SPACE, WHITE), c in LETTERS
        for s in range(N_STATES):
            to, m = opened(c), 1
            if s == LET and word or s == NUM and c == DIGIT or s == OTH and c in (OTHER, APOS):
                to, m = s, 0
            elif s == Q:
                if c in (OTHER, APOS):
                    to, m = OTH, 0
                elif c == STMD:
                    to, m = START, 0
                elif c in (R, V, L):
                    to, m = {R: Q_R, V: Q_V, L: Q_L}[c], 0
            elif s in (Q_R, Q_V, Q_L):
                if c == {Q_R: E, Q_V: E, Q_L: L}[s]:
                    to, m = START, 0
                else:  # the letter had begun a piece of its own
                    to, m = (LET, 2) if word else (opened(c), 3)
            elif s == SP1 and c != END and not white:
                to, m = joined(c), 0
            elif s in (SP1, WS1, WSS, WSW) and white:
                to, m = (WSS if c == SPACE else WSW), 0
            elif s == WSS and c != END:
                to, m = joined(c), 2
            elif s == WSW and c != END:
                to, m = opened(c), 3
            nxt[c, s], marks[c, s] = to, m
    return nxt.ravel(), marks.ravel()


NEXT, MARKS = _splitter()


def scanned(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), in log2(rows) parallel steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Ascending positions at which a piece starts in a stream of classes; END is a piece of its own."""
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[:n] = classes
    cols = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.uint16) * N_STATES
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (rows, N_STATES)).copy()
    states = np.empty((CHUNK, rows), np.uint8)  # before each code point
    for j in range(HEAD):
        maps = NEXT[cols[j][:, None] + maps]
    one = (maps == maps[:, :1]).all(axis=1)  # from here on the entry state does not matter
    slow = np.flatnonzero(~one)
    state, wide = maps[:, 0].copy(), maps[slow]
    for j in range(HEAD, CHUNK):
        states[j] = state
        state = NEXT[cols[j] + state]
        if len(slow):
            wide = NEXT[cols[j][slow][:, None] + wide]
    maps = np.repeat(state[:, None], N_STATES, axis=1)
    maps[slow] = wide
    entry = np.zeros(rows, np.uint8)
    entry[1:] = scanned(maps)[:-1, START]
    state = entry
    for j in range(HEAD):
        states[j] = state
        state = NEXT[cols[j] + state]
    if len(slow):
        state = state[slow]
        for j in range(HEAD, CHUNK):
            states[j, slow] = state
            state = NEXT[cols[j][slow] + state]
    marks = MARKS[cols + states].T.ravel()
    starts = marks[:n] & 1
    starts[:-1] |= marks[1:n] >> 1
    return np.flatnonzero(starts)


class Counter:
    """The lazily compiled transducer from a piece's bytes to its number of tokens."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[bytes, int]):
        self.vocab, self.ranks = vocab, ranks
        self.prefixes = {t[:k] for t in vocab for k in range(1, len(t))}
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.slots = np.full(1 << SLOTS, -1, np.int64)  # state * 256 + byte, by open addressing
        self.next = np.zeros(1 << SLOTS, np.int32)
        self.change = np.zeros(1 << SLOTS, np.int16)
        self.start = self.state((b"", ((0, None, 0),)))

    def state(self, key: tuple) -> int:
        if (k := self.ids.get(key)) is None:
            k = self.ids[key] = len(self.keys)
            self.keys.append(key)
        return k

    def merged(self, data: bytes) -> list[bytes]:
        """Byte-pair encoding of a few bytes, by definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: bytes | None, token: bytes) -> bool:
        """Whether the encoding of last + token is just these two."""
        if (ok := self.pairs.get((last, token))) is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            ok = self.pairs[last, token] = self.merged((last or b"") + token) == ([token] if last is None else [last, token])
        return ok

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change in tokens). A state: the bytes since the oldest open start, and the open starts as (bytes since, last token before, tokens before against now)."""
        tail, opened = self.keys[state]
        tail += bytes((byte,))
        for since, last, before in opened:  # longest first
            token = tail[len(tail) - since - 1 :]
            if token in self.vocab and self.follows(last, token):
                break
        else:
            raise ValueError(f"no token for byte {byte}")
        change = before + 1
        kept = [(since + 1, x, n - change) for since, x, n in opened if tail[len(tail) - since - 1 :] in self.prefixes]
        kept.append((0, token, 0))
        return self.state((tail[len(tail) - kept[0][0] :], tuple(kept))), change

    def moved(self, states: np.ndarray, octets: np.ndarray) -> np.ndarray:
        """Slots of the transitions from the states by the bytes, compiled where they are new."""
        key = states.astype(np.int64) << 8 | octets
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        held = self.slots[at]
        todo = np.flatnonzero(held != key)
        while len(todo):
            k, a = key[todo], at[todo]
            new = self.slots[a] < 0
            if new.any():
                for one, slot in zip(*(x.tolist() for x in _distinct(k[new], a[new])), strict=True):
                    while self.slots[slot] >= 0:
                        slot = slot + 1 & (1 << SLOTS) - 1
                    self.slots[slot] = one
                    self.next[slot], self.change[slot] = self.compiled(one >> 8, one & 255)
            wrong = self.slots[a] != k
            at[todo[wrong]] = a[wrong] + 1 & (1 << SLOTS) - 1
            todo = todo[wrong]
        return at

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece of data (bytes), pieces side by side."""
        out = np.zeros(len(starts), np.int64)
        sizes = ends - starts
        for k in np.flatnonzero(sizes > WIDE).tolist():
            out[k] = self.alone(data, int(starts[k]), int(ends[k]))
        order = np.flatnonzero(sizes <= WIDE)
        cuts = np.searchsorted(np.cumsum(sizes[order]), np.arange(GROUP, sizes[order].sum() + GROUP, GROUP), side="right").tolist()
        for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
            if a >= b:
                continue
            if len(self.keys) >= MAX_STATES:
                self.clear()
            mine = order[a:b]
            mine = mine[np.argsort(-sizes[mine], kind="stable")]
            size, at, states, counts = sizes[mine], starts[mine], np.full(len(mine), self.start, np.int64), np.zeros(len(mine), np.int64)
            alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # pieces of more than 0, 1, 2, ... bytes
            for j, n in enumerate(alive.tolist()):
                slots = self.moved(states[:n], data[at[:n] + j])
                states[:n] = self.next[slots]
                counts[:n] += self.change[slots]
            out[mine] = counts
        return out

    def alone(self, data: np.ndarray, start: int, end: int) -> int:
        """Tokens of one long piece."""
        total, state = 0, self.start
        moves: dict[int, tuple[int, int]] = {}
        for byte in data[start:end].tolist():
            if len(self.keys) >= 2 * MAX_STATES:
                key = self.keys[state]
                self.clear()
                moves.clear()
                state = self.state(key)
            if (move := moves.get(state << 8 | byte)) is None:
                move = moves[state << 8 | byte] = self.compiled(state, byte)
            state = move[0]
            total += move[1]
        return total


def _distinct(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, first = np.unique(keys, return_index=True)
    return keys, slots[first]


def bytes_of_chars() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable bytes as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


def class_of(pre_tokenizer: object, c: str) -> int:
    """0 letter, 1 digit, 2 other, 3 white space: the class of a code point, by how the tokenizer splits around it."""
    return next((k for k, x in enumerate("a1!") if len(pre_tokenizer.pre_tokenize_str(x + c + x)) == 1), 3)


class Splitter:
    """Cuts texts into the pieces of a byte-level tokenizer's file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.spec = spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words are not compiled")
        self.library = Tokenizer.from_file(path)
        self.classes = np.full(0x110000, 255, np.uint8)
        for c, k in ((" ", SPACE), ("'", APOS), *((x, STMD) for x in "stmd"), ("r", R), ("v", V), ("l", L), ("e", E)):
            self.classes[ord(c)] = k

    def classified(self, text: str) -> np.ndarray:
        """Classes of the code points, as the tokenizer has them."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.classes[points]
        if (out == 255).any():
            for p in np.unique(points[out == 255]):
                self.classes[p] = (LETTER, DIGIT, OTHER, WHITE)[class_of(self.library.pre_tokenizer, chr(p))]
            out = self.classes[points]
        return out

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """(texts as one stream, an end mark after each; starts of the pieces, of which each mark is one; the marks' places among the pieces). Texts hold no special strings."""
        stream = "\x00".join(texts) + "\x00"
        classes = self.classified(stream)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        classes[ends] = END
        starts = piece_starts(classes)
        return stream, starts, np.searchsorted(starts, ends)


class TokenCounter:
    """Counts for whole texts; compiled from a tokenizer file."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        back = bytes_of_chars()
        raw = lambda s: bytes(back[c] for c in s)
        model = self.splitter.spec["model"]
        vocab = {raw(t): k for t, k in model["vocab"].items() if all(c in back for c in t)}
        ranks: dict[bytes, int] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks.setdefault(raw(a) + raw(b), k)
        self.special = self.splitter.special
        self.counter = Counter(vocab, ranks)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            pending = [t]
            for s in self.special:
                if s in t:
                    cut = []
                    for p in pending:
                        pieces = p.split(s)
                        out[i] += len(pieces) - 1
                        cut += pieces
                    pending = cut
            for p in pending:
                if p:
                    parts.append(p)
                    owner.append(i)
        if not parts:
            return out
        stream, starts, marks = self.splitter.cut(parts)
        data = np.frombuffer(stream.encode("utf-8", "surrogatepass"), np.uint8)
        offsets = np.flatnonzero((data & 0xC0) != 0x80)  # of the code points
        begin = offsets[starts]
        values, own = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
        own[marks] = False
        values[own] = self.counter.count(data, begin[own], np.append(begin[1:], len(data))[own])
        sums = np.add.reduceat(values, np.concatenate(([0], marks[:-1] + 1)))
        np.add.at(out, np.array(owner), sums)
        return out


_loaded: dict[str, TokenCounter] = {}


def loaded(path: str) -> TokenCounter:
    """The compiled tokenizer of this worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = TokenCounter(path)
    return _loaded[path]


def token_count(text: Column, path: str, stream_chars: int = 1_000_000) -> Column:
    """Number of tokens of a text column under the tokenizer file at `path`, which each worker must have."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = loaded(path)
        for batch in batches:
            texts, done, out, size = batch.tolist(), 0, [], 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= stream_chars or i == len(texts) - 1:
                    out.append(counter.counts(texts[done : i + 1]))
                    done, size = i + 1, 0
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))

    return count(text)


def count_tokens(df: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text. One map over the rows, no shuffle; a column named `into` is replaced."""
    return df.withColumn(into, token_count(F.col(text), path))
