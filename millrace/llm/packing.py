"""Best-fit packing of token sequences by a configuration linear program.

Every document becomes pieces of at most `capacity` tokens. The histogram of piece lengths, which has at most
`capacity` entries whatever the corpus, is all that the driver sees. Over it, the configuration program (how many
sequences of each make-up cover all pieces with the fewest sequences) is solved by multiplicative weights:

1. Prices. Every round finds the most valuable configurations under the lengths' prices by bounded knapsack dynamic
   programming, one for each length that a configuration of nearly the greatest value can have, and lowers each price by
   a factor for how much its length is covered. The prices over the greatest value are a dual solution, whose worth
   bounds the number of sequences from below; they start as the lengths, the dual of the bound by volume.
2. Uses. How often the configurations found are used is then scaled by factors, each the mean of what the lengths
   of the configuration lack, until all lengths are covered.

Uses are rounded down, and after that up by the largest until half of the bound is placed; what remains is a histogram like the
first and is solved again, until the program places next to nothing. The rest is packed best-fit, longest first. Of
the numbers of solutions after which the rest could have been packed so, the one with the fewest sequences counts
(none, that is best-fit alone, and parts of the first solution included). The plan is ranges of ranks by length; pieces find their place by their
rank among pieces of their length, a sum of counts by task, so no group of pieces is ever brought together.

Defined results: a null text counts as empty; an empty document is its end token alone; a document longer than the
capacity is cut so that its first piece is the shorter one; repeated rows are packed each. Ranks among pieces of
one length follow the tasks that wrote them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.token_fst import Splitter, bytes_of_chars
from millrace.session import written

Config = tuple[tuple[int, int], ...]  # (length, times) from the longest on
SLACK = 0.005  # share of the greatest value that a configuration taken into the program may lack
TIGHT = 0.0005  # and one that is used
SHARES = (0.25, 0.5, 0.75, 1.0)  # of a first solution's uses
MOST_PIECES, LONG_PIECE = 300_000, 64  # of text, kept with their ids
STREAM = 1_000_000  # characters split at once, about


class Knapsack:
    """Bounded knapsack under prices: `value` by capacity, and the configurations behind it."""

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int):
        self.size = len(lengths)
        self.value = np.zeros(capacity + 1)
        self.items = []  # (index of length, times, length of all): times 1, 2, 4, ... up to the most
        for i, (n, m) in enumerate(zip(lengths.tolist(), most.tolist(), strict=True)):
            m, k = min(m, capacity // n), 1
            while m > 0:
                self.items.append((i, min(k, m), n * min(k, m)))
                m, k = m - min(k, m), 2 * k
        self.taken = np.zeros((len(self.items), capacity + 1), bool)
        for r, (i, times, n) in enumerate(self.items):
            other = self.value[:-n] + prices[i] * times
            self.taken[r, n:] = better = other > self.value[n:] + 1e-15
            self.value[n:] = np.where(better, other, self.value[n:])

    def best(self, capacities: np.ndarray) -> np.ndarray:
        """Rows of times by length: the configuration of greatest value for each capacity."""
        left, out = capacities.copy(), np.zeros((len(capacities), self.size), np.int64)
        for r in range(len(self.items) - 1, -1, -1):
            i, times, n = self.items[r]
            hit = self.taken[r][left]
            if hit.any():
                out[hit, i] += times
                left[hit] -= n
        return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 40, epsilon: float = 0.3, scalings: int = 300, power: float = 1.7) -> tuple[np.ndarray, np.ndarray, float]:
    """(configurations as rows of times by length, how often each is used to cover the counts, lower bound of the number of sequences)."""
    weights = lengths * counts / capacity
    used: dict[bytes, float] = defaultdict(float)
    covered = np.zeros(len(lengths))
    bound, dual = 0.0, lengths / capacity
    for _ in range(rounds):
        prices = weights / counts
        sack = Knapsack(prices, lengths, counts, capacity)
        most = sack.value[capacity]
        if (worth := float(weights.sum() / most)) > bound:
            bound, dual = worth, prices / most
        own = np.flatnonzero(prices + sack.value[capacity - lengths] >= (1 - SLACK) * most)
        found = sack.best(capacity - lengths[own])
        found[np.arange(len(own)), own] += 1
        held = (found <= counts).all(axis=1)
        found, own = found[held], own[held]
        if not len(own):
            break
        uses = counts[own] / found[np.arange(len(own)), own]
        share = (uses @ found) / counts
        for row, x in zip(found.astype(np.int16), uses / share.max(), strict=True):
            used[row.tobytes()] += x
        covered += share / share.max()
        weights = weights * np.exp(-epsilon * share / share.max())
        weights /= weights.max()
    configs = np.frombuffer(b"".join(used), np.int16).reshape(-1, len(lengths))
    x = np.array(list(used.values())) / max(covered.mean(), 1e-12)
    row, col = np.nonzero(configs)
    tight = np.bincount(row, configs[row, col] * dual[col], len(configs)) >= 1 - TIGHT
    configs = configs[tight]
    return configs, scaled(configs, x[tight], counts, scalings, power), bound


def scaled(configs: np.ndarray, x: np.ndarray, counts: np.ndarray, rounds: int, power: float) -> np.ndarray:
    """x times factors: in each round, the mean over a configuration's pieces of counts against what is covered, to a power."""
    if not len(x):
        return x
    row, col = np.nonzero(configs)
    times = configs[row, col].astype(np.float64)
    first, pieces = np.searchsorted(row, np.arange(len(x))), np.bincount(row, times)
    for _ in range(rounds):
        lack = counts / np.maximum(np.bincount(col, times * x[row], len(counts)), 1e-12)
        x = x * (np.add.reduceat(times * lack[col], first) / pieces) ** power
    return x


def filled(left: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """One configuration from what is left: the longest piece, and the best fit for the rest of the space.

    The sums that the other pieces can make are bits of a number, added length by length; of the fits that leave the
    least space, the one with the longest pieces is read back.
    """
    have = np.flatnonzero(left)
    longest = int(have[-1])
    out = {longest: 1}
    space = capacity - int(lengths[longest])
    mask, reach, steps = (1 << space + 1) - 1, 1, []
    for i in have.tolist():
        n = int(lengths[i])
        if n > space:
            break
        times = min(int(left[i]) - (i == longest), space // n)
        steps.append((i, n, times, reach))
        more = 1
        while times > 0:  # 1, 2, 4, ... and the remainder: all multiples up to times
            k = min(more, times)
            reach |= reach << k * n & mask
            times -= k
            more *= 2
    rest = reach.bit_length() - 1
    for i, n, times, before in reversed(steps):
        k = next(k for k in range(min(times, rest // n), -1, -1) if before >> rest - k * n & 1)
        if k:
            out[i] = out.get(i, 0) + k
            rest -= k * n
    return out


def best_fit(left: np.ndarray, lengths: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations, by index of length, that hold all that is left, longest first."""
    out, left = [], left.copy()
    while left.any():
        config = filled(left, lengths, capacity)
        copies = min(int(left[i]) // n for i, n in config.items())
        for i, n in config.items():
            left[i] -= n * copies
        out.append((config, copies))
    return out


def rounded(configs: np.ndarray, x: np.ndarray, left: np.ndarray, goal: float) -> list[tuple[dict[int, int], int]]:
    """Uses of configurations rounded down, then one more of each, the largest first, until the goal is placed; taken from left."""
    out, placed = [], 0
    order = np.argsort(-x, kind="stable")
    for whole in (True, False):
        for k in order.tolist():
            if x[k] < 1 if whole else placed >= goal:
                break
            at = np.flatnonzero(configs[k])
            times = configs[k][at].astype(np.int64)
            copies = min(int(x[k]) if whole else 1, int((left[at] // times).min()))
            if copies > 0:
                left[at] -= times * copies
                placed += copies
                out.append((dict(zip(at.tolist(), times.tolist(), strict=True)), copies))
    return out


def plan(histogram: dict[int, int], capacity: int, rounds: int = 40) -> list[tuple[Config, int]]:
    """(configuration, copies) that hold exactly the pieces of the histogram."""
    return planned(histogram, capacity, rounds)[0]


def planned(histogram: dict[int, int], capacity: int, rounds: int = 40) -> tuple[list[tuple[Config, int]], int]:
    """plan(), and how many of its sequences the program supplies."""
    out: list[tuple[Config, int]] = []
    if full := histogram.get(capacity, 0):
        out.append((((capacity, 1),), full))
    items = sorted((k, n) for k, n in histogram.items() if k < capacity and n > 0)
    if not items:
        return out, 0
    lengths = np.array([k for k, _ in items])
    left = np.array([n for _, n in items], dtype=np.int64)
    number = lambda configs: sum(copies for _, copies in configs)
    placed: list[tuple[dict[int, int], int]] = []
    best = (placed, best_fit(left, lengths, capacity))
    while left.any():
        have = np.flatnonzero(left)
        configs, x, bound = fractional(lengths[have], left[have], capacity, rounds if not placed else rounds // 2)
        before, whole = left, placed
        for share in SHARES if not placed else (1.0,):  # less than all leaves short pieces for those that fit no full configuration
            part = before[have]
            got = rounded(configs, share * x, part, share * bound / 2)
            rest_left = np.zeros_like(before)
            rest_left[have] = part
            some = whole + [({int(have[i]): n for i, n in c.items()}, copies) for c, copies in got]
            rest = best_fit(rest_left, lengths, capacity)
            if number(some) + number(rest) < number(best[0]) + number(best[1]) or share == 1.0 and number(some) + number(rest) == number(best[0]) + number(best[1]):
                best = (some, rest)
            left, placed = rest_left, some
        if number(got) < max(1, 0.02 * bound):
            break
    for config, copies in (*best[0], *best[1]):
        out.append((tuple((int(lengths[i]), n) for i, n in sorted(config.items(), reverse=True)), copies))
    return out, number(best[0])


class Places:
    """The plan as ranges of ranks by length; finds sequence and offset of a piece."""

    def __init__(self, planned: list[tuple[Config, int]]):
        rows, taken, first = [], defaultdict(int), 0
        for config, copies in planned:
            offset = 0
            for length, times in config:
                rows.append((length << 44 | taken[length], taken[length], times, first, offset, length))
                taken[length] += copies * times
                offset += length * times
            first += copies
        self.sequences = first
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
        self.keys, self.start, self.times, self.first, self.offset, self.length = table.T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, (length << 44) | rank, side="right") - 1
        q = rank - self.start[k]
        return self.first[k] + q // self.times[k], self.offset[k] + (q % self.times[k]) * self.length[k]


class Ids(dict):
    """Token ids as the tokenizers library gives them for the file at `path`: those of pieces of text, asked once and kept, put together.

    A piece is what the tokenizer's own pattern splits off; its ids, by the library's model over the letters that stand for its bytes, depend on nothing around it. Texts that hold special strings
    go through the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.splitter = Splitter(path)
        self.library = self.splitter.library
        self.tokenize, self.old, self.met = self.library.model.tokenize, {}, bytearray(1 << 22)
        self.letters = {b: c for c, b in bytes_of_chars().items()}
        self.space = self.letters[32]
        self.numbers = [k.to_bytes(4, "little") for k in range(self.library.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        if (out := self.old.get(piece)) is None:
            word = piece.removeprefix(" ")
            if word.isascii() and word.isalnum():  # bytes that stand for themselves
                letters = self.space + word if len(word) < len(piece) else piece
            else:
                letters = piece.encode().decode("latin-1").translate(self.letters)
            out = b"".join([self.numbers[t.id] for t in self.tokenize(letters)])
        at = hash(piece) & len(self.met) - 1
        if len(piece) <= LONG_PIECE and self.met[at]:  # kept from the second time on
            if len(self) >= MOST_PIECES:  # those not met since the last time are forgotten
                self.old = dict(self)
                self.clear()
                self.met = bytearray(len(self.met))
            self[piece] = out
        self.met[at] = 1
        return out

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        done, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= STREAM or k == len(texts) - 1:
                yield from self._of_stream(texts[done : k + 1])
                done, size = k + 1, 0

    def _of_stream(self, texts: list[str]) -> Iterator[np.ndarray]:
        special = [any(s in t for s in self.splitter.special) for t in texts]
        stream, starts, marks = self.splitter.cut(["" if x else t for t, x in zip(texts, special, strict=True)])
        bounds, first, get = [*starts.tolist(), len(stream)], 0, self.__getitem__
        pieces = [stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for t, x, mark in zip(texts, special, marks.tolist(), strict=True):
            if x:
                yield np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4")
            else:
                yield np.frombuffer(b"".join(map(get, pieces[first:mark])), "<u4")
            first = mark + 1


_loaded: dict[str, Ids] = {}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; only the first may be shorter than the capacity."""
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, (head if s == 0 and head else capacity)) for s in starts]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, task, place[, ids]): all pieces of all documents; place is the rank in the task among pieces of the length."""
    id_type = df.schema[id_col].dataType
    fields = [T.StructField("id", id_type), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("place", T.LongType())))]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Ids(tokenizer)
        of, task, seen = _loaded[tokenizer].of, TaskContext.get().partitionId(), defaultdict(int)
        for x in batches:
            at, out = [], {n: [] for n in ("piece", "start", "length", "ids_crc32", "place", "ids")}
            for row, ids in enumerate(of([t or "" for t in x.column(1).to_pylist()])):
                ids = np.append(ids, np.array([end_id], "<u4"))
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    at.append(row)
                    for n, v in zip(out, (k, start, length, zlib.crc32(part.tobytes()), seen[length], part.astype(np.int32) if keep_ids else None), strict=True):
                        out[n].append(v)
                    seen[length] += 1
            columns = [x.column(0).take(pa.array(at, pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32")), pa.array([task] * len(at), pa.int32()), pa.array(out["place"], pa.int64())]
            if keep_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(F.col(id_col).alias("id"), F.col(text)).mapInArrow(run, T.StructType(fields))


def pack(cut_up: DataFrame, capacity: int = 1024, rounds: int = 40) -> DataFrame:
    """Rows of pieces() (as read from a written table), each with sequence_id and offset.

    Two reads of the table and one join with the counts by task and length, of which there are at most tasks x capacity.
    """
    counts = written(cut_up.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(histogram, capacity, rounds))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, o = places.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": s, "offset": o})

    ranked = cut_up.join(counts.hint("shuffle_hash"), ["length", "task"]).withColumn("at", placed("length", F.col("place") + F.col("before")))
    return ranked.select(*cut_up.columns, "at.sequence_id", "at.offset")


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """All documents of df packed: rows (id column, piece, start, length, ids_crc32, sequence_id, offset[, ids]). Other columns of df are not carried."""
    cut_up = written(pieces(df, tokenizer, id_col, text, capacity, end_id, keep_ids=keep_ids), "pieces")
    packed = pack(cut_up, capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length): the token ids of each sequence, from pack_documents(keep_ids=True). A sequence has at most `capacity` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.sum("length").alias("length"))
