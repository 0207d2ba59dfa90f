"""A quality classifier: a sparse ensemble of rules.

Statistics of whole texts are Spark column expressions. On a bounded sample of labelled rows, small trees are boosted;
every path from a root is a rule, a conjunction of comparisons of statistics with thresholds. A logistic model over
all rules, fitted under a lasso penalty, keeps few of them. These compile into one column expression, so that scoring
a corpus is a projection inside the scan, without Python, shuffle or join. The expression holds each statistic that a
rule asks for once, also where the optimizer moves it into a filter.

Defined results: a null text counts as empty; an empty text has zeros for statistics and a score like any other;
rows without label, or with a null one, are not learned from; if an id has several labels, the least counts; if the
labels are all alike or missing, the score is their smoothed share. Repeated rows score alike. Columns of the names
of statistics in the scored table are left alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import fresh

SAMPLE = 20_000  # labelled rows to learn from, at most
STATS = ("log_chars", "log_words", "word_length", "upper", "symbols", "bars", "digits", "stops", "repeats", "distinct", "line_length", "same_lines")


def words_and_lines(text: Column) -> tuple[Column, Column]:
    t = F.coalesce(text, F.lit(""))
    return F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), F.split(t, "\n")


def statistics(text: Column, w: Column, lines: Column) -> dict[str, Column]:
    """Statistics by name, of a text and its words_and_lines()."""
    t = F.coalesce(text, F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    less = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    chars, n = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(w), F.lit(1))
    again = F.size(F.filter(F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))
    solid = left(r"\s+")
    stats = {
        "log_chars": F.log1p(F.length(t)),
        "log_words": F.log1p(F.size(w)),
        "word_length": solid / n,
        "upper": left(r"[^\p{Lu}]+") / chars,
        "symbols": left(r"[\p{L}\p{N}\s]+") / chars,
        "bars": less("|") / n,
        "digits": less("0123456789") / chars,
        "stops": less(".!?") / n,
        "repeats": again / n,
        "distinct": F.size(F.array_distinct(w)) / n,
        "line_length": F.length(t) / F.greatest(F.size(lines), F.lit(1)),
        "same_lines": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }
    return {k: v.cast("double") for k, v in stats.items()}


def with_statistics(df: DataFrame, text: str, prefix: str = "s_") -> DataFrame:
    """df with a column for each statistic, its name under the prefix."""
    words, lines = fresh(df, "words", "lines")
    w, li = words_and_lines(F.col(text))
    stats = statistics(F.col(text), F.col(words), F.col(lines))
    return df.withColumns({words: w, lines: li}).withColumns({prefix + k: v for k, v in stats.items()}).drop(words, lines)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value in it once, however often use() names it.

    A filter over a projection gets a copy of the expression for every mention, and Spark computes all of them where it compiles the filter.
    """
    return F.transform(F.array(value), use)[0]


def held_out(id_col: Column) -> Column:
    """Whether a row is set aside: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


Rule = tuple[tuple[int, bool, float], ...]  # (number of the statistic, whether it must be above, threshold)


def _grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: Rule, out: set[Rule]) -> list[tuple[Rule, float]]:
    """Leaves (rule, mean residual) of a regression tree; every path from the root goes into out."""
    best = (1e-12, -1, 0.0)
    r = residual[rows]
    if depth and len(rows) >= 2 * least:
        base = r.sum() ** 2 / len(r)
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            place = np.searchsorted(c, x[rows, k], side="left")  # rows at place p are above the first p thresholds
            n = np.bincount(place, minlength=len(c) + 1)[::-1].cumsum()[::-1][1:]
            s = np.bincount(place, r, minlength=len(c) + 1)[::-1].cumsum()[::-1][1:]
            ok = (n >= least) & (len(r) - n >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(r) - n, 1) - base, 0)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), k, float(c[at]))
    if best[1] < 0:
        return [(path, float(r.mean()) if len(r) else 0.0)]
    _, k, cut = best
    above = x[rows, k] > cut
    leaves = []
    for side in (False, True):
        longer = (*path, (k, side, cut))
        out.add(longer)
        leaves += _grow(x, residual, rows[above == side], cuts, depth - 1, least, longer, out)
    return leaves


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 0) -> list[Rule]:
    """Rules of all paths of trees boosted for logistic loss, each on half of the rows."""
    rng = np.random.default_rng(seed)
    places = np.linspace(0.01, 0.99, 40)
    # Of all values, and of the distinct ones: what is rare in the sample has thresholds too.
    cuts = [np.unique(np.concatenate((np.quantile(v, places), np.quantile(np.unique(v), places)))) for v in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T, strict=True)]
    out: set[Rule] = set()
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = rng.permutation(len(y))[: max(2, len(y) // 2)]
        for rule, mean in _grow(x, y - p, rows, cuts, depth, max(2, len(y) // 2000), (), out):
            if rule:
                margin[holds(rule, x)] += rate * mean / max(1e-3, float((p * (1 - p)).mean()))
    merged = {}
    for rule in sorted(out):
        merged.setdefault(holds(rule, x).tobytes(), rule)  # of rules that hold for the same rows, one
    return [r for r in merged.values() if 0 < holds(r, x).mean() < 1]


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean logistic loss + penalty * sum |weight|, by accelerated proximal gradients."""
    n, m = z.shape
    step = 4.0 / max(1e-9, float(np.linalg.norm(np.hstack((z, np.ones((n, 1)))), 2) ** 2) / n)
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        new = vw - step * (z.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = vb - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; score() is a column, scores() the same over an array of statistics."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))

    def used(self) -> list[str]:
        """Names of the statistics that rules ask for."""
        return [STATS[k] for k in sorted({k for rule, _ in self.rules for k, _, _ in rule})]

    def score(self, stat: Callable[[str], Column] = lambda name: F.col("s_" + name)) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, above, cut in rule:
                s = stat(STATS[k])
                test = test & ((s > cut) if above else (s <= cut))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def to_json(self) -> str:
        return json.dumps({"rules": self.rules, "intercept": self.intercept})

    @staticmethod
    def from_json(text: str) -> RuleEnsemble:
        d = json.loads(text)
        return RuleEnsemble(tuple((tuple((k, a, c) for k, a, c in r), w) for r, w in d["rules"]), d["intercept"])


def fit_arrays(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, seed: int = 0) -> RuleEnsemble:
    """The ensemble for statistics x and labels y (0 or 1)."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble((), float(np.log(p / (1 - p))))
    rules = tree_rules(x, y, seed=seed)
    if not rules:
        return RuleEnsemble((), float(np.log(y.mean() / (1 - y.mean()))))
    z = np.column_stack([holds(r, x) for r in rules]).astype(np.float64)
    w, b = lasso_logistic(z, y, penalty)
    return RuleEnsemble(tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if v), float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, penalty: float = 1e-3) -> RuleEnsemble:
    """Learn from at most `sample` labelled rows that are not held out, chosen by a hash of the id.

    The ids of the sample go to all tasks (their number is the bound); only their statistics come to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__id")
    got = with_statistics(rows, "__t").select("__id", "__y", *("s_" + s for s in STATS)).orderBy(F.xxhash64("__id"), "__id", *("s_" + s for s in STATS)).limit(sample).toPandas()
    x = got[["s_" + s for s in STATS]].to_numpy(np.float64).reshape(-1, len(STATS))
    return fit_arrays(x, (got["__y"].to_numpy(np.float64) > 0).astype(np.float64), penalty)


def scored(df: DataFrame, model: RuleEnsemble, text: str = "text", into: str = "score") -> DataFrame:
    """df with the score of each whole text. Other columns stay; one named `into` is replaced."""
    [rated] = fresh(df, "rated")
    used = model.used()

    def rate(pieces: Column) -> Column:
        stats = statistics(pieces["text"], pieces["words"], pieces["lines"])
        return once(F.struct(*(stats[k].alias(k) for k in used)), lambda s: model.score(lambda k: s[k]))

    w, li = words_and_lines(F.col(text))
    score = once(F.struct(F.col(text).alias("text"), w.alias("words"), li.alias("lines")), rate) if used else model.score()
    return df.withColumn(rated, score).select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != into.lower()), F.col(rated).alias(into))
