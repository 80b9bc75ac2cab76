"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded labelled sample; every path from a root becomes a conjunctive rule; a
lasso logistic fit keeps few of them; the kept rules are compiled into one Spark column expression, so scoring is a
projection inside whole-stage code generation: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, fold_of, free_prefix, whole_text

#: Labelled rows used for fitting, at most.
FIT_ROWS = 20_000
_SYMBOLS = "!%$&#*|{}<>=_@^~\\/+"
STATS = (
    "n_words", "mean_word", "upper", "letters", "digits", "symbols", "pipes", "bangs", "distinct_words", "repeats",
    "words_per_line", "distinct_lines", "stops_per_word", "odd_ends", "long_words",
)


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "_") -> DataFrame:
    """Adds one struct column, prefix + `s`, of doubles; no column of df may begin with the prefix.

    Null text counts as empty; every ratio of an empty text is 0.
    """
    _t, _w, _l, _s = (prefix + c for c in "twls")
    out = df.withColumn(_t, whole_text(text)).withColumn(_w, F.filter(F.split(_t, r"[ \t-\r]+"), lambda x: x != ""))
    out = out.withColumn(_l, F.split(_t, "\n"))
    n, w = F.greatest(F.length(_t), F.lit(1)), F.greatest(F.size(_w), F.lit(1))
    gone = lambda chars: F.length(_t) - F.length(F.translate(_t, chars, ""))
    left = lambda pattern: F.length(F.regexp_replace(_t, pattern, ""))
    letters = left(r"[^\p{L}]+")
    values = [
        F.least(F.size(_w), F.lit(200)),
        (n - F.size(_w)) / w,
        left(r"[^\p{Lu}]+") / n,
        letters / n,
        left(r"[^0-9]+") / n,
        gone(_SYMBOLS) / n,
        gone("|") / w,
        gone("!") / w,
        F.size(F.array_distinct(_w)) / w,
        F.size(F.filter(_w, lambda x, i: (i > 0) & (x == F.get(_w, i - 1)))) / w,
        F.least(w / F.greatest(F.size(_l), F.lit(1)), F.lit(200)),
        F.size(F.array_distinct(_l)) / F.greatest(F.size(_l), F.lit(1)),
        gone(".") / w,
        F.size(F.filter(_w, lambda x: F.right(x, F.lit(1)).isin(*"!%$&#*|"))) / w,
        F.size(F.filter(_w, lambda x: F.length(x) > 25)) / w,
    ]
    struct = F.struct(*[v.cast("double").alias(k) for k, v in zip(STATS, values, strict=True)])
    return out.withColumn(_s, struct).drop(_t, _w, _l)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple, out: list) -> np.ndarray:
    """One regression tree on gradients; appends every non-root path to out and returns the leaf value by row."""
    total_g, total_h = g.sum(), h.sum()
    step = np.full(len(g), total_g / (total_h + 1.0))
    if depth == 0 or len(g) < 20:
        return step
    best, base = (1e-3, -1, 0.0), total_g**2 / (total_h + 1.0)
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        at = np.searchsorted(edges, x[:, j], side="left")
        left_g = np.bincount(at, g, len(edges) + 1).cumsum()[:-1]
        left_h = np.bincount(at, h, len(edges) + 1).cumsum()[:-1]
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - base
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(edges[k]))
    if best[1] < 0:
        return step
    low = x[:, best[1]] <= best[2]
    for side, mark in ((low, "<="), (~low, ">")):
        rule = (*path, (best[1], mark, best[2]))
        out.append(rule)
        step[side] = _grow(x[side], g[side], h[side], cuts, depth - 1, rule, out)
    return step


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for j, mark, cut in rule:
        on &= x[:, j] <= cut if mark == "<=" else x[:, j] > cut
    return on


@dataclass
class RuleEnsemble:
    bias: float = 0.0
    rules: list[tuple[tuple, float]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, lasso: float = 2e-3, keep: int = 48) -> RuleEnsemble:
        """x: rows by STATS.  With no rows, or one class only, the score is the smoothed share of ones."""
        share = (y.sum() + 1) / (len(y) + 2)
        bias = float(np.log(share / (1 - share)))
        if len(y) < 10 or y.min() == y.max():
            return cls(bias)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 32))) for j in range(x.shape[1])]
        f, found, rng = np.full(len(y), bias), [], np.random.default_rng(7)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            rows = rng.random(len(y)) < 0.7
            new: list = []
            _grow(x[rows], (y - p)[rows], (p * (1 - p))[rows], cuts, depth, (), new)
            found += new
            leaves = [r for r in new if not any(r == s[: len(r)] and len(s) > len(r) for s in new)]
            for r in leaves:
                on = _holds(r, x)
                f[on] += 0.5 * (y - p)[on].sum() / ((p * (1 - p))[on].sum() + 1.0)
        found = list(dict.fromkeys(found))
        m = np.stack([_holds(r, x) for r in found], 1).astype(float) if found else np.zeros((len(y), 0))
        varied = (m.mean(0) > 0.002) & (m.mean(0) < 0.998)
        found, m = [r for r, v in zip(found, varied, strict=True) if v], m[:, varied]
        m, first = np.unique(m, axis=1, return_index=True)
        found = [found[i] for i in first]
        w, b = cls._lasso(m, y, bias, lasso)
        order = np.argsort(-np.abs(w))[:keep]
        order = order[np.abs(w[order]) > 1e-4]
        w, b = cls._lasso(m[:, order], y, b, lasso / 4)  # refit of the kept rules with less shrinkage
        return cls(float(b), [(found[i], float(v)) for i, v in zip(order, w, strict=True) if v])

    @staticmethod
    def _lasso(m: np.ndarray, y: np.ndarray, bias: float, lasso: float, rounds: int = 1500) -> tuple[np.ndarray, float]:
        """Accelerated proximal gradient on the logistic loss, with an unpenalised intercept."""
        a = np.hstack([m, np.ones((len(y), 1))])
        rate = 4.0 * len(y) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
        w = np.zeros(a.shape[1])
        w[-1], z, t = bias, np.zeros(a.shape[1]), 1.0
        z[-1] = bias
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
            new = z - rate * (a.T @ (p - y)) / len(y)
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * lasso, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, w, t = new + (t - 1) / t2 * (new - w), new, t2
        return w[:-1], float(w[-1])

    def column(self, stats: str = "_s") -> Column:
        """The score as one column expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            on = F.lit(True)
            for j, mark, cut in rule:
                value = F.col(f"{stats}.{STATS[j]}")
                on = on & (value <= cut if mark == "<=" else value > cut)
            total = total + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> RuleEnsemble:
    """Learns from labelled rows of the training folds (crc32(doc_id) mod 3 is not 1); `rows` bounds them."""
    sample = bounded_labels(labels, "quality", fold_of(3) != 1, rows)
    docs = with_statistics(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    got = docs.select(F.col("y"), *[F.col(f"_s.{k}") for k in STATS]).toPandas()
    return RuleEnsemble.fit(got[list(STATS)].to_numpy(float), got["y"].to_numpy(float))


def score(documents: DataFrame, model: RuleEnsemble) -> DataFrame:
    """Adds `score` (0 to 1) to every row; other columns stay, an old `score` is replaced."""
    prefix = free_prefix(documents.columns)
    return with_statistics(documents, prefix=prefix).withColumn("score", model.column(prefix + "s")).drop(prefix + "s")


def keep_good(documents: DataFrame, model: RuleEnsemble, least: float = 0.5) -> DataFrame:
    """documents that score at least `least`, with the columns that they have.

    A row number in the condition keeps the optimizer from moving it below the statistics, where it would compute
    each of them once per rule.
    """
    prefix = free_prefix(documents.columns)
    scored = with_statistics(documents, prefix=prefix).withColumn(prefix + "score", model.column(prefix + "s")).withColumn(prefix + "row", F.monotonically_increasing_id())
    return scored.filter((F.col(prefix + "score") >= least) & (F.col(prefix + "row") >= 0)).select(*documents.columns)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, held_out, score, predicted.

    Null and empty texts get the score of the empty text; repeated rows are scored alike; an empty table gives an
    empty result; without labels the score is 0.5.
    """
    out = score(documents.select("doc_id", "text"), fit(documents, labels))
    return out.select("doc_id", (fold_of(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
