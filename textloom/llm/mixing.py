"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A naive Bayes classifier over a few indicative words, counted on a bounded sample of labelled documents, gives every
document its domain posteriors as column expressions.  Nonnegative rates (expected copies) are then fitted by
projected gradient on a weighted least-squares objective: the rates start at 1, every round is one aggregation of
expected domain tokens, and a document's rate is the fold of the rounds' residuals over its own posteriors.  No row
of documents is shuffled.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_text

#: Labelled rows used for fitting, at most.
FIT_ROWS = 4_000
WORDS = 24  # indicative words, at most: they decide how sharp posteriors are, not which domains there are
UNROLLED = 16  # domains up to which every posterior is an expression of its own; more are folded over an array
ROUNDS = 20
TOLERANCE = 1e-4
MOST_EVIDENCE = 20.0  # words whose evidence counts, on average: keeps posteriors soft


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def token_count(text: str = "text") -> Column:
    return F.size(_split(whole_text(text))).cast("double")


@dataclass
class DomainModel:
    domains: list[str]
    priors: list[float]
    words: list[str] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)  # by word, then domain: log P(word | domain)
    other: list[float] = field(default_factory=list)  # log P(any other word | domain)

    def posteriors(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds `_n` (words) and `_p` (array of posteriors, in the order of domains); df has no columns of one underscore."""
        padded = F.concat(F.lit(" "), F.lower(whole_text(text)), F.lit(" "))
        out = df.withColumn("_n", token_count(text)).withColumn("_x", F.translate(padded, "\n\t\r.,", "     "))
        full = F.length("_x")
        counts = [((full - F.length(F.replace("_x", F.lit(f" {w} "), F.lit(" ")))) / (len(w) + 1)).alias(f"k{i}") for i, w in enumerate(self.words)]
        out = out.withColumn("_k", F.struct(*counts, F.lit(0.0).alias("none"))).drop("_x")
        seen = sum((F.col(f"_k.k{i}") for i in range(len(self.words))), F.lit(0.0))
        out = out.withColumn("_o", F.greatest(F.col("_n") - seen, F.lit(0.0)))
        scale = F.least(F.lit(1.0), F.lit(MOST_EVIDENCE) / F.greatest("_n", F.lit(1.0)))
        if len(self.domains) <= UNROLLED:
            logs = []
            for d, prior in enumerate(self.priors):
                total = F.col("_o") * self.other[d] if self.words else F.lit(0.0)
                for i in range(len(self.words)):
                    total = total + F.col(f"_k.k{i}") * self.weights[i][d]
                logs.append(F.lit(prior) + scale * total)
            out = out.withColumn("_g", F.array(*logs)).drop("_k", "_o")
        else:  # one array of logarithms a word: the plan does not grow with words times domains
            arrays = lambda rows: F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")
            terms = F.array(*[F.col(f"_k.k{i}") for i in range(len(self.words))], F.col("_o"), F.lit(1.0) / F.greatest(scale, F.lit(1e-9)))
            parts = F.arrays_zip(terms.alias("x"), arrays([*self.weights, self.other or [0.0] * len(self.domains), self.priors]).alias("w"))
            add = lambda acc, t: F.zip_with(acc, t["w"], lambda a, w: a + scale * t["x"] * w)
            zero = arrays([[0.0] * len(self.domains)])[0]
            out = out.withColumn("_g", F.aggregate(parts, zero, add)).drop("_k", "_o")
        out = out.withColumn("_e", F.transform("_g", lambda g: F.exp(g - F.array_max("_g")))).drop("_g")
        return out.withColumn("_p", F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))).drop("_e")


def fit(documents: DataFrame, labels: DataFrame, domain: str = "lang", rows: int = FIT_ROWS) -> DomainModel:
    """Counts words by domain on documents that the labelled table names; at most `rows`, in the order of a hash.

    Null domains are no evidence; all others that the sample has are kept.  Without labelled rows there is one domain,
    `all`.
    """
    ids = labels.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    docs = documents.select("doc_id", F.col(domain).cast("string").alias("domain"), F.lower(whole_text()).alias("text")).filter(F.col("domain").isNotNull())
    docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    sample = materialize(docs.select("domain", F.explode(_split(F.translate("text", ".,", "  "))).alias("word")).groupBy("domain", "word").agg(F.count("*").alias("c")), "mix-words")
    sizes = [(r["domain"], r["c"]) for r in sample.groupBy("domain").agg(F.sum("c").alias("c")).collect()]  # one row a domain
    if not sizes:
        return DomainModel(["all"], [0.0])
    sizes.sort()
    names, totals = [d for d, _ in sizes], [float(c) for _, c in sizes]
    all_words = sum(totals)
    shares = {d: c / all_words for d, c in sizes}
    kept = sample.filter(F.col("domain").isin(names))
    share = F.element_at(F.create_map(*[F.lit(x) for d in names for x in (d, shares[d])]), F.col("domain"))
    by_word = kept.groupBy("word").agg(F.sum("c").alias("n"))
    # mutual information of a word with the domain
    gain = kept.join(by_word, "word").withColumn("share", share).groupBy("word").agg(F.sum(F.col("c") * F.log(F.col("c") / (F.col("n") * F.col("share")))).alias("gain"))
    best = [r["word"] for r in gain.filter(F.length("word") < 40).orderBy(F.desc("gain"), "word").limit(WORDS).collect()]
    counts = {(r["domain"], r["word"]): r["c"] for r in kept.filter(F.col("word").isin(best)).collect()}
    weights = [[math.log((counts.get((d, w), 0) + 0.5) / (t + 0.5 * (len(best) + 1))) for d, t in zip(names, totals, strict=True)] for w in best]
    other = [math.log((t - sum(counts.get((d, w), 0) for w in best) + 0.5) / (t + 0.5 * (len(best) + 1))) for d, t in zip(names, totals, strict=True)]
    return DomainModel(names, [math.log(t / all_words) for t in totals], best, weights, other)


def _rate(gradients: list[list[float]]) -> Column:
    """The projected-gradient fold over the rounds so far, for one row's posteriors `_p`."""
    if not gradients:
        return F.lit(1.0)
    rounds = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in gradients])
    step = lambda r, g: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with("_p", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x))
    return F.aggregate(rounds, F.lit(1.0), step)


def fit_rates(features: DataFrame, targets: list[float], rounds: int = ROUNDS) -> list[list[float]]:
    """features: `_n`, `_p`.  The steps of the rounds; stops when all domain totals are within TOLERANCE.

    targets are shares by domain; the expected total of tokens stays that of the input.  The residual of a domain
    is weighted by its share in the input, which makes the problem well conditioned; a domain without tokens in the
    input cannot be raised and is left out.
    """
    size, steps = len(targets), []
    start = features.agg(F.sum("_n").alias("n"), *[F.sum(F.col("_n") * F.col("_p")[d]).alias(f"d{d}") for d in range(size)]).first()
    total = start["n"] or 0.0
    if not total:
        return []
    base = [(start[f"d{d}"] or 0.0) / total for d in range(size)]
    for _ in range(rounds):
        rated = features.select("_n", "_p", _rate(steps).alias("_r"))
        now = rated.agg(*[F.sum(F.col("_n") * F.col("_r") * F.col("_p")[d]).alias(f"d{d}") for d in range(size)]).first()
        error = [(now[f"d{d}"] or 0.0) / total - t for d, t in enumerate(targets)]
        if max(map(abs, error)) < TOLERANCE:
            break
        steps.append([e / b if b > 1e-6 else 0.0 for e, b in zip(error, base, strict=True)])
    return steps


def _targets(model: DomainModel, targets: dict[str, float] | None) -> list[float]:
    if missing := [d for d, t in (targets or {}).items() if t and d not in model.domains]:
        raise ValueError(f"targets for domains that no labelled document has: {missing}")
    given = {d: float((targets or {}).get(d, 0.0 if targets else 1.0)) for d in model.domains}
    total = sum(given.values()) or 1.0
    return [given[d] / total for d in model.domains]


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang") -> DataFrame:
    """The op3 query: one row per row of documents: doc_id, n_tokens, posteriors (map), rate.

    targets: share by domain (all equal by default).  Null and empty texts have no tokens and the priors as
    posteriors, and so a rate like any other; repeated rows are rated alike; an empty table gives an empty result.
    """
    model = fit(documents, labels, domain)
    features = materialize(model.posteriors(documents.select("doc_id", "text")).select("doc_id", "_n", "_p"), "mix")
    steps = fit_rates(features, _targets(model, targets))
    names = F.array(*[F.lit(d) for d in model.domains])
    return features.select("doc_id", F.col("_n").cast("long").alias("n_tokens"), F.map_from_arrays(names, "_p").alias("posteriors"), _rate(steps).alias("rate"))


def mixed(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "lang") -> DataFrame:
    """documents with `rate` and `copies`: the rate rounded to a whole number at random by a hash of the id.

    Rows with rate 0 go; all others stay, with their copies (which may be 0) for the reader to repeat.  Columns of
    these two names are replaced; all others stay, whatever their names.
    """
    model = fit(documents, labels, domain)
    kept = [c for c in documents.columns if c not in ("rate", "copies")]
    rows = materialize(model.posteriors(documents.select(F.struct(*kept).alias("row"), "text")).drop("text"), "mix")
    steps = fit_rates(rows.select("_n", "_p"), _targets(model, targets))
    out = rows.withColumn("rate", _rate(steps)).select("row.*", "rate")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / F.lit(1 << 20)
    return out.filter(F.col("rate") > 0).withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
