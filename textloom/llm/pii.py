"""Personal data: fixed base kinds plus bootstrapped contextual extraction.

Base matches (email, ip, card, phone) are seeds.  Seeds induce lexical patterns (the words before them); Spark scores
the bipartite graph of patterns and instances iteratively (a pattern is as good as its instances, an instance as good
as its patterns together); patterns of high confidence then mark further identifiers in their place (kind ctx).
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_prefix, materialize, whole_text

KINDS = ("email", "ip", "card", "phone", "ctx")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As the contract's pattern: a match starts where a run of digits starts, so that long runs take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A word that may be an identifier: at least six letters, digits or marks, with three digits among them.
_WORD = re.compile(r"[^\s]+")
_IDENT = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.@:/+-]{4,}[A-Za-z0-9]")
PATTERN_BYTES = 4_000_000  # of patterns that go with a task's closure; more are joined with the candidate places
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.8, 3


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind in the order of KINDS, then start: leftmost non-overlapping matches that hold, per kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _patterns(text: str, start: int) -> list[str]:
    """Lexical patterns of a place: the word before it, and the two words before it, digits as 0."""
    before = text[max(0, start - 80) : start].split()
    words = [re.sub(r"[0-9]", "0", w.lower()) for w in before[-2:]]
    return [" ".join(words[-k:]) for k in (1, 2) if len(words) >= k]


def _candidates(text: str, base: list[tuple[str, int, int]]):
    """Identifier-like words outside the base spans: (start, end)."""
    taken = sorted((a, b) for _, a, b in base)
    i = 0
    for d in _WORD.finditer(text):
        if not _DIGIT.search(text, d.start(), d.end()):
            continue
        m = _IDENT.search(text, d.start(), d.end())
        if not m or sum("0" <= c <= "9" for c in m[0]) < 3:
            continue
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        yield a, b


def graph_edges(documents: DataFrame) -> DataFrame:
    """(pattern, instance, seed): places of seeds and of identifier-like words, distinct."""

    def run(batches):
        for b in batches:
            rows = set()
            for text in b["text"]:
                base = base_spans(text)
                if not base and not _DIGIT.search(text):
                    continue
                for _, s, e in base:
                    rows |= {(p, text[s:e].lower(), True) for p in _patterns(text, s)}
                for s, e in _candidates(text, base):
                    rows |= {(p, text[s:e].lower(), False) for p in _patterns(text, s)}
            yield pd.DataFrame(sorted(rows), columns=["pattern", "instance", "seed"])

    found = documents.select(whole_text().alias("text")).mapInPandas(run, "pattern string, instance string, seed boolean")
    return found.groupBy("pattern", F.xxhash64("instance").alias("instance")).agg(F.max("seed").alias("seed"))


def learn_patterns(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """All patterns that reach CONFIDENCE on the graph: (pattern, confidence).

    A pattern is rated over all its instances, those of score 0 included.  Its support is of accepted instances: seeds,
    and in later rounds also instances that patterns of the rounds before mark with confidence.
    """
    edges = graph_edges(documents)
    able = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
    edges = materialize(edges.join(able.select("pattern"), "pattern", "left_semi"), "pii-graph")
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        accepted = F.sum((F.col("score") >= CONFIDENCE).cast("int"))
        known = edges.join(scores, "instance", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        rated = known.groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(0.5))).alias("confidence"), F.count("*").alias("n"), accepted.alias("accepted")).filter(F.col("accepted") >= SUPPORT)
        told = edges.join(rated.filter(F.col("confidence") >= CONFIDENCE / 2), "pattern")
        by_pattern = told.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("noisy_or"))
        seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
        found = seeds.join(by_pattern, "instance", "left")
        before, scores = scores, materialize(found.select("instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("noisy_or", F.lit(0.0))).alias("score")), "pii-scores")
    # `rated` of the last round reads the graph and the scores before it
    out = materialize(rated.filter(F.col("confidence") >= CONFIDENCE).select("pattern", "confidence"), "pii-patterns")
    discard(edges, scores, before)
    return out


def _with_places(documents: DataFrame, patterns: DataFrame, prefix: str) -> tuple[DataFrame, frozenset[str] | None]:
    """documents with a column prefix + `ctx`, and the patterns for spans_of; where they are too many, None, and the
    column has the places."""
    _ctx, _key = prefix + "ctx", prefix + "key"
    if (patterns.agg(F.sum(F.octet_length("pattern")).alias("b")).first()["b"] or 0) <= PATTERN_BYTES:
        return documents.withColumn(_ctx, F.lit(None).cast("string")), frozenset(r["pattern"] for r in patterns.select("pattern").collect())

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b["key"].tolist(), b["text"], strict=True):
                if _DIGIT.search(text):
                    rows += [(key, f"{s}:{e}", p) for s, e in _candidates(text, base_spans(text)) for p in _patterns(text, s)]
            yield pd.DataFrame(rows, columns=["key", "place", "pattern"])

    keyed = documents.withColumn(_key, F.xxhash64(whole_text()))
    places = keyed.select(F.col(_key).alias("key"), whole_text().alias("text")).mapInPandas(run, "key long, place string, pattern string")
    found = places.join(patterns.select("pattern"), "pattern", "left_semi").groupBy(F.col("key").alias(_key)).agg(F.concat_ws(",", F.collect_set("place")).alias(_ctx))
    return keyed.join(found, _key, "left").drop(_key), None


def spans_of(text: str, patterns: frozenset[str] | None, places: str | None = None) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    if patterns is None:
        return base + [("ctx", a, b) for a, b in sorted(tuple(map(int, p.split(":"))) for p in (places or "").split(",") if p)]
    if not patterns or not _DIGIT.search(text):
        return base
    return base + [("ctx", a, b) for a, b in _candidates(text, base) if any(p in patterns for p in _patterns(text, a))]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span becomes its kind in brackets; overlapping spans become one, named after the first."""
    out, end = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def find_spans(documents: DataFrame, patterns: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kinds array, starts array, ends array) per row, spans in the order of KINDS, then start."""
    prefix = free_prefix(documents.columns)
    placed, known = _with_places(documents, patterns, prefix)

    def run(batches):
        for b in batches:
            found = [spans_of(t, known, c) for t, c in zip(b["text"], b["places"], strict=True)]
            yield pd.DataFrame({key: b[key], "kinds": [[k for k, _, _ in s] for s in found], "starts": [[a for _, a, _ in s] for s in found], "ends": [[e for _, _, e in s] for s in found]})

    kind = documents.schema[key].dataType.simpleString()
    return placed.select(key, whole_text().alias("text"), F.col(prefix + "ctx").alias("places")).mapInPandas(run, f"{key} {kind}, kinds array<string>, starts array<long>, ends array<long>")


def redacted(documents: DataFrame) -> DataFrame:
    """documents with personal data replaced in `text` (and n_chars set anew where the column exists).

    All other columns, null texts and repeated rows stay as they are.
    """
    prefix = free_prefix(documents.columns)
    placed, known = _with_places(documents, learn_patterns(documents), prefix)

    def clean(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, spans_of(t, known, c)) for t, c in zip(texts, places, strict=True)], dtype=object)

    out = placed.withColumn("text", F.pandas_udf(clean, "string")("text", prefix + "ctx")).select(documents.columns)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out


def pii(documents: DataFrame) -> DataFrame:
    """The op6 query: one row per row of documents with counts by base kind, a digest of the base spans, all spans.

    Null text is empty (no spans); repeated rows give equal rows; an empty table gives an empty result.
    """
    found = find_spans(documents.select("doc_id", "text"), learn_patterns(documents))

    def run(batches):
        for b in batches:
            rows = []
            for doc, kinds, starts, ends in zip(b["doc_id"], b["kinds"], b["starts"], b["ends"], strict=True):
                spans = [f"{k}:{s}:{e}" for k, s, e in zip(kinds, starts, ends, strict=True)]
                base = ",".join(s for s in spans if not s.startswith("ctx:"))
                kinds = list(kinds)
                rows.append((doc, *[kinds.count(k) for k in KINDS[:4]], hashlib.sha256(base.encode()).hexdigest(), ",".join(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return found.mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
