"""Benchmark decontamination: BM25 over an inverted index of the test items, searched by block-max WAND.

Every passage of every training text is a query.  The index holds impacts divided by the item's score against
itself, so one threshold serves all items: all items at or above it are retrieved, none is missed (upper bounds
only ever skip passages and blocks that cannot reach it).  A hit counts when both the item's question part and its
answer part overlap with the passage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix

K1, B = 1.2, 0.75
THRESHOLD = 0.4  # of the item's score against itself
OVERLAP = 0.5  # of the trigrams of question and of answer
BLOCK = 32
BLOCKS = 256
CHUNK = 256  # longer items are indexed in chunks of so many words
#: Text of the items held in one broadcast index; more items are searched in several passes.
SHARD_BYTES = 8_000_000
_WORD = re.compile(r"\w+")
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))
_ARROW_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(words: list[str], most: int = 3) -> set[tuple]:
    n = min(most, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


class ItemIndex:
    """Postings by term: item numbers ascending, impacts, and the largest impact of each block of BLOCK postings."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.parts, docs = [], [], []
        for item_id, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
            words = words_of(text)
            for i in range(0, len(words), CHUNK):
                piece = words[i : i + CHUNK]
                cut = math.ceil(0.6 * len(piece))
                self.ids.append(item_id)
                self.parts.append((_grams(piece[:cut]), _grams(piece[cut:])))
                docs.append(piece)
        mean = sum(map(len, docs)) / max(1, len(docs))
        df: dict[str, int] = {}
        for d in docs:
            for w in set(d):
                df[w] = df.get(w, 0) + 1
        self.terms = {w: i for i, w in enumerate(sorted(df))}
        idf = {w: math.log(1 + (len(docs) - c + 0.5) / (c + 0.5)) for w, c in df.items()}
        self.postings: list[tuple[list[int], list[float], list[float]]] = [([], [], []) for _ in df]
        for k, d in enumerate(docs):
            impact = {w: idf[w] * (f := d.count(w)) * (K1 + 1) / (f + K1 * (1 - B + B * len(d) / mean)) for w in set(d)}
            total = sum(impact.values())
            for w, x in impact.items():
                p = self.postings[self.terms[w]]
                p[0].append(k)
                p[1].append(x / total)
        for ks, xs, blocks in self.postings:
            blocks += [max(xs[i : i + BLOCK]) for i in range(0, len(ks), BLOCK)]
        self.most = np.array([max(p[1]) for p in self.postings] or [0.0])
        # Bounds for whole batches of passages: items in at most BLOCKS blocks; terms of many items as a matrix of block
        # maxima, the others as lists of blocks.
        size = max(1, -(-len(docs) // BLOCKS))
        self.column, rare = np.full(len(df) + 1, -1, np.int64), []
        often = [t for t, p in enumerate(self.postings) if len(p[0]) >= 5]
        self.column[often] = np.arange(len(often))
        self.maxima = np.zeros((len(often), max(1, -(-len(docs) // size))), np.float32)
        self.first = np.zeros(len(df) + 2, np.int64)
        for t, (ks, xs, _) in enumerate(self.postings):
            if self.column[t] >= 0:
                np.maximum.at(self.maxima[self.column[t]], np.array(ks) // size, np.array(xs, np.float32))
            else:
                rare += [(k // size, x) for k, x in zip(ks, xs, strict=True)]
            self.first[t + 1] = len(rare)
        self.rare_block = np.array([b for b, _ in rare], np.int64)
        self.rare_impact = np.array([x for _, x in rare], np.float32)
        self.segment = min(CHUNK, max(32, -(-max(map(len, docs), default=0) // 16) * 16))

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Block-max WAND: every item number whose score reaches the threshold, with its score."""
        found, end = [], len(self.ids)
        at = [[self.postings[t][0][0], 0, t] for t in terms]
        while True:
            at = [c for c in at if c[0] < end]
            at.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(at):
                bound += self.most[c[2]]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                return found
            doc = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == doc:
                pivot += 1
            blocks, limit = 0.0, end
            for c in at[: pivot + 1]:
                docs, _, best = self.postings[c[2]]
                i = bisect_left(docs, doc, c[1])
                if i < len(docs):
                    blocks += best[i // BLOCK]
                    limit = min(limit, docs[min(len(docs), (i // BLOCK + 1) * BLOCK) - 1] + 1)
            if pivot + 1 < len(at):
                limit = min(limit, at[pivot + 1][0])
            if blocks < threshold - 1e-9:
                to = max(limit, doc + 1)
            elif at[0][0] == doc:
                score = 0.0
                for c in at[: pivot + 1]:
                    score += self.postings[c[2]][1][c[1]]
                if score >= threshold - 1e-9:
                    found.append((doc, score))
                to = doc + 1
            else:
                to = doc
            for c in at[: pivot + 1]:
                if c[0] < to:
                    docs = self.postings[c[2]][0]
                    c[1] = bisect_left(docs, to, c[1])
                    c[0] = docs[c[1]] if c[1] < len(docs) else end

    def _able(self, owner: np.ndarray, term: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Which passages (a segment with the next of its text) some block's upper bound lets reach the threshold."""
        n = len(same)
        column = self.column[term]
        often = column >= 0
        holds = np.zeros((n + 1, len(self.maxima)), np.float32)
        holds[owner[often], column[often]] = 1
        bound = np.maximum(holds[:-1], np.where(same[:, None], holds[1:], 0)) @ self.maxima
        t, o = term[~often], owner[~often]
        count = self.first[t + 1] - self.first[t]
        at = np.arange(int(count.sum())) + np.repeat(self.first[t] - (count.cumsum() - count), count)
        rare = np.zeros((n + 1, bound.shape[1]), np.float32)
        np.add.at(rare, (np.repeat(o, count), self.rare_block[at]), self.rare_impact[at])
        bound += rare[:-1]
        bound += np.where(same[:, None], rare[1:], 0)
        return bound.max(1, initial=0) >= THRESHOLD - 1e-4

    def leaks(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """As leaks_of, about half a megabyte of text at a time."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= 500_000:
                out += self.leaks_of(held)
                held, size = [], 0
        return out + self.leaks_of(held) if held else out

    def leaks_of(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text: item id -> (score, question overlap, answer overlap) of its best verified passage."""
        out: list[dict] = [{} for _ in texts]
        if not self.ids:
            return out
        get, size = self.terms.get, self.segment
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words])
        segments = -(-counts // size)
        first = segments.cumsum() - segments
        ids = np.concatenate([np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)) for w in words]) if len(words) else np.zeros(0, np.int64)
        place = np.arange(len(ids)) - np.repeat(counts.cumsum() - counts, counts)
        seg = np.repeat(first, counts) + place // size
        known = ids >= 0
        pairs = np.unique(seg[known] * len(self.terms) + ids[known])
        owner, term = pairs // len(self.terms), pairs % len(self.terms)
        text_of = np.repeat(np.arange(len(texts)), segments)
        same = np.append(text_of[1:] == text_of[:-1], False) if len(text_of) else np.zeros(0, bool)
        able = self._able(owner, term, same) if len(same) else same
        starts = np.searchsorted(owner, np.arange(int(segments.sum()) + 2))
        for s in np.flatnonzero(able).tolist():
            i = int(text_of[s])
            upto = s + 1 + bool(same[s])
            terms = sorted(set(term[starts[s] : starts[upto]].tolist()))
            hits = self.search(terms)
            if not hits:
                continue
            a = (s - int(first[i])) * size
            passage, grams = words[i][a : a + size * (upto - s)], {}
            for k, score in hits:
                # parts of fewer than three words have shorter grams
                lengths = [len(next(iter(p), ())) for p in self.parts[k]]
                grams |= {n: _grams(passage, n) for n in lengths if n and n not in grams}
                question, answer = ((len(p & grams[n]) / len(p) if p else 1.0) for p, n in zip(self.parts[k], lengths, strict=True))
                if question >= OVERLAP and answer >= OVERLAP:
                    old = out[i].get(self.ids[k])
                    new = (score, question, answer)
                    out[i][self.ids[k]] = max(old, new) if old else new
        return out


def _shards(items: DataFrame) -> list[list[tuple[int, str]]]:
    size = items.select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-size // SHARD_BYTES))
    for k in range(n):
        yield [(r[0], r[1]) for r in items.filter(F.col("item_id").isNotNull() & (F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)).select(F.col("item_id").cast("long"), "text").collect()]


def with_leaks(documents: DataFrame, items: DataFrame, column: str = "_leaks") -> DataFrame:
    """Every row and column of documents, with an array of verified hits (item_id, score, overlaps), by item_id.

    Null and empty texts have none; items without words or id match nothing; repeated rows are judged alike.  A column
    of the caller's must not have the name of the new one.
    """
    out = documents  # an index of one shard goes with the task's closure
    prefix = free_prefix([*documents.columns, column])
    for k, shard in enumerate(_shards(items)):
        index, name = ItemIndex(shard), column if not k else f"{prefix}{k}"

        def run(batches, index=index, name=name):
            for b in batches:
                found = index.leaks(b.column("text").to_pylist())
                hits = pa.array([[{"item_id": i, "score": f[i][0], "question_overlap": f[i][1], "answer_overlap": f[i][2]} for i in sorted(f)] for f in found], _ARROW_LEAK)
                yield b.append_column(name, hits)

        out = out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(name, LEAK)]))
        if k:
            out = out.withColumn(column, F.concat(column, name)).drop(name)
    return out


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents without the rows that hold a test item."""
    column = free_prefix(documents.columns) + "leaks"
    return with_leaks(documents, items, column).filter(F.size(column) == 0).drop(column)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The op8 query: one row per contaminated row of documents and item: doc_id, item_id, score, overlaps."""
    return with_leaks(documents.select("doc_id", "text"), items).select("doc_id", F.inline("_leaks"))
