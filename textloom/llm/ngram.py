"""Language-model scoring from a log-frequency Bloom filter.

Counting: every task joins its documents into blocks and deals each block's distinct words and word pairs by hash; the
task of a hash range sums their counts over the corpus and returns to each block the exact counts of its words, for
the add-half scores.  No word table leaves the cluster's shuffle.

Model: quantised logarithmic counts of words and of word pairs are held in Bloom filters: a key of level q is entered
as (key, 1) ... (key, q), and a count is read back by probing levels until one is missing.  All words and pairs are
entered, those seen once included; a hash range has a filter of its own with as many bits as its entries need.  The
probability of a token interpolates the pair's relative frequency with the add-half word probability; the weights by
frequency of the previous word come from deleted interpolation over all training documents.

Up to BROADCAST_TEXT bytes of text, which bound the filters' size, all ranges' filters are broadcast and probed where
the texts are.  Beyond, the filter of a range stays in the task that built it, which probes it for the words and pairs
of every block and returns their levels.  The bits, and so the results, are the same.
"""

from __future__ import annotations

import math
from itertools import count as counter

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, discard, fold_of, materialize, small_batches, text_bytes, whole_text
from .words import WordHasher

#: Bytes of text up to which filters are broadcast.  A token enters one level of a word and one of a pair at most, of
#: 2.5 bytes each after rounding up, and takes 2 bytes of text: filters have 2.5 times as many bytes as the text at most.
BROADCAST_TEXT = 1 << 27
BITS_PER_ENTRY = 10
HASHES = 3
BUCKET_BYTES = 16e6
FLUSH_TOKENS = 2_000_000
END = xxhash.xxh3_64_intdigest(b"\x20end")
START = xxhash.xxh3_64_intdigest(b"\x20start")
CLASSES = 40


def _thresholds(ratio: float, first: int) -> np.ndarray:
    """Counts at which levels begin: exact at first, then growing by the ratio."""
    out = [first]
    while out[-1] < 1e13:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


WORD_LEVELS, PAIR_LEVELS = _thresholds(1.15, 1), _thresholds(1.4, 1)


def middle(levels: np.ndarray) -> np.ndarray:
    """The count that stands for a level: the geometric mean of its counts; 0 for level 0."""
    return np.append(0.0, np.sqrt(levels * np.append(levels[1:] - 1, levels[-1]).astype(float)))


PAIR_BITS = np.uint64(0xFFFFFFFFFFFF0000)  # pairs are told apart by 48 bits: rarer mistakes than the filter's own


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left ^ (left >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & PAIR_BITS


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys by their 16-bit parts, which a shuffle's compression can use."""
    return keys.view(np.uint16).reshape(-1, 4).T.tobytes()


def _keys(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint16).reshape(4, -1).T).view(np.uint64).ravel()


def token_hashes(texts: list[str], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens by text, hashes of their pairs): words, then one end for each text."""
    words, counts = hasher.words(texts)
    size = counts + 1
    now = np.full(int(size.sum()), END, np.uint64)
    inner = np.ones(len(now), bool)
    inner[size.cumsum() - 1] = False
    now[inner] = words
    before = np.append(np.uint64(START), now[:-1]) if len(now) else now
    before[(size.cumsum() - size)[: len(size)]] = START
    return now, size, pair_hash(before, now)


class BloomCounts:
    """Log-frequency Bloom filter of 64-bit keys: quantised counts, read back by repeated probes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # of uint8, a power of two long

    @classmethod
    def of(cls, keys: np.ndarray, level: np.ndarray) -> BloomCounts:
        """Keys entered with their levels (from 1); as many bits as they need."""
        size = 1 << max(10, math.ceil(math.log2(max(1, int(level.sum()) * BITS_PER_ENTRY))))
        out, q = cls(np.zeros(size // 8, np.uint8)), 1
        while len(keys := keys[level >= q]):
            level = level[level >= q]
            for p in out._places(keys, q):
                np.bitwise_or.at(out.bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
            q += 1
        return out

    def _places(self, keys: np.ndarray, level: int):
        x = (keys ^ np.uint64((level * 0xD6E8FEB86659FD93) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        for k in range(HASHES):
            yield (a + np.uint64(k) * b) & np.uint64(len(self.bits) * 8 - 1)

    def level_of(self, keys: np.ndarray) -> np.ndarray:
        """Levels: 0 for a key that was never entered (but for rare chance hits)."""
        out, open_, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(open_):
            level += 1
            hit = np.ones(len(open_), bool)
            for p in self._places(keys[open_], level):
                hit &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            open_ = open_[hit]
            out[open_] = level
            if level == 255:
                break
        return out


def _levels(filters: list[BloomCounts], keys: np.ndarray) -> np.ndarray:
    """Levels of sorted keys from the filters of equal hash ranges."""
    shift = np.uint64(64 - (len(filters).bit_length() - 1))
    cuts = np.searchsorted(keys, np.arange(1, len(filters), dtype=np.uint64) << shift)
    parts = [f.level_of(k) if len(k) else np.zeros(0, np.uint8) for f, k in zip(filters, np.split(keys, cuts), strict=True)]
    return np.concatenate(parts)


_BLOCKS = "bucket int, block long, a binary, b binary, c binary"


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc"), whole_text().alias("text"), (fold_of(5) != 1).alias("train"))


def _pack(texts: list[str]) -> bytes:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    return zstandard.ZstdCompressor(1).compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts))


def _unpack(packed: bytes, n: int) -> list[str]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    ends = 8 * n + np.frombuffer(data, np.int64, n).cumsum()
    return [data[x:y].decode("utf-8", "surrogatepass") for x, y in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a sorted array."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    return first, np.append(first[1:], len(bucket))[: len(first)]


def _blocks(documents: DataFrame, buckets: int) -> DataFrame:
    """bucket -1: the documents of a block (ids, tokens with flags, texts).  0..: words, then pairs, by hash.

    Words and pairs: distinct hashes of the block, counts in training documents.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def block(number: int, docs: list, texts: list[str], train: list[bool], hasher: WordHasher) -> pd.DataFrame:
        now, size, pairs = token_hashes(texts, hasher)
        learn, absent = np.array(train, bool), np.array([d is None for d in docs], bool)
        flags = size * 4 + learn * 2 + absent
        rows = [(-1, number, np.array([d or 0 for d in docs], np.int64).tobytes(), flags.astype(np.int64).tobytes(), _pack(texts))]
        weight = np.repeat(learn, size)
        for first, keys in ((0, now), (buckets, pairs)):
            own, index = np.unique(keys, return_inverse=True)
            c = np.bincount(index, weight, len(own)).astype(np.uint32)
            for x, y in zip(*map(np.ndarray.tolist, _cuts(own >> shift)), strict=True):
                rows.append((first + int(own[x] >> shift), number, _packed(own[x:y]), c[x:y].tobytes(), b""))
        return pd.DataFrame(rows, columns=["bucket", "block", "a", "b", "c"])

    def run(batches):
        numbers, hasher = counter(TaskContext.get().partitionId() << 24), WordHasher()
        held, size = ([], [], []), 0
        for b in batches:
            ids = [None if pd.isna(d) else int(d) for d in b["doc"]]
            for row in zip(ids, b["text"], b["train"].tolist(), strict=True):
                for x, to in zip(row, held, strict=True):
                    to.append(x)
                size += len(row[1]) // 4 + 1
                if size >= FLUSH_TOKENS:
                    yield block(next(numbers), *held, hasher)
                    held, size = ([], [], []), 0
        if size:
            yield block(next(numbers), *held, hasher)

    return _documents(documents).mapInPandas(run, _BLOCKS)


_PARTS = "kind string, block long, n long, v long, a binary, b binary, c binary"


def _count(buckets: int, probe: bool):
    """Sums the counts of one bucket, builds its filter and, if asked, probes it for every block.

    kind words, pairs: the filter of hash range n; total: n tokens, v distinct words; list: a block's documents, as they
    came; word counts, word levels, pair levels: of a block's keys in hash range n.
    """
    columns = ["kind", "block", "n", "v", "a", "b", "c"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:
            return pdf.assign(kind="list", n=0, v=0)[columns]
        kind, levels = ("word", WORD_LEVELS) if bucket < buckets else ("pair", PAIR_LEVELS)
        hashes = [_keys(x) for x in pdf["a"]]
        h, index = np.unique(np.concatenate(hashes), return_inverse=True)
        parts = np.split(index.astype(np.int32), np.cumsum([len(x) for x in hashes])[:-1])
        del hashes, index
        c = np.zeros(len(h), np.int64)
        for i, b in zip(parts, pdf["b"], strict=True):
            c[i] += np.frombuffer(b, np.uint32)  # the keys of a block are distinct
        bloom = BloomCounts.of(h[c > 0], np.searchsorted(levels, c[c > 0], side="right"))
        back = lambda name, by: [(name, block, bucket % buckets, 0, by[i].tobytes(), b"", b"") for block, i in zip(pdf["block"].tolist(), parts, strict=True)]
        rows = [("total", -1, int(c.sum()), int((c > 0).sum()), b"", b"", b""), *back("word counts", c)] if kind == "word" else []
        if probe:
            rows += back(f"{kind} levels", bloom.level_of(h))
        else:
            rows.append((f"{kind}s", -1, bucket % buckets, 0, bloom.bits.tobytes(), b"", b""))
        return pd.DataFrame(rows, columns=columns)

    return run


_SCORED = "docs binary, flags binary, base binary, known binary, word binary, pair binary"


def _assemble(sent):
    """Joins what came back for one block: the counts of its words, the levels of its tokens and of their pairs.

    sent: the broadcast filters (words, pairs) by hash range, or None where the levels came back, too.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["kind"] == "list"].iloc[0]
        came = lambda kind, dtype: np.concatenate([np.frombuffer(x, dtype) for x in pdf[pdf["kind"] == kind].sort_values("n")["a"]])
        size = np.frombuffer(head["b"], np.int64) >> 2
        now, _, pairs = token_hashes(_unpack(head["c"], len(size)), WordHasher())
        owner, out = np.repeat(np.arange(len(size)), size), []
        for k, (kind, keys) in enumerate((("word", now), ("pair", pairs))):
            u, index = np.unique(keys, return_inverse=True)
            if kind == "word":
                c = came("word counts", np.int64)
                base, known = np.bincount(owner, np.log10(c + 0.5)[index], len(size)), np.bincount(owner, (c > 0)[index], len(size)).astype(np.int64)
            level = came(f"{kind} levels", np.uint8) if sent is None else _levels(sent.value[k], u)
            out.append(zstandard.ZstdCompressor(1).compress(level[index].tobytes()))
        return pd.DataFrame([(head["a"], head["b"], base.tobytes(), known.tobytes(), *out)], columns=["docs", "flags", "base", "known", "word", "pair"])

    return run


def _unpacked(row):
    """(tokens by document, training flags, null ids, levels of words, of the words before, of pairs) of a block."""
    flags = np.frombuffer(row.flags, np.int64)
    word, pair = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in (row.word, row.pair))
    size = flags >> 2
    ends = size.cumsum() - 1
    before = np.append(np.uint8(0), word[:-1]) if len(word) else word
    before[ends - size + 1] = word[ends]  # one start for each end
    return size, (flags & 2) > 0, (flags & 1) > 0, word, before, pair


def level_counts(blocks: DataFrame) -> pd.DataFrame:
    """(code, n): how often levels (before, word, pair) occur in training documents; 0 for those of others only.

    The levels are of a fixed number, so the result is bounded however large the corpus is.
    """

    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                size, train, _, word, before, pair = _unpacked(row)
                code = (before.astype(np.int32) << 16) | (word.astype(np.int32) << 8) | pair
                u, index = np.unique(code, return_inverse=True)
                yield pd.DataFrame({"code": u, "n": np.bincount(index, np.repeat(train, size), len(u)).astype(np.int64)})

    return blocks.mapInPandas(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()


def _tune(odds: np.ndarray, group: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Deleted interpolation: weights by class of the previous word's count that make the left-out tokens likeliest."""
    w, total = np.full(CLASSES, 0.1), np.bincount(group, n, CLASSES)
    for _ in range(60):
        belief = w[group] * odds / (w[group] * odds + 1 - w[group])
        w = np.clip(np.bincount(group, n * belief, CLASSES) / np.maximum(total, 1), 0, 0.95)
    return np.where(total > 0, w, 0.0)


def log_probabilities(seen: pd.DataFrame, log_z: float) -> np.ndarray:
    """log10 of the probability by (level before, level, level of the pair), for all that occur."""
    code, n = seen["code"].to_numpy(), seen["n"].to_numpy()
    words, pairs = middle(WORD_LEVELS), middle(PAIR_LEVELS)
    previous, word = words[code >> 16], (words[code >> 8 & 255] + 0.5) / 10**log_z
    together = np.where(previous < 1, 0.0, np.minimum(pairs[code & 255], previous))
    group = np.clip(np.log2(np.maximum(previous, 1)).astype(int), 0, CLASSES - 1)
    ok = previous >= 1.5
    left = np.maximum(together - 1, 0) / np.maximum(previous - 1, 1)
    weights = _tune(left[ok] / word[ok], group[ok], n[ok])
    w = np.where(previous >= 1, weights[group], 0.0)
    at = code >> 16, code >> 8 & 255, code & 255
    out = np.zeros([int(x.max()) + 1 if len(x) else 1 for x in at])
    out[at] = np.log10((1 - w) * word + w * together / np.maximum(previous, 1))
    return out


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(documents: DataFrame) -> DataFrame:
    """The op9 query: one row per row of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty (one end token); repeated rows are scored alike; a null doc_id stays null and hashes as the
    empty text; an empty table gives an empty result; without training documents every token has probability 1
    (N = 0, V = 0).  A text of any length is one document of a block; it is held as arrays of 8 bytes a token.
    Columns beside doc_id and text are not read.
    """
    small_batches(documents.sparkSession, 128)  # rows of blocks have tens of kilobytes
    docs = documents.select("doc_id", "text")
    total_bytes = text_bytes(docs)
    buckets, near = bucket_count(2.4 * total_bytes, BUCKET_BYTES), total_bytes <= BROADCAST_TEXT
    own = F.when(F.col("bucket") < 0, F.col("block"))  # the lists of documents stay apart
    parts = materialize(_blocks(docs, buckets).groupBy("bucket", own.alias("own")).applyInPandas(_count(buckets, not near), _PARTS), "ngram", True)
    total = parts.filter("kind = 'total'").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"] or 0)
    log_z = math.log10(n + 0.5 * (v + 1))
    sent = documents.sparkSession.sparkContext.broadcast([_filters(parts, kind, buckets) for kind in ("words", "pairs")]) if near else None
    blocks = materialize(parts.filter("block >= 0").groupBy("block").applyInPandas(_assemble(sent), _SCORED), "ngram-blocks", True)
    discard(parts)
    table = documents.sparkSession.sparkContext.broadcast(log_probabilities(level_counts(blocks), log_z))

    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                size, train, absent, word, before, pair = _unpacked(row)
                score = np.bincount(np.repeat(np.arange(len(size)), size), table.value[before, word, pair], len(size))
                ids = pd.array(np.frombuffer(row.docs, np.int64).copy(), "Int64")
                ids[absent] = None
                base = np.frombuffer(row.base, np.float64) - size * log_z
                yield pd.DataFrame({"doc_id": ids, "held_out": ~train, "n_tokens": size, "n_known": np.frombuffer(row.known, np.int64), "train_tokens": n, "base_score": base, "score": score})

    return blocks.mapInPandas(run, _OUT)


def _filters(parts: DataFrame, kind: str, buckets: int) -> list[BloomCounts]:
    """The filters of all hash ranges, of at most BROADCAST_TEXT bytes together."""
    out = [BloomCounts(np.zeros(1, np.uint8)) for _ in range(buckets)]
    for r in parts.filter(F.col("kind") == kind).select("n", "a").toLocalIterator():
        out[r["n"]] = BloomCounts(np.frombuffer(r["a"], np.uint8))
    return out
