"""Removal of repeated byte strings by external induced sorting.

Sorting all suffixes is induced from few of them.  In every window of WINDOW bytes, the K-gram of least hash is its
anchor; equal windows have equal anchors in equal places, so suffixes starting at anchors (about one byte in 35) stand
for all others.  Level 0 sorts suffix tuples (anchor, stretch, document, start), where the stretch names the bytes of
all windows of the anchor: tuples equal in anchor and stretch have a common prefix that covers all these windows, and
all but the first are repeats.  Only anchors whose stretches differ recurse: level 1 sorts the tuples of the windows
of one tuple per stretch.  Tuples pass through a disk-backed priority queue in sorted runs, so a shard may be far
larger than memory.  Names are 64-bit hashes: the order is that of names, which brings equal prefixes together as the
order of bytes does.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import shutil
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, materialize, small_batches, text_bytes, whole_text

WINDOW, K = 100, 32
PIECE = 1 << 18  # bytes hashed at once
QUEUE_ROWS = 3_000_000  # tuples held in memory by a queue
BUCKET_BYTES = 16e6
NO_ID = (1 << 63) - 1  # stands for a null doc_id: later than all others
_M = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFF)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_M, k, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 64 bytes from every place on."""
    h, size = b.astype(np.uint64) + np.uint64(1), 1
    h32 = h
    while size < 64:
        h = h[:-size] * _power(size) + h[size:] if len(h) > size else h[:0]
        size *= 2
        if size == 32:
            h32 = h
    return h32, h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(data: bytes, lengths: list[int]):
    """For texts joined in data: (anchor, stretch, first window, last window), one entry per anchor.

    Windows never cross texts.  data is one piece: it is held in memory several times over.
    """
    b = np.frombuffer(data, np.uint8)
    n = np.array(lengths, np.int64)
    able = np.maximum(n - WINDOW + 1, 0)
    none = np.zeros(0, np.int64)
    if not able.sum():
        return none.view(np.uint64), none.view(np.uint64), none, none
    h32, h64 = _hashes(b)
    x = _mix(h32)
    place = np.arange(len(x), dtype=np.uint64)
    anchor = (_least((x & ~_LOW) | place, WINDOW - K + 1) & _LOW).astype(np.int64)
    offset = n.cumsum() - n
    starts = np.arange(int(able.sum())) + np.repeat(offset - (able.cumsum() - able), able)
    p = anchor[starts]
    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)))
    lo, hi = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    end = hi + WINDOW - 64
    name = _mix(h64[lo] * np.uint64(3) ^ _mix(h64[(lo + end) // 2] ^ _mix(h64[end] + (hi - lo).astype(np.uint64))))
    return x[p[new]], name, lo, hi


class TupleQueue:
    """Priority queue of tuples on disk: sorted runs of whole columns, merged by blocks.

    Columns are equally long arrays.  pop() yields blocks of about `rows` tuples at most, in ascending order of all
    columns: tuples that share a prefix may go on in the next block, so that no key is held as a whole.
    """

    def __init__(self, rows: int = QUEUE_ROWS):
        self.rows, self.held, self.count, self.runs, self.dir = rows, [], 0, [], None

    @staticmethod
    def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns]

    def push(self, *columns: np.ndarray) -> None:
        if not len(columns[0]):
            return
        self.held.append(columns)
        self.count += len(columns[0])
        if self.count >= self.rows:
            self._spill()

    def _spill(self) -> None:
        self.dir = self.dir or tempfile.mkdtemp(prefix="tuples-")
        columns = self._sorted([np.concatenate(c) for c in zip(*self.held, strict=True)])
        paths = [os.path.join(self.dir, f"{len(self.runs)}-{k}.npy") for k in range(len(columns))]
        for path, c in zip(paths, columns, strict=True):
            np.save(path, c)
        self.runs.append(paths)
        self.held, self.count = [], 0

    def pop(self):
        try:
            if not self.runs:
                if self.held:
                    yield self._sorted([np.concatenate(c) for c in zip(*self.held, strict=True)])
                return
            if self.held:
                self._spill()
            runs = [[np.load(p, mmap_mode="r") for p in paths] for paths in self.runs]
            at, block = [0] * len(runs), max(1, self.rows // (2 * len(runs)))
            last = lambda k: tuple(c[min(at[k] + block, len(c)) - 1].item() for c in runs[k])
            heap = [(last(k), k) for k in range(len(runs))]
            heapq.heapify(heap)
            while heap:
                bound = heap[0][0]
                taken = []
                for k, run in enumerate(runs):
                    to = _upto(run, at[k], bound)
                    if to > at[k]:
                        taken.append([np.array(c[at[k] : to]) for c in run])
                        at[k] = to
                heap = [(last(k), k) for k in range(len(runs)) if at[k] < len(runs[k][0])]
                heapq.heapify(heap)
                yield self._sorted([np.concatenate(c) for c in zip(*taken, strict=True)])
        finally:
            if self.dir:
                shutil.rmtree(self.dir, ignore_errors=True)


def _upto(run: list[np.ndarray], start: int, bound: tuple) -> int:
    """Where the rows of a sorted run that are not beyond the bound end."""
    lo, hi = start, len(run[0])
    for c, b in zip(run, bound, strict=True):
        lo, hi = lo + int(np.searchsorted(c[lo:hi], b, side="left")), lo + int(np.searchsorted(c[lo:hi], b, side="right"))
    return hi


def _pieces(docs):
    """Texts in joined pieces of about PIECE bytes: (data, [(id, tag, offset in the text, length in the piece)]).

    A longer text is cut into overlapping pieces, so that each of its windows lies in one piece.
    """
    data, parts, size = [], [], 0
    for doc, tag, text in docs:
        for at in range(0, max(1, len(text) - WINDOW + 1), PIECE):
            part = text[at : at + PIECE + WINDOW - 1]
            data.append(part)
            parts.append((doc, tag, at, len(part)))
            size += len(part)
            if size >= PIECE:
                yield b"".join(data), parts
                data, parts, size = [], [], 0
    if parts:
        yield b"".join(data), parts


def _located(parts, lo: np.ndarray):
    """Documents, tags and starts in the document of places in a piece."""
    n = np.array([p[3] for p in parts], np.int64)
    offset = n.cumsum() - n
    k = np.searchsorted(offset + n, lo, side="right")
    ids = np.array([p[0] for p in parts], np.int64)
    tags = np.array([p[1] for p in parts], np.uint32)
    return ids[k], tags[k], lo - offset[k] + np.array([p[2] for p in parts], np.int64)[k]


def _keyed(documents: DataFrame) -> DataFrame:
    """doc (NO_ID for null), tag (tells rows of one id and different texts apart), text (never null)."""
    text = whole_text()
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.crc32(text.cast("binary")).alias("tag"), text.alias("text"), F.col("doc_id").isNull().alias("absent"))


_L0 = "bucket int, anchors binary, names binary, docs binary, tags binary, starts binary, spans binary"


def _tuples(docs: DataFrame, buckets: int) -> DataFrame:
    """Level-0 suffix tuples in binary blocks, dealt by anchor."""
    # anchors are least hashes, so their high bits are uneven; the low ones take no part in the comparison
    low = np.uint64(buckets - 1)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            rows = zip(b["doc"].tolist(), b["tag"].tolist(), (t.encode("utf-8", "surrogatepass") for t in b["text"]), strict=True)
            for data, parts in _pieces(rows):
                anchor, name, lo, hi = stretches(data, [p[3] for p in parts])
                if len(lo):
                    doc, tag, start = _located(parts, lo)
                    for c, v in zip(cols, (anchor, name, doc, tag, start.astype(np.uint32), (hi - lo).astype(np.uint32)), strict=True):
                        c.append(v)
            if not cols[0]:
                continue
            anchor, name, doc, tag, start, span = (np.concatenate(c) for c in cols)
            to = (anchor & low).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(to[order]) > 0))
            out = []
            for part in np.split(order, cut[1:]):
                out.append((int(to[part[0]]), *(v[part].tobytes() for v in (anchor, name, doc, tag, start, span))))
            yield pd.DataFrame(out, columns=["bucket", "anchors", "names", "docs", "tags", "starts", "spans"])

    return docs.mapInPandas(run, _L0)


_FOUND = "doc long, tag long, start long, size long, anchor long"


def _found(doc, tag, start, size, anchor=None) -> pd.DataFrame:
    anchors = pd.array(np.zeros(len(doc), np.int64) if anchor is None else anchor.view(np.int64), "Int64")
    if anchor is None:
        anchors[:] = pd.NA
    return pd.DataFrame({"doc": doc, "tag": tag.astype(np.int64), "start": start.astype(np.int64), "size": size.astype(np.int64), "anchor": anchors})


def _level0(batches):
    """Repeats (anchor null) and the tuples that recurse (anchor set)."""
    queue = TupleQueue()
    for b in batches:
        for a, m, d, t, s, n in zip(b["anchors"], b["names"], b["docs"], b["tags"], b["starts"], b["spans"], strict=True):
            queue.push(np.frombuffer(a, np.uint64), np.frombuffer(m, np.uint64), np.frombuffer(d, np.int64), np.frombuffer(s, np.uint32), np.frombuffer(n, np.uint32), np.frombuffer(t, np.uint32))
    # in the order of anchor, name, place: a class's first tuple comes first, whatever block the others are in
    last, kept = None, [np.zeros(0, x) for x in (np.uint64, np.int64, np.uint32, np.uint32, np.uint32, bool)]
    for a, m, d, s, n, t in queue.pop():
        cls = np.append(last is None or (a[0], m[0]) != last[:2], (a[1:] != a[:-1]) | (m[1:] != m[:-1]))
        first = np.maximum.accumulate(np.where(cls, np.arange(len(a)), -1))
        fd, fs = (np.where(first >= 0, c[first], 0 if last is None else f) for c, f in ((d, last and last[2]), (s, last and last[3])))
        later = ~cls & ((d > fd) | (s > fs))  # than the class's first; rows of equal place repeat none
        last = a[-1], m[-1], int(fd[-1]), int(fs[-1])
        if later.any():
            yield _found(d[later], t[later], s[later], n[later].astype(np.int64) + WINDOW)
        # the others recurse if their anchor has several classes, which the next block may tell of the last anchor
        kept = [np.concatenate(x) for x in zip(kept, [c[~later] for c in (a, d, s, n, t, cls)], strict=True)]
        yield from _asking(*(c[kept[0] != a[-1]] for c in kept))
        kept = [c[kept[0] == a[-1]] for c in kept]
    yield from _asking(*kept)


def _asking(a, d, s, n, t, cls):
    """Of whole anchors' first tuples, those of anchors with several classes."""
    if len(a):
        number = np.append(True, a[1:] != a[:-1]).cumsum() - 1
        ask = np.bincount(number, cls)[number] > 1
        if ask.any():
            yield _found(d[ask], t[ask], s[ask], n[ask].astype(np.int64) + WINDOW, a[ask])


_L1 = "bucket int, docs binary, tags binary, starts binary, sizes binary, data binary"


def _recursing(joined: DataFrame, buckets: int) -> DataFrame:
    """Bytes of the stretches that recurse, dealt by anchor.  joined: doc, tag, text, asks."""
    low = np.int64(buckets - 1)

    def run(batches):
        for b in batches:
            held: dict[int, list] = {}
            for doc, tag, text, asks in zip(b["doc"].tolist(), b["tag"].tolist(), b["text"], b["asks"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in asks:
                    to = int(np.int64(x["anchor"]) & low)
                    held.setdefault(to, []).append((doc, tag, x["start"], x["size"], data[x["start"] : x["start"] + x["size"]]))
            rows = []
            for to, items in held.items():
                d, t, s, n, data = zip(*items, strict=True)
                rows.append((to, np.array(d, np.int64).tobytes(), np.array(t, np.uint32).tobytes(), np.array(s, np.uint32).tobytes(), np.array(n, np.uint32).tobytes(), b"".join(data)))
            yield pd.DataFrame(rows, columns=["bucket", "docs", "tags", "starts", "sizes", "data"])

    return joined.mapInPandas(run, _L1)


def _level1(batches):
    """Windows of the recursing stretches: all but the first of equal windows are repeats."""
    queue = TupleQueue()
    for b in batches:
        for d, t, s, n, data in zip(b["docs"], b["tags"], b["starts"], b["sizes"], b["data"], strict=True):
            n = np.frombuffer(n, np.uint32).astype(np.int64)
            d, t, s = np.frombuffer(d, np.int64), np.frombuffer(t, np.uint32), np.frombuffer(s, np.uint32)
            ends = n.cumsum()
            for x in range(0, len(n), 4096):  # stretches hashed at once
                y = min(len(n), x + 4096)
                base = int(ends[x] - n[x])
                _, h64 = _hashes(np.frombuffer(data, np.uint8)[base : int(ends[y - 1])])
                able = n[x:y] - WINDOW + 1
                at = np.arange(int(able.sum())) - np.repeat(able.cumsum() - able, able)
                start = at + np.repeat(ends[x:y] - n[x:y] - base, able)
                name = _mix(h64[start] * np.uint64(3) ^ _mix(h64[start + WINDOW - 64]))
                queue.push(name, np.repeat(d[x:y], able), np.repeat(s[x:y], able).astype(np.int64) + at, np.repeat(t[x:y], able))
    last = None
    for name, d, s, t in queue.pop():
        cls = np.append(last is None or name[0] != last[0], name[1:] != name[:-1])
        first = np.maximum.accumulate(np.where(cls, np.arange(len(name)), -1))
        fd, fs = (np.where(first >= 0, c[first], 0 if last is None else f) for c, f in ((d, last and last[1]), (s, last and last[2])))
        later = ((d > fd) | (s > fs)) & ~cls
        last = name[-1], int(fd[-1]), int(fs[-1])
        if not later.any():
            continue
        d, s, t = d[later], s[later], t[later]
        order = np.lexsort((s, t, d))
        d, s, t = d[order], s[order], t[order]
        new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + WINDOW)))
        end = s[np.append(new[1:], len(s)) - 1] + WINDOW
        yield _found(d[new], t[new], s[new], end - s[new])


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc, tag, start, size): stretches of bytes that are covered by windows which also start earlier."""
    small_batches(documents.sparkSession)
    docs = _keyed(documents)
    size = text_bytes(documents)
    buckets = bucket_count(0.9 * size, BUCKET_BYTES)
    level0 = _tuples(docs, buckets).repartition(buckets, "bucket").mapInPandas(_level0, _FOUND)
    level0 = materialize(level0, "suffix-0")
    asks = level0.filter("anchor IS NOT NULL").groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size", "anchor")).alias("asks"))
    joined = docs.join(asks, ["doc", "tag"])
    level1 = _recursing(joined, buckets).repartition(buckets, "bucket").mapInPandas(_level1, _FOUND)
    return level0.filter("anchor IS NULL").unionByName(level1).select("doc", "tag", "start", "size")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The op7 query: one row per row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty; texts below 100 bytes lose nothing; a null doc_id is later than all others; rows of equal
    doc_id are one document by place: neither of two equal rows repeats the other.  An empty table gives an empty
    result.
    """
    spans = repeated_spans(documents).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = _keyed(documents).join(materialize(spans, "suffix-spans"), ["doc", "tag"], "left")

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, spans, absent in zip(b["doc"].tolist(), b["text"], b["spans"], b["absent"].tolist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, removed, count, at = hashlib.sha256(), 0, 0, 0
                if spans is not None:
                    end = -1
                    for s, e in sorted((x["start"], x["start"] + x["size"]) for x in spans):
                        if s > end:  # a new run; touching runs are one
                            kept.update(data[at:s])
                            count += 1
                            removed += e - s
                            at = end = e
                        elif e > end:
                            removed += e - end
                            at = end = e
                kept.update(data[at:])
                rows.append((None if absent else doc, len(data), removed, count, kept.hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
